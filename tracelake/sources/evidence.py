"""Evidence files: their kind, hash and place in the case's folder in one scan, and listings of the folder without reading contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: first bytes of capture files and of Expert Witness images, and how many entries a listing has
CAPTURES = ("d4c3b2a1", "a1b2c3d4", "4d3cb2a1", "a1b23c4d", "0a0d0d0a")
EWF = "455646090d0aff00"
MOST_LISTED = 2000


def _at(content: Column, start: int, size: int) -> Column:
    return F.lower(F.hex(F.substring(content, start + 1, size)))


def evidence_kind(content: Column) -> Column:
    """``e01_image``, ``pcap``, ``raw_disk_image`` (a GPT, or an MBR with a partition) or ``other``, by a file's first kilobyte."""
    entry = lambda k: (_at(content, 446 + 16 * k, 1).isin("00", "80")) & (_at(content, 450 + 16 * k, 1) != "00")
    mbr = (_at(content, 510, 2) == "55aa") & (entry(0) | entry(1) | entry(2) | entry(3))
    gpt = _at(content, 512, 8) == F.lower(F.hex(F.encode(F.lit("EFI PART"), "UTF-8")))
    return F.when(_at(content, 0, 8) == EWF, "e01_image").when(_at(content, 0, 4).isin(*CAPTURES), "pcap").when(mbr | gpt, "raw_disk_image").otherwise("other")


def _folder(path: str) -> str:
    return path.rstrip("/") + "/"


def contained(path: Column, folder: str) -> Column:
    """Below the folder, and not by way of ``..``; schemes are compared as Hadoop writes them, with one slash or three."""
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    return F.startswith(plain(path), plain(F.lit(_folder(folder)))) & ~path.rlike(r"(?:^|/)\.\.(?:/|$)")


def read_evidence(spark: SparkSession, folder: str, case_folder: str) -> DataFrame:
    """Every file below a folder: path, name, size, modified, kind, sha256, and whether it is ``contained`` in the case's folder.

    One scan: a file's content is read once, and hashed where it lies. A file is one row of up to 2 GB, which is Spark's limit for
    whole files; larger images are hashed by whoever copies them. Empty files are no rows: Spark's file source skips them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.col("_metadata.file_name").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), evidence_kind(F.col("content")).alias("kind"), F.sha2(F.col("content"), 256).alias("sha256"), contained(path, case_folder).alias("contained"))


def list_folder(spark: SparkSession, case_folder: str, inside: str = "", most: int = MOST_LISTED) -> DataFrame:
    """The entries right in a folder of the case: name, type (``dir``, ``file``) and size; directories first, each kind by name, the first ``most``. Contents aren't read; empty files, which Spark's file source skips, are left out."""
    if ".." in inside.split("/"):
        raise ValueError(f"{inside} is not in the case's folder")
    base = _folder(_folder(case_folder) + inside.strip("/")) if inside.strip("/") else _folder(case_folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    rest = F.substr(plain(F.col("path")), F.length(plain(F.lit(base))) + 1)
    first = F.substring_index(rest, "/", 1)
    entries = files.select(first.alias("name"), (first != rest).alias("is_dir"), "length").groupBy("name", "is_dir").agg(F.max("length").alias("length"))
    return entries.orderBy(~F.col("is_dir"), "name").limit(most).select("name", F.when(F.col("is_dir"), "dir").otherwise("file").alias("type"), F.when(~F.col("is_dir"), F.col("length")).alias("size"))
