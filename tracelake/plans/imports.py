"""Import of evidence files that are written from customers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import table
from tracelake.sources import evidence
from tracelake.workspace import shared_folder

from .registry import query


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A file a nation, of its customers' names line by line: captures, disk images and others by a first line of their form."""
    n = F.col("n")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("place"), F.col("c_name").alias("line"))
    head = F.when(n % 3 == 0, F.lit("\n\r\r")).when(n % 3 == 1, F.concat(F.rpad(F.lit("x"), 512, "x"), F.lit("EFI PART"))).otherwise("no form")
    heads = rows.select("n").distinct().select("n", F.lit(-1).cast("bigint").alias("place"), head.alias("line"))
    folder = shared_folder(spark, "evidence")
    named = rows.unionByName(heads).select("line", F.col("place").cast("bigint").alias("place"), F.concat(F.when(n % 2 == 0, "case").otherwise("other"), F.lit("_"), n.cast("string")).alias("folder"))
    # in the writer's own order, so that it doesn't sort again
    named.repartition("folder").sortWithinPartitions("folder", "place").select("line", "folder").write.partitionBy("folder").text(folder)
    return folder


@query("""WITH h AS (SELECT DISTINCT c_nationkey AS n, CASE c_nationkey % 3 WHEN 0 THEN chr(10) || chr(13) || chr(13) WHEN 1 THEN repeat('x', 512) || 'EFI PART' ELSE 'no form' END AS head FROM customer),
f AS (SELECT c_nationkey AS n, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY 1)
SELECT n::BIGINT AS n, CASE n % 3 WHEN 0 THEN 'pcap' WHEN 1 THEN 'raw_disk_image' ELSE 'other' END AS kind, strlen(head || chr(10) || body)::BIGINT AS size, sha256(head || chr(10) || body) AS sha256, n = 4 AS contained FROM h JOIN f USING (n)""")
def evidence_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, hash and place of every file, in one scan; one folder is the case's."""
    folder = _written(spark, sf_dir)
    found = evidence.read_evidence(spark, folder, os.path.join(folder, "folder=case_4"))
    return found.select(F.regexp_extract("path", r"folder=[a-z]+_([0-9]+)/", 1).cast("bigint").alias("n"), "kind", "size", "sha256", "contained")


@query("""SELECT 'folder=' || CASE WHEN c_nationkey % 2 = 0 THEN 'case_' ELSE 'other_' END || c_nationkey AS name, 'dir' AS type, NULL::BIGINT AS size FROM customer GROUP BY c_nationkey""")
def evidence_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that the files are in."""
    return evidence.list_folder(spark, _written(spark, sf_dir))
