"""Record formats: change journal, Zone.Identifier, shell history, recycle bin, prefetch names, SQLite histories and JSON lines."""

from __future__ import annotations

import configparser
import os
import re
import sqlite3
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import textfn, timefn

#: fixed values: plausible record lengths, and limits of text streams
USN_LEAST, USN_MOST = 8, 65536
ZONE_BYTES, ZONE_LINES = 65536, 256
ZONE_FIELDS = ("zoneid", "referrerurl", "hosturl", "lastwriterpackagefamilyname", "appzoneid", "appdefinedzoneid")

USN_SCHEMA = T.StructType([
    T.StructField("stream_offset", T.LongType()), T.StructField("record_length", T.LongType()), T.StructField("version_major", T.IntegerType()), T.StructField("version_minor", T.IntegerType()),
    T.StructField("file_reference", T.StringType()), T.StructField("parent_reference", T.StringType()), T.StructField("mft_record", T.LongType()), T.StructField("sequence", T.IntegerType()),
    T.StructField("parent_record", T.LongType()), T.StructField("parent_sequence", T.IntegerType()), T.StructField("usn", T.LongType()), T.StructField("filetime", T.LongType()),
    T.StructField("reason", T.LongType()), T.StructField("source_info", T.LongType()), T.StructField("security_id", T.LongType()), T.StructField("file_attributes", T.LongType()), T.StructField("name", T.StringType()),
])


def usn_record(raw: bytes, at: int) -> dict | None:
    """One version 2 or 3 record, or None if it is not sound."""
    if len(raw) < 8:
        return None
    length, major, minor = struct.unpack_from("<IHH", raw, 0)
    if length != len(raw) or (major, len(raw) >= {2: 60, 3: 76}.get(major, 1 << 62)) not in ((2, True), (3, True)):
        return None
    if major == 2:
        own, parent, base = *struct.unpack_from("<QQ", raw, 8), 24
        refs = {"file_reference": f"{own:016x}", "parent_reference": f"{parent:016x}", "mft_record": own & 0xFFFFFFFFFFFF, "sequence": own >> 48, "parent_record": parent & 0xFFFFFFFFFFFF, "parent_sequence": parent >> 48}
    else:
        base = 40
        refs = {"file_reference": raw[8:24].hex(), "parent_reference": raw[24:40].hex(), "mft_record": None, "sequence": None, "parent_record": None, "parent_sequence": None}
    usn, filetime, reason, source, security, attributes, size, start = struct.unpack_from("<qqIIIIHH", raw, base)
    if size % 2 or start + size > len(raw):
        return None
    name = raw[start : start + size].decode("utf-16-le", "replace")
    return {"stream_offset": at, "record_length": length, "version_major": major, "version_minor": minor, **refs, "usn": usn, "filetime": filetime, "reason": reason, "source_info": source, "security_id": security, "file_attributes": attributes, "name": name}


class UsnScanner:
    """Records from a journal fed in chunks of any size; the results do not depend on the cuts. Zero words are free space, unsound bytes are skipped 8 at a time."""

    def __init__(self) -> None:
        self.rest, self.at, self.skipped = b"", 0, 0

    def feed(self, chunk: bytes) -> Iterator[dict]:
        data, i = self.rest + chunk, 0
        while len(data) - i >= 8:
            length = struct.unpack_from("<I", data, i)[0]
            if USN_LEAST <= length <= USN_MOST and length % 8 == 0:
                if len(data) - i < length:
                    break
                if record := usn_record(data[i : i + length], self.at + i):
                    yield record
                    i += length
                    continue
            self.skipped += 8 if length else 0
            i += 8
        self.rest, self.at = data[i:], self.at + i


def _rows(df: DataFrame, columns: list[str], schema: T.StructType, parse: Callable[..., Iterator[dict]], keep: list[str]) -> DataFrame:
    """Rows that ``parse`` yields for each input row; ``keep`` columns go along."""
    full = T.StructType([*(df.schema[c] for c in keep), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            rows = [{**{c: r[c] for c in keep}, **x} for r in batch.to_pylist() for x in parse(*(r[c] for c in columns))]
            if target is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                target = to_arrow_schema(full)
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in target.names} for r in rows], schema=target)

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, full)


def read_usn(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The records of journal files, with decoded reasons and times."""
    rows = _rows(files, [content], USN_SCHEMA, lambda raw: UsnScanner().feed(raw or b""), list(keep))
    return rows.withColumns({"reasons": textfn.bit_names(F.col("reason"), textfn.USN_REASONS), "unknown_reason_bits": textfn.unknown_bits(F.col("reason"), textfn.USN_REASONS), "time_utc": F.when(F.col("filetime") >= 0, timefn.filetime_iso(F.col("filetime")))})


def usn_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("version_major") == 3).alias("version_3"), F.count_distinct("file_reference").alias("files"), F.count_if(F.array_contains("reasons", "FILE_DELETE")).alias("deletions"), F.min("usn").alias("first_usn"), F.max("usn").alias("last_usn"))


RECYCLE_SCHEMA = T.StructType([T.StructField("original_path", T.StringType()), T.StructField("size", T.DecimalType(20, 0)), T.StructField("deleted_unix", T.LongType())])


def recycled(raw: bytes | None) -> Iterator[dict]:
    """The metadata of a deleted file, versions 1 (fixed path) and 2 (counted path); nothing if it is unsound."""
    from decimal import Decimal

    if not raw or len(raw) < 24:
        return
    version, size, ticks = struct.unpack_from("<QQQ", raw, 0)
    if version == 1:
        path = raw[24 : 24 + 520]
    elif version == 2 and len(raw) >= 28 and len(raw) >= 28 + 2 * struct.unpack_from("<I", raw, 24)[0]:
        path = raw[28 : 28 + 2 * struct.unpack_from("<I", raw, 24)[0]]
    else:
        return
    text = path[: len(path) // 2 * 2].decode("utf-16-le", "replace").split("\0")[0]
    if text:
        yield {"original_path": text, "size": Decimal(size), "deleted_unix": (ticks - timefn.EPOCH_TICKS) // 10_000_000 if ticks else None}


def read_recycled(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Deleted files, with the SID that their folder names."""
    rows = _rows(files, [content], RECYCLE_SCHEMA, recycled, [path])
    sid = F.regexp_extract(F.replace(F.col(path), F.lit("/"), F.lit("\\")), r"\\?\$Recycle\.Bin\\(S-1-[^\\]+)\\", 1)
    return rows.withColumn("sid", F.when(sid != "", sid))


ZONE_SCHEMA = T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("other_fields", T.ArrayType(T.StringType())), T.StructField("notes", T.ArrayType(T.StringType())), T.StructField("encoding", T.StringType()), T.StructField("error", T.StringType())])


def zone_identifier(raw: bytes | None) -> Iterator[dict]:
    """The section ``[ZoneTransfer]``: the first of equal fields counts; others and lines without sense are noted."""
    raw = raw or b""
    empty = {"fields": {}, "other_fields": [], "notes": [], "encoding": None, "error": None}
    encoding, body = next(((n, raw[len(b) :]) for b, n in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")) if raw.startswith(b)), ("utf-8", raw))
    if len(raw) > ZONE_BYTES:
        yield {**empty, "error": "too long"}
        return
    try:
        text = body.decode(encoding)
    except UnicodeDecodeError:
        yield {**empty, "error": "not text"}
        return
    lines = text.splitlines()
    if "\0" in text or len(lines) > ZONE_LINES:
        yield {**empty, "error": "zero characters" if "\0" in text else "too many lines"}
        return
    fields: dict[str, str] = {}
    others, notes, inside, found = [], [], False, False
    for number, line in enumerate((x.strip().lstrip("\ufeff") for x in lines), 1):
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and line[-1] == "]":
            inside = line[1:-1].strip().lower() == "zonetransfer"
            found |= inside
        elif inside:
            name, equals, value = (x.strip() for x in line.partition("="))
            if not equals or not name:
                notes.append(f"line {number} has no " + ("name" if equals else "equals sign"))
            elif name.lower() in fields:
                notes.append(f"field {name} repeated")
            else:
                fields[name.lower()] = value
                if name.lower() not in ZONE_FIELDS:
                    others.append(f"{name}={value}")
    if not found:
        yield {**empty, "error": "no section ZoneTransfer"}
        return
    if "zoneid" in fields and not re.fullmatch(r"\+?[0-9]+", fields["zoneid"]):
        notes.append("ZoneId is no number")
    yield {"fields": fields, "other_fields": others, "notes": notes, "encoding": encoding.upper(), "error": None}


def read_zones(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    return _rows(files, [content], ZONE_SCHEMA, zone_identifier, [path])


def read_shell_history(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Lines of PSReadLine histories by byte offset; a byte order mark is no text, invalid UTF-8 gives nothing."""
    from tracelake.operators import search

    octets = F.col(content)
    mark = F.when(F.substring(octets, 1, 3) == F.unhex(F.lit("EFBBBF")), 3).otherwise(0)
    sound = files.where(F.octet_length(content) <= 16 << 20).withColumns({"_mark": mark.cast("bigint"), "_text": F.try_validate_utf8(F.expr(f"cast(`{content}` AS string)"))}).where("_text IS NOT NULL")
    body = sound.withColumn("_body", F.when(F.col("_mark") == 3, F.substr("_text", F.lit(2))).otherwise(F.col("_text")))
    lines = search.lines_with_offsets(body.withColumn("_key", F.struct(path, "_mark")), "_key", "_body")
    user = textfn.user_from_path(F.replace(F.col(path), F.lit("/"), F.lit("\\")))
    return lines.select(F.col("_key")[path].alias(path), "line_no", (F.col("offset") + F.col("_key._mark")).alias("offset"), "bytes", "line", "continued").withColumn("profile", user)


def prefetch_name(path: Column) -> tuple[Column, Column]:
    """Program and hash of ``NAME.EXE-0123ABCD.pf``."""
    name = F.regexp_extract(path, r"(?i)([^\\/]+)-([0-9A-F]{8})\.pf$", 1)
    return F.when(name != "", name), F.when(name != "", F.upper(F.regexp_extract(path, r"(?i)([^\\/]+)-([0-9A-F]{8})\.pf$", 2)))


def read_sqlite(files: DataFrame, statement: str, schema: T.StructType, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows of one read-only statement over each SQLite file; files that are none give nothing."""

    def rows(raw: bytes | None) -> Iterator[dict]:
        if not raw or not raw.startswith(b"SQLite format 3\0"):
            return
        with tempfile.TemporaryDirectory() as folder:  # a task's scratch file, gone with the task
            path = os.path.join(folder, "x.db")
            with open(path, "wb") as f:
                f.write(raw)
            base = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
            try:
                for row in base.execute(statement):
                    yield dict(zip(schema.names, row, strict=True))
            except sqlite3.DatabaseError:
                return
            finally:
                base.close()

    return _rows(files, [content], schema, rows, list(keep))


HISTORY = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("visits", T.LongType()), T.StructField("last_visit", T.LongType())])
CHROMIUM = "SELECT url, title, visit_count, last_visit_time FROM urls"
FIREFOX = "SELECT url, title, visit_count, last_visit_date FROM moz_places WHERE last_visit_date IS NOT NULL"


def read_browser_histories(files: DataFrame) -> DataFrame:
    """Histories of both families (path, content), with the last visit as Unix seconds, latest first."""
    chromium = read_sqlite(files, CHROMIUM, HISTORY).withColumn("last_visit", timefn.chromium_unix(F.col("last_visit")))
    firefox = read_sqlite(files, FIREFOX, HISTORY).withColumn("last_visit", timefn.firefox_unix(F.col("last_visit")))
    return chromium.unionByName(firefox).orderBy(F.desc_nulls_last("last_visit"), "path", "url")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Extracted files as (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order, range-partitioned: files in name order are the sorted whole, the same in every run."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def hashed_files(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(content, 256))


def yara_hits(text: str) -> list[tuple[str, str]]:
    """Rule and path of each line of a scanner's plain output."""
    return [(m[1], m[2]) for m in (re.fullmatch(r"(\S+)\s+(.+)", x.strip()) for x in text.splitlines()) if m]


def term_file(text: str) -> dict[str, list[str]]:
    """Categories of an INI-like term table: a section each, a term a line."""
    parser = configparser.ConfigParser(allow_no_value=True, delimiters=("=",), strict=False)
    parser.optionxform = str  # type: ignore[assignment]
    parser.read_string(text)
    return {s: list(parser[s]) for s in parser.sections()}
