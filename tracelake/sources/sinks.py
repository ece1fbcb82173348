"""Sinks: sorted JSON lines, reports with a hash of their own, catalog blocks, and watched progress."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import timefn

# The order of the JSON-lines sinks.
CATALOG_ORDER = ("volume_offset", "pfad", "mft_record")
TIMELINE_ORDER = ("filetime", "mft_record", "name_index", "kind")
JOURNAL_ORDER = ("usn",)


def write_json_lines(rows: DataFrame, path: str, order: Sequence[str], mode: str = "overwrite") -> None:
    """JSON lines in a fixed order over all parts, nulls left out: two runs over the same rows give the same lines.

    The sort is range-partitioned; the parts, read by name, follow the order, so no task writes everything.
    """
    fields = [c for c in rows.columns]
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields)))
    rows.orderBy(*order, *(c for c in fields if c not in order and not isinstance(rows.schema[c].dataType, T.MapType))).select(line.alias("value")).write.mode(mode).text(path)


def catalog_block(rows: DataFrame, times: Sequence[str]) -> DataFrame:
    """Catalog rows with their ISO times as FILETIME numbers (null for what is no time) and sizes over 63 bits as null."""
    out = rows.withColumns({c: timefn.iso_filetime(F.col(c)) for c in times})
    for field in out.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            out = out.withColumn(field.name, F.col(field.name).try_cast("bigint"))
    return out


def append_blocks(rows: DataFrame, path: str, keys: Sequence[str], times: Sequence[str]) -> int:
    """Appends the catalog rows whose keys a Parquet table does not hold yet; how many these were. Written once more, nothing is added."""
    spark = rows.sparkSession
    block = catalog_block(rows, times).dropDuplicates(list(keys))
    try:
        block = block.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    except Exception as error:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
    seen = Observation("appended")
    block.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def from_json_table(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of a table that stands as one JSON array in each row; values of another type are null."""
    return rows.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def report(sections: dict[str, DataFrame], most_rows: int) -> tuple[bytes, str]:
    """A report of small result tables as canonical JSON, and its SHA-256; a table of more than ``most_rows`` rows is an error, not cut."""
    out = {}
    for name, df in sections.items():
        found = [json.loads(r.value) for r in df.select(F.to_json(F.struct(*df.columns)).alias("value")).limit(most_rows + 1).collect()]
        if len(found) > most_rows:
            raise ValueError(f"{name} has over {most_rows} rows; a report is for summaries")
        out[name] = sorted(found, key=lambda r: json.dumps(r, sort_keys=True))
    data = json.dumps(out, ensure_ascii=False, sort_keys=True, indent=1).encode()
    return data, hashlib.sha256(data).hexdigest()


def report_html(data: bytes) -> str:
    """The report as a page; every value is escaped."""
    parts = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body>"]
    for name, rows in json.loads(data).items():
        columns = sorted({c for r in rows for c in r})
        cells = lambda r, tag: "".join(f"<{tag}>{html.escape(str(r.get(c, '')))}</{tag}>" for c in columns)  # noqa: E731, B023
        body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{cells({c: c for c in columns}, 'th')}</tr>{body}</table>")
    return "".join([*parts, "</body></html>"])


def watched(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that tells after an action how many passed and how many had an error in ``fehler``, where there is such a column."""
    seen = Observation(name)
    errors = F.count("fehler") if "fehler" in rows.columns else F.lit(0)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), errors.alias("errors")), seen
