"""Streams of file chunks through the stateful scanners, stopped and started again halfway."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import table
from tracelake.streaming import scanners
from tracelake.workspace import shared_folder

from .registry import query
from .review import _OCTET
from .timeline import micros


def _scanned_twice(chunks: DataFrame, first: Column, scanner: type) -> DataFrame:
    """Chunks are appended to a folder in two parts; a stream of the folder is run after each, from its checkpoint."""
    spark = chunks.sparkSession
    folder = shared_folder(spark, "chunk-stream")
    source, out = os.path.join(folder, "chunks"), os.path.join(folder, "found")
    for part in (first, ~first):
        chunks.where(part).write.mode("append").parquet(source)
        stream = scanners.scan_chunks(spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1000).parquet(source), scanner)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _little_endian(number: Column, size: int) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(number.cast("bigint")), 2 * size, "0"), F.lit(".."), 0)), "")


def _journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as change records of version 2, with free space before every fifth event and a broken header before every seventh."""
    n, name = F.col("event_id"), F.concat(F.lit("ä"), F.col("event_id").cast("string"), F.lit("."), F.col("event_type"))
    text = F.hex(F.encode(name, "UTF-16LE"))
    size = F.ceil((60 + F.length(text) / 2) / 8) * 8
    le = lambda value, size: _little_endian(value if isinstance(value, Column) else F.lit(value), size)
    ticks = micros("ts") * 10 + F.lit(116444736000000000)
    record = F.concat(le(size, 4), le(2, 2), le(0, 2), le(n + (F.lit(3) * F.lit(1 << 48)), 8), le(5, 8), le(n * 16, 8), le(ticks, 8), le(F.call_function("shiftleft", F.lit(1), (n % 9).cast("int")), 4), le(0, 4), le(0, 4), le(32, 4), le(F.length(text) / 2, 2), le(60, 2), text)
    before = F.concat(F.when(n % 5 == 0, F.repeat(F.lit("00"), 16)).otherwise(""), F.when(n % 7 == 0, F.lit("FFFFFFFF01020304")).otherwise(""))
    padded = F.concat(before, F.call_function("rpad", record, (size * 2).cast("int"), F.lit("0")))
    whole = F.array_sort(F.collect_list(F.struct("event_id", padded.alias("bytes"))))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file")).agg(F.unhex(F.array_join(F.transform(whole, lambda r: r["bytes"]), "")).alias("content"))


@query("""WITH e AS (SELECT *, 'ä' || event_id || '.' || event_type AS name FROM events),
s AS (SELECT *, (60 + 2 * length(name) + 7) // 8 * 8 AS size, CASE WHEN event_id % 5 = 0 THEN 16 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 8 ELSE 0 END AS before FROM e)
SELECT user_id AS file, (sum(size + before) OVER (PARTITION BY user_id ORDER BY event_id) - size)::BIGINT AS stream_offset, size::BIGINT AS record_length, event_id AS mft_record, 3 AS sequence, event_id * 16 AS usn, epoch_us(ts) * 10 + 116444736000000000 AS filetime, (1 << (event_id % 9))::BIGINT AS reason, name FROM s""")
def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of journals that arrive in chunks of 37 to 127 bytes, some of them before the ones they follow."""
    step = (37 + F.col("file") % 10 * 10).cast("int")
    chunks = scanners.cut(_journals(spark, sf_dir), "file", "content", step)
    early = (F.col("at") / step).cast("bigint") % 4 != 1
    found = _scanned_twice(chunks, F.when(F.col("file") % 3 == 0, early).otherwise(F.col("at") < 1000), scanners.UsnChunks)
    return found.select("file", "stream_offset", "record_length", "mft_record", "sequence", "usn", "filetime", "reason", "name")


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9.:_%-]+')), '\.+$', '') AS token FROM documents)
SELECT doc_id AS file, string_split(token, ':')[1] AS address, 'IPv4' AS kind, CASE WHEN doc_id % 2 = 0 THEN 'ascii' ELSE 'utf16le' END AS encoding, count(*) AS n FROM t WHERE length(token) <= 128 AND regexp_full_match(token, '{_OCTET}(\.{_OCTET}){{3}}(:[0-9]{{1,5}})?') AND coalesce(try_cast(string_split(token, ':')[2] AS INT), 0) <= 65535 GROUP BY ALL
UNION ALL SELECT doc_id, '2001:db8::' || (doc_id % 9000 + 1000), 'IPv6', CASE WHEN doc_id % 2 = 0 THEN 'ascii' ELSE 'utf16le' END, 1 FROM documents""")
def address_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents that arrive as bytes of both encodings, in chunks of 1001 to 8001 bytes."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n2001:DB8:0::"), (F.col("doc_id") % 9000 + 1000).cast("string"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "UTF-16LE")).alias("content"))
    step = (F.col("file") % 8 * 1000 + 1001).cast("int")
    found = _scanned_twice(scanners.cut(docs, "file", "content", step), (F.col("at") / step).cast("bigint") % 5 != 2, scanners.AddressChunks)
    return found.groupBy("file", "address", "kind", "encoding").agg(F.count(F.lit(1)).alias("n"))
