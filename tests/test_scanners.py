"""Chunk scanners: the same rows for any cut, any order, repeats and overlaps, in tables and in streams that are stopped."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from tracelake.functions import netfn
from tracelake.sources.records import UsnScanner
from tracelake.streaming import scanners

SCHEMA = "file string, at bigint, data binary, size bigint, last boolean"


def record(n: int) -> bytes:
    name = f"ä{n}.x".encode("utf-16-le")
    raw = struct.pack("<QQqqIIIIHH", n, 5, n, n, 1, 0, 0, 32, len(name), 60) + name
    size = -(-(8 + len(raw)) // 8) * 8
    return (struct.pack("<IHH", size, 2, 0) + raw).ljust(size, b"\0")


def journal(seed: int) -> bytes:
    rnd = random.Random(seed)
    return b"".join(rnd.choice([b"", bytes(16), b"\xff" * 8, struct.pack("<IHH", 64, 9, 9)]) + record(k) for k in range(20))


def text(seed: int) -> bytes:
    rnd = random.Random(seed)
    words = ["192.0.2.1", "10.0.0.1:443", "fe80::1.", "host1.2.3.4", "x" * 140, "1" * 127 + "::", ":", "\0", "2001:db8::5", "aa", "aaa"]
    return b"".join(rnd.choice([b"", b"\x01", b" "]) + rnd.choice(words).encode(rnd.choice(["ascii", "utf-16-le"])) for _ in range(25))


def fed(kind, data: bytes, cuts: list[int], keep: bool = False) -> list[tuple]:
    """What a scanner finds in chunks, its state taken out and put back between any two."""
    s, out = kind(), []
    for a, z in zip([0, *cuts], [*cuts, len(data)], strict=True):
        out += s.feed(data[a:z])
        fresh = kind()
        fresh.resume(s.rest, s.state())
        s = fresh
    return sorted(tuple(r.values()) for r in [*out, *s.finish()])


WORD = scanners.word_chunks("aa")


@pytest.mark.parametrize(("kind", "make"), [(scanners.UsnChunks, journal), (scanners.AddressChunks, text), (WORD, text)])
def test_cuts_change_nothing(kind, make):
    rnd = random.Random(1)
    some = 0
    for seed in range(60):
        data = make(seed)
        whole = fed(kind, data, [])
        some += len(whole)
        assert fed(kind, data, list(range(1, len(data)))) == whole
        for _ in range(5):
            assert fed(kind, data, sorted(rnd.sample(range(len(data)), 4))) == whole
    assert some > 60


def test_whole_contents(spark):
    """Chunk scanners find what is found in whole contents."""
    data = {str(k): text(k) for k in range(40)}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "file string, content binary")
    whole = rows.select("file", F.inline(netfn.addresses(F.col("content"), True))).drop("limited")
    chunks = scanners.cut(rows, "file", "content", F.lit(7) + F.length("file"))
    found = scanners.scan_chunks(chunks, scanners.AddressChunks)
    assert sorted(map(tuple, found.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    for k, v in data.items():
        at = [i for i in range(len(v)) if v[i : i + 2] == b"aa"]
        assert [r[1] for r in fed(WORD, v, []) if r[0] == "utf8"] == at


def chunk_rows(rnd: random.Random, name: str, data: bytes) -> list[tuple]:
    cuts = [0, *sorted(rnd.sample(range(1, len(data)), 6)), len(data)]
    rows = [(name, a, bytearray(data[a:z]), None, z == len(data)) for a, z in zip(cuts, cuts[1:], strict=False)]
    a = cuts[2]
    return [*rows, rows[1], (name, a - 3, bytearray(data[a - 3 : a + 5]), None, False)]  # one again, and one that reaches over two


def journals(rnd: random.Random) -> tuple[list[tuple], list[tuple]]:
    rows, wanted = [], []
    for k in range(8):
        data = journal(k)
        rows += chunk_rows(rnd, f"f{k}", data)
        wanted += [(f"f{k}", r["stream_offset"], r["name"]) for r in UsnScanner().feed(data)]
    rows += [("nothing", 0, bytearray(b""), None, True), ("nothing", None, None, None, None), (None, 0, bytearray(record(1)), None, None)]
    return rows, sorted(wanted)


def test_tables(spark):
    rows, wanted = journals(random.Random(4))
    found = scanners.scan_chunks(spark.createDataFrame(rows, SCHEMA).repartition(5), scanners.UsnChunks, size="size").collect()
    assert sorted((r.file, r.stream_offset, r.name) for r in found if r.file) == wanted
    assert [r.name for r in found if r.file is None] == ["ä1.x"]
    assert scanners.scan_chunks(spark.createDataFrame([], SCHEMA), scanners.UsnChunks).collect() == []


def test_gaps(spark):
    """A sparse range ends a pending record, whether it is a row or missing; what stands behind is found at its offset."""
    one = record(1)
    rows = [("row", 0, bytearray(one[:40]), None, False), ("row", 40, None, 88, False), ("row", 128, bytearray(one), None, True), ("missing", 0, bytearray(one[:40]), None, False), ("missing", 128, bytearray(one), None, True)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = scanners.scan_chunks(frame, scanners.UsnChunks, size="size").collect()
    assert sorted((r.file, r.stream_offset) for r in found) == [("missing", 128), ("row", 128)]
    both = spark.createDataFrame([("a", 0, bytearray(b"10.0.0.1"), None, False), ("a", 8, None, 4, False), ("a", 12, bytearray(b"10.0.0.2"), None, True)], SCHEMA)
    assert sorted((r.address, r.start) for r in scanners.scan_chunks(both, scanners.AddressChunks, size="size").collect()) == [("10.0.0.1", 0), ("10.0.0.2", 12)]


def test_streams_that_are_stopped(spark, tmp_path):
    """Shuffled chunks over five runs of one query: no row twice, none lost; repeats behind a file's end, and of all files in a sixth run, add nothing."""
    rnd = random.Random(9)
    rows, wanted = journals(rnd)
    rows = [r for r in rows if r[0]]
    rnd.shuffle(rows)
    source, out, state = (str(tmp_path / n) for n in ("chunks", "out", "state"))
    for k in range(6):
        spark.createDataFrame(rows if k == 5 else rows[k::5], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = scanners.scan_chunks(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), scanners.UsnChunks, size="size")
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.file, r.stream_offset, r.name) for r in spark.read.schema(found.schema).parquet(out).collect()) == wanted
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len({r[0] for r in rows})
