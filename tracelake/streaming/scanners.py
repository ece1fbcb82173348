"""Scanners of byte streams in chunks: records, addresses and words are found whatever the cuts, in tables and in streams.

A chunk is a row of a file's name, an offset, bytes, and whether it is the file's last. In a stream the state store keeps,
for each file, what a scanner has to carry from one chunk to the next (the bytes of a pending record or token, and a few
numbers), and chunks that came before the ones they follow. A table's chunks are sorted by file and offset and go through
the same scanners; a file is read by one task, chunk after chunk, and never held whole.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions import netfn
from tracelake.sources.records import USN_SCHEMA, UsnScanner

_TOKEN = f"[{netfn.TOKEN}]".encode()


def _address(token: str) -> tuple[str, str, str] | None:
    """Canonical address, its text without a port, and its kind."""
    original = token.rstrip(".")
    if len(token) > netfn.MOST_TOKEN or "%" in original or not {".", ":"} & set(original):
        return None
    with_port = re.fullmatch(r"([0-9.]+):([0-9]{1,5})", original)
    if with_port and int(with_port[2]) <= 65535:
        original = with_port[1]
    try:
        found = ipaddress.ip_address(original)
    except ValueError:
        return None
    mapped = found.version == 6 and found.ipv4_mapped
    return f"::ffff:{mapped}" if mapped else str(found), original, f"IPv{found.version}"


class UsnChunks(UsnScanner):
    """Journal records; a gap ends the pending one."""

    fields = USN_SCHEMA.fields

    def finish(self) -> Iterator[dict]:
        return iter(())

    def gap(self, size: int) -> Iterator[dict]:
        self.at, self.rest = self.at + len(self.rest) + size, b""
        return iter(())

    def state(self) -> list:
        return [self.at, self.skipped]

    def resume(self, rest: bytes, state: list) -> None:
        self.rest, (self.at, self.skipped) = rest, state


class AddressChunks:
    """IPv4 and IPv6 literals in ASCII and both phases of UTF-16LE, as ``netfn.addresses`` finds them in whole contents, without its limit."""

    fields = [T.StructField("address", T.StringType()), T.StructField("original", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("start", T.LongType()), T.StructField("bytes", T.LongType())]
    _runs = ((re.compile(_TOKEN + b"+"), 1, "ascii"), (re.compile(b"(?:" + _TOKEN + b"\0)+"), 2, "utf16le"))

    def __init__(self) -> None:
        self.rest, self.at = b"", 0
        self.read, self.over = [0, 0], [False, False]  # how far each encoding is decided, and whether it is inside an overlong token

    def feed(self, chunk: bytes, last: bool = False) -> Iterator[dict]:
        data = self.rest + chunk
        for k, (runs, width, encoding) in enumerate(self._runs):
            begin, decided = self.read[k] - self.at, len(data)
            if width == 2 and not last and data and data[-1:] != b"\0" and re.fullmatch(_TOKEN, data[-1:]):
                decided -= 1  # its zero may follow
            for m in runs.finditer(data, begin):
                going_on = self.over[k] and m.start() == begin
                dangling = len(data) - m.end() if width == 2 else 0
                if m.end() == len(data) or dangling == 1:
                    # open: in UTF-16 too where one byte of the next unit is there
                    if not last:
                        self.over[k] = going_on or m.end() - m.start() > width * netfn.MOST_TOKEN
                        decided = m.end() if self.over[k] else m.start()
                        break
                    if dangling == 1:
                        continue
                if not going_on and (found := _address(m[0][::width].decode())):
                    yield {"address": found[0], "original": found[1], "kind": found[2], "encoding": encoding, "start": self.at + m.start(), "bytes": len(found[1]) * width}
            else:
                self.over[k] = self.over[k] and begin == decided
            self.read[k] = self.at + decided
        keep = min(self.read) - self.at
        self.at, self.rest = self.at + keep, data[keep:]

    def finish(self) -> Iterator[dict]:
        yield from self.feed(b"", last=True)

    def gap(self, size: int) -> Iterator[dict]:
        """What is missing ends every token."""
        yield from self.finish()
        self.at += len(self.rest) + size
        self.rest, self.read, self.over = b"", [self.at, self.at], [False, False]

    def state(self) -> list:
        return [self.at, *self.read, *map(int, self.over)]

    def resume(self, rest: bytes, state: list) -> None:
        self.rest, self.at, self.read, self.over = rest, state[0], list(state[1:3]), [bool(x) for x in state[3:5]]


def word_chunks(word: str) -> type:
    """A scanner of one word, overlapping occurrences included, as UTF-8 and as UTF-16LE."""
    if not word:
        raise ValueError("an empty word is everywhere")
    needles = [("utf8", word.encode()), ("utf16le", word.encode("utf-16-le"))]
    most = max(len(n) for _, n in needles) - 1

    class WordChunks:
        fields = [T.StructField("encoding", T.StringType()), T.StructField("start", T.LongType())]

        def __init__(self) -> None:
            self.rest, self.at = b"", 0

        def feed(self, chunk: bytes) -> Iterator[dict]:
            data = self.rest + chunk
            for encoding, needle in needles:
                at = data.find(needle, max(0, len(self.rest) - len(needle) + 1))
                while at >= 0:
                    yield {"encoding": encoding, "start": self.at + at}
                    at = data.find(needle, at + 1)
            keep = max(0, len(data) - most)
            self.at, self.rest = self.at + keep, data[keep:]

        def finish(self) -> Iterator[dict]:
            return iter(())

        def gap(self, size: int) -> Iterator[dict]:
            self.at, self.rest = self.at + len(self.rest) + size, b""
            return iter(())

        def state(self) -> list:
            return [self.at]

        def resume(self, rest: bytes, state: list) -> None:
            self.rest, self.at = rest, state[0]

    return WordChunks


#: the awaited offset of a file that has ended
ENDED = -1


class _File:
    """One file's scanner, the offset that it waits for, and the chunks that came too early."""

    def __init__(self, scanner: type, saved: tuple | None = None) -> None:
        self.scanner, self.next, self.early, self.done = scanner(), 0, {}, False
        if saved and saved[0] == ENDED:
            self.next, self.done = ENDED, True
        elif saved:
            self.next, rest, numbers, early = saved
            self.scanner.resume(bytes(rest), json.loads(numbers))
            self.early = {at: (data if data is None else bytes.fromhex(data), size, last) for at, data, size, last in json.loads(early)}

    def saved(self) -> tuple:
        if self.done:
            return ENDED, b"", "[]", "[]"
        early = [(at, data if data is None else data.hex(), size, last) for at, (data, size, last) in self.early.items()]
        return self.next, self.scanner.rest, json.dumps(self.scanner.state()), json.dumps(early)

    def take(self, at: int, data: bytes | None, size: int, last: bool) -> Iterator[dict]:
        """The chunk at the awaited offset; of one that reaches over what was read before, the rest."""
        known = self.next - at
        if known < size or (known == size and last):
            self.next = at + size
            if data is None:
                yield from self.scanner.gap(size - known)
            else:
                yield from self.scanner.feed(data[known:])
        if last and not self.done:
            self.done = True
            yield from self.scanner.finish()

    def put(self, at: int, data: bytes | None, size: int, last: bool) -> Iterator[dict]:
        """A chunk in any order; what repeats behind the end is ignored."""
        if self.done:
            return
        if at > self.next:
            self.early[at] = (data, size, last)
            return
        yield from self.take(at, data, size, last)
        while not self.done and (ready := [k for k in self.early if k <= self.next]):
            first = min(ready)
            yield from self.take(first, *self.early.pop(first))


def scan_chunks(chunks: DataFrame, scanner: type, file: str = "file", at: str = "at", data: str = "data", last: str = "last", size: str | None = None) -> DataFrame:
    """The file's name and what ``scanner`` finds, from a table of chunks or a stream of them; the same rows however files are cut.

    Without data a chunk is a gap of ``size`` bytes, a sparse range, which ends what is pending. Chunks may repeat, overlap and, in a
    stream, come in any order: early ones wait in the state store for those before them, and once the last one has been read
    only a mark stays, so that late repeats add nothing. A range that is missing from a table is a gap. A null ``last`` is false; chunks without an offset are left out.
    """
    length = F.coalesce(F.octet_length(data), F.col(size) if size else F.lit(0)).cast("bigint")
    rows = chunks.where(F.col(at).isNotNull()).select(F.col(file).alias("file"), F.col(at).cast("bigint").alias("at"), F.col(data).alias("data"), length.alias("size"), F.coalesce(F.col(last), F.lit(False)).alias("last"))
    schema = T.StructType([T.StructField(file, rows.schema["file"].dataType), *scanner.fields])
    names = [f.name for f in scanner.fields]
    return _streamed(rows, scanner, schema, names) if chunks.isStreaming else _sorted(rows, scanner, schema, names)


def _streamed(rows: DataFrame, scanner: type, schema: T.StructType, names: list[str]) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file = _File(scanner, state.get if state.exists else None)
        found: list[dict] = []
        for frame in frames:
            for at, data, size, last in zip(frame["at"], frame["data"], frame["size"], frame["last"], strict=True):
                found += file.put(int(at), None if data is None else bytes(data), int(size), bool(last))
        state.update(file.saved())
        if found:
            yield pd.DataFrame([[key[0], *(r[n] for n in names)] for r in found], columns=schema.names, dtype=object)

    return rows.groupBy("file").applyInPandasWithState(step, schema, "next bigint, rest binary, numbers string, early string", "append", GroupStateTimeout.NoTimeout)


def _sorted(rows: DataFrame, scanner: type, schema: T.StructType, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, file, name, first = to_arrow_schema(schema), None, None, True

        def batch(found: list[dict], name: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{schema.names[0]: name, **r} for r in found], schema=target)

        for b in batches:
            for own, at, data, size, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first or own != name:
                    if file and not file.done and (found := list(file.scanner.finish())):
                        yield batch(found, name)
                    file, name, first = _File(scanner), own, False
                if file.done:
                    continue
                missing = at - file.next
                found = list(file.take(file.next, None, missing, False)) if missing > 0 else []
                if found := found + list(file.take(at, data, size, last)):
                    yield batch(found, name)
        if file and not file.done and (found := list(file.scanner.finish())):
            yield batch(found, name)

    return rows.repartition("file").sortWithinPartitions("file", "at", F.desc("size")).mapInArrow(run, schema)


def cut(contents: DataFrame, file: str, content: str, size: Callable | int) -> DataFrame:
    """A table of whole contents as chunks of ``size`` bytes (a number or a Column)."""
    step = F.lit(size) if isinstance(size, int) else size
    length = F.octet_length(content)
    rows = contents.where(F.col(content).isNotNull()).select(file, content, step.alias("step"), F.explode(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), step)).alias("at"))
    return rows.select(F.col(file).alias("file"), F.col("at").cast("bigint").alias("at"), F.substring(F.col(content), F.col("at") + 1, F.col("step")).alias("data"), (F.col("at") + F.col("step") >= F.octet_length(content)).alias("last"))
