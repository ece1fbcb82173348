"""Packing of whole documents into training sequences of a fixed number of tokens: best-two-fit on the histogram of lengths.

A bin is filled greedily, with the longest document that still fits; then its shortest document is replaced by the two
unpacked documents that fit the expanded gap most tightly, if two together are longer than it. Which document of a length is
taken makes no difference to this, so it is decided on how many documents there are of each length. That histogram has
``capacity`` entries whatever the corpus, and bins of the same lengths are decided together, with a multiplicity, for as long
as deciding them one by one would give the same. Documents are then numbered within their length, in parallel: a number a
length within each written partition, plus the sum over the partitions before; the number says the bin and the place in it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sparkio import bound_batches, saved

#: tokens a sequence holds
CAPACITY = 2048
#: the id that ends each document
END_ID = 0
#: words whose ids a worker remembers
REMEMBERED = 500_000
#: characters whose words are held at a time
CHUNK = 1 << 20
#: bits of a document's number within its length
NUMBER_BITS = 48

#: fixed values: the pre-tokenizer's words in texts of characters below U+0250, and its letters for bytes that don't print
_LETTER, _NUMBER, _SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_LETTER}{_NUMBER}{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = "\u0250"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_BLANK = chr(_LETTERS[0x20])
#: where no word goes across: a space between two characters that are none
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def number_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, equal to those of the tokenizer.

    Texts are cut at single spaces, where the pre-tokenizer always cuts, and the ids of the pieces are remembered. Those of
    Latin letters are cut into the pre-tokenizer's words here, and the library's BPE model is asked for new words only; others
    go through the whole library. Tokenizers of another kind than byte-level BPE read whole texts through the library.
    """

    def __init__(self, json: str, remembered: int = REMEMBERED) -> None:
        import json as reader

        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_str(json), remembered
        self.model = self.tokenizer.model  # asking for it copies it
        kind = reader.loads(json)
        pre, model = kind.get("pre_tokenizer") or {}, kind["model"]
        self.added = [t["content"] for t in kind.get("added_tokens", [])]
        self.by_words = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), kind.get("normalizer"), kind.get("truncation"), model["type"], model.get("ignore_merges", False)) == ("ByteLevel", False, True, None, None, "BPE", False) and not any(re.search(r"\s", a) or a.isalnum() for a in self.added)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [number_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, w: str) -> bytes:
        """Ids of one of the pre-tokenizer's words."""
        found = self.words.get(w)
        if found is None:
            if len(self.words) >= self.remembered:
                self.words.clear()
            spelt = w.replace(" ", _BLANK) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_LETTERS)
            found = self.words[w] = number_bytes([t.id for t in self.model.tokenize(spelt)])
        return found

    def new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces; the words that have been seen are looked up."""
        out: list[bytes | None] = []
        whole = "\n".join(pieces)
        marked = any(a in whole for a in self.added)
        for p in pieces:
            if not p.isascii() and max(p) >= _BEYOND or marked and any(a in p for a in self.added):
                out.append(None)
            elif p[1:].isalpha() and p[0] == " ":
                out.append(self.word(p))
            else:
                out.append(b"".join(map(self.word, _WORDS.findall(p))))
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(left, self.library([pieces[k] for k in left]) if left else [], strict=True):
            out[k] = ids
        return out

    def spaced(self, text: str) -> bytes | None:
        """A text that begins with no space and whose every space is one between others; None for another."""
        first, *rest = text.split(" ")
        found = list(map(self.pieces.get, rest))
        if None in found:
            missing = [k for k, ids in enumerate(found) if ids is None]
            unseen = list({rest[k] for k in missing})
            if any(not p or p[0].isspace() or p[-1].isspace() for p in unseen):
                return None
            if len(self.pieces) + len(unseen) > self.remembered:
                self.pieces.clear()
            ids = dict(zip(unseen, self.new([" " + p for p in unseen]), strict=True))
            self.pieces.update(ids)
            for k in missing:
                found[k] = ids[rest[k]]
        if not first or first[-1].isspace():
            return None
        return b"".join([*self.new([first]), *found])

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self.library([text])[0]
        out, at = [], 0
        while at < len(text):
            cut = _SAFE.search(text, at + CHUNK) if at + CHUNK < len(text) else None
            end = cut.start() if cut else len(text)
            # a part behind a cut begins with its space
            ids = self.spaced(text[at:end]) if not at else self.spaced("x" + text[at:end])
            if ids is None:
                out += self.new(_SAFE.split(text[at:end]))
            else:
                out.append(ids if not at else ids[len(self.new(["x"])[0]) :])
            at = end
        return b"".join(out)


_encoder: tuple[int, Encoder] | None = None


def encoder(json: str) -> Encoder:
    """This worker's encoder, kept over tasks."""
    global _encoder
    key = zlib.crc32(json.encode())
    if _encoder is None or _encoder[0] != key:
        _encoder = (key, Encoder(json))
    return _encoder[1]


class Bins(NamedTuple):
    """``number`` bins that hold the same lengths, longest first; (length, how many) pairs."""

    number: int
    lengths: list[tuple[int, int]]


def tightest_two(lengths: np.ndarray, counts: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
    """The two documents whose lengths sum to the most in (``least``, ``most``], the longer as long as possible."""
    lengths, counts = lengths[counts > 0], counts[counts > 0]
    if not len(lengths):
        return None
    own = np.arange(len(lengths))
    other = np.minimum(np.searchsorted(lengths, most - lengths, "right") - 1, np.where(counts > 1, own, own - 1))
    sums = np.where(other >= 0, lengths + lengths[np.maximum(other, 0)], 0)
    k = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return (int(lengths[k]), int(lengths[other[k]])) if sums[k] > least else None


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[Bins]:
    """Bins for ``counts[length]`` documents of each length, as if decided one bin after the other."""
    lengths = np.array(sorted(n for n, c in counts.items() if c > 0), np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], np.int64)
    if len(lengths) and not 0 < lengths[0] <= lengths[-1] <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    while len(lengths):
        used, gap, below = np.zeros_like(left), capacity, len(lengths)
        while gap and (below := min(below, int(np.searchsorted(lengths, gap, "right")))):
            below -= 1
            used[below] = min(left[below], gap // lengths[below])
            gap -= int(used[below] * lengths[below])
        need, final = used.copy(), used.copy()
        smallest = int(np.flatnonzero(used)[0])
        if gap and (two := tightest_two(lengths, left - used, int(lengths[smallest]), gap + int(lengths[smallest]))):
            final[smallest] -= 1
            for n in two:
                need[np.searchsorted(lengths, n)] += 1
                final[np.searchsorted(lengths, n)] += 1
        taken = np.flatnonzero(final)
        # the greedy choice, and the two, stay the same while each length has as many left as this bin looked at
        number = int(((left[taken] - need[taken]) // final[taken]).min()) + 1
        yield Bins(number, [(int(lengths[k]), int(final[k])) for k in taken[::-1]])
        left = left - number * final
        lengths, left = lengths[left > 0], left[left > 0]


class Places:
    """Where the n-th document of a length goes: ranges of n, each with a first sequence, documents a bin and an offset."""

    def __init__(self, bins: Iterator[Bins]) -> None:
        rows, taken, sequence = [], {}, 0
        for b in bins:
            offset = 0
            for length, many in b.lengths:
                rows.append((length << NUMBER_BITS | taken.get(length, 0), many, sequence, offset))
                taken[length] = taken.get(length, 0) + many * b.number
                offset += length * many
            sequence += b.number
        self.sequences = sequence
        self.keys, self.many, self.first, self.offset = (np.array(c, np.int64) for c in (zip(*sorted(rows), strict=True) if rows else ((), (), (), ())))

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each document."""
        wanted = length << NUMBER_BITS | number
        k = np.searchsorted(self.keys, wanted, "right") - 1
        nth, many = wanted - self.keys[k], self.many[k]
        return self.first[k] + nth // many, self.offset[k] + nth % many * length


def pieces_of(ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or pieces of the capacity behind a first one with the rest."""
    first = (ids - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, ids, capacity))]


OWN = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep: list[str], text: str, ids: bool) -> DataFrame:
    """Each document's pieces, with ``part`` (the task) and ``nth`` (how many pieces of this length the task made before)."""
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row") if keep else F.lit(None).cast("string").alias("row"), F.spark_partition_id().alias("part"), docs[text].alias("text"))
    own = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("nth", T.LongType())]
    schema = T.StructType([source.schema["row"], *(T.StructField(n, t) for n, t in own)] + ([T.StructField("ids", T.BinaryType())] if ids else []))
    model = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, end = encoder(model.value), np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, out = [], []
            for k, t in enumerate(batch.column(2)):
                found = memoryview(enc.encode(t.as_py() or "") + end)
                for p, (start, length) in enumerate(pieces_of(len(found) // 4, capacity)):
                    part = found[4 * start : 4 * (start + length)]
                    out.append((p, start, length, zlib.crc32(part), int(seen[length])) + ((bytes(part),) if ids else ()))
                    seen[length] += 1
                    row.append(k)
            piece, start, length, crc, nth, *more = zip(*out, strict=True) if out else [()] * (6 if ids else 5)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column(1).take(row), pa.array(nth, pa.int64()), *(pa.array(x, pa.binary()) for x in more)], names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep: list[str] | None = None, text: str = "text", ids: bool = False) -> DataFrame:
    """A row a piece: ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``, and ``ids`` on request.

    ``tokenizer`` is the text of a tokenizer's JSON file. Null texts are empty and, like empty ones, one end id. Documents
    beyond the capacity, however long, are cut into pieces of the capacity, the first shorter. Every row is a document,
    whether ids or texts repeat or are null; ties of length change nothing but which document comes first. An empty table has no pieces. Of
    the columns to ``keep`` (all but the text, if None) those named like a result are left out.
    """
    bound_batches(docs.sparkSession, 500)
    keep = [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c.lower() not in OWN]
    made = saved(tokenized(docs, tokenizer, capacity, end_id, keep, text, ids), "pack-pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(made.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    # one row a length: at most ``capacity``
    found = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    places = docs.sparkSession.sparkContext.broadcast(Places(best_two_fit({r.length: r.n for r in found}, capacity)))
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = made.join(bases, ["part", "length"]).select("row", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"), *(["ids"] if ids else []))
    more = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*numbered.drop("number", "ids").schema.fields, *more, *([numbered.schema["ids"]] if ids else [])])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places.value.of(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x) for x in at), *batch.columns[6:]], names=schema.names)

    placed = numbered.mapInArrow(place, schema)
    return placed.select(*(F.col(f"row.`{c}`") for c in keep), *(c for c in OWN if c in placed.columns))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of ``pack(..., ids=True)``: ``sequence_id``, ``ids`` (little-endian unsigned 32-bit) and ``starts``, where each document begins. A sequence holds at most the capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    parts = packed.groupBy("sequence_id").agg(inside.alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.col("parts.offset").alias("starts"))
