"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

1. Every task hashes its lines' keys into the bits they set in the once-seen filter, and into those of
   keys it met at least twice itself. Only these sparse bits, 8 bytes a distinct key, meet in the tasks
   that own a block of the filters: ``twice |= twice' | (once & once')``, ``once |= once'``. A key in two
   tasks has all its bits in the twice-seen filter, so no repeat is missed.
2. The bits set in the twice-seen filter are counted, and its blocks folded (ORed) to the size at which a
   ``FILL`` of them is set, so that about ``FILL ** 2`` of the unique lines pass as suspects, however large the corpus;
   only beyond ``filter_bits`` (256 MB, some hundred million repeated lines) does that share grow. It goes to
   all tasks. A line whose key is not in it is unique. Of suspected repeats, a 128-bit digest and the
   document's id are shuffled: exact counts of documents and the largest document decide.
3. The confirmed keys are applied to the texts: from a broadcast if they are at most
   ``broadcast_keys`` (counted first), else by joins on key and document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lowered. Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose their lines except in the
largest doc_id holding them.

Edge cases: null and empty texts are one empty line and stay as they are; rows with a null doc_id
(an integer, or text that casts to one) are neither counted nor changed; rows that repeat a doc_id count as one document and share its fate;
a line repeated in one document counts once and stays or goes as a whole; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .sparkio import bound_batches, lean, saved, slices

BLOCK_BITS = 1 << 20
FILTER_BITS = 1 << 31
FILL = 0.1
FLUSH_KEYS = 1 << 19
BROADCAST_KEYS = 500_000


def _keys(piece: tb.Piece, min_chars: int) -> tuple[np.ndarray, ...]:
    """Lowered bytes; start, end and row of all lines; stripped start and end, hash and number of those long enough."""
    data = tb.LOWER[piece.data]
    starts, ends, rows = tb.lines(piece)
    s, e = tb.strip(data, starts, ends)
    before = tb.code_points_before(data)
    long = np.flatnonzero(before[e] - before[s] >= min_chars)
    return data, starts, ends, rows, s[long], e[long], tb.hash_spans(data, s[long], e[long]), long


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers inside a block."""
    mask = np.uint64(BLOCK_BITS - 1)
    return h & mask, (h >> np.uint64(20)) & mask


def _block(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n_blocks)).astype(np.int64)


def _sparse(h: np.ndarray, n_blocks: int) -> dict[int, bytes]:
    order = np.argsort(block := _block(h, n_blocks), kind="stable")
    at = tb.bounds(block[order], n_blocks)
    a, b = (x[order].astype(np.uint32) for x in _bits(h))
    return {k: np.concatenate([a[at[k] : at[k + 1]], b[at[k] : at[k + 1]]]).tobytes() for k in np.unique(block).tolist()}


def twice_filter(texts: DataFrame, min_chars: int, n_blocks: int, filter_bits: int) -> tuple[np.ndarray, int]:
    """The bytes of the twice-seen filter of ``n_blocks`` over the column ``text``, folded, and the number of blocks left."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            once, twice = _sparse(h, n_blocks), _sparse(h[times > 1], n_blocks)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(once), pa.int32()), pa.array(list(once.values()), pa.binary()), pa.array([twice.get(k, b"") for k in once], pa.binary())], names=["block", "once", "twice"])

        for batch in batches:
            for piece in tb.pieces(batch.column(0)):
                held.append(_keys(piece, min_chars)[6])
                count += len(held[-1])
                if count >= FLUSH_KEYS:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict = defaultdict(lambda: np.zeros(BLOCK_BITS, bool))
        twice: dict = {}
        for batch in batches:
            for k, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits, own = np.frombuffer(o, np.uint32), np.frombuffer(t, np.uint32)
                again = bits[once[k][bits]]
                once[k][bits] = True
                if len(again) or len(own):
                    seen = twice.setdefault(k, np.zeros(BLOCK_BITS, bool))
                    seen[again] = True
                    seen[own] = True
        for k, seen in twice.items():
            at = np.flatnonzero(seen).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([at.tobytes()], pa.binary())], names=["block", "n_set", "bits"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            for k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k not in seen:
                    seen[k] = np.zeros(BLOCK_BITS, bool)
                seen[k][np.frombuffer(b, np.uint32)] = True
        for k, bits in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    sparse = texts.select("text").mapInArrow(lean(partial), "block int, once binary, twice binary").repartition(slices(n_blocks, 32), "block").mapInArrow(lean(merge), "block int, n_set bigint, bits binary")
    sparse = saved(sparse, "twice-seen")
    n_set = sparse.agg(F.sum("n_set")).first()[0] or 0
    n_out = min(n_blocks, slices(int(n_set / FILL), BLOCK_BITS), max(1, filter_bits // BLOCK_BITS))
    out = sparse.select((F.col("block") % n_out).alias("block"), "bits").repartition(slices(n_out, 32), "block").mapInArrow(lean(fold), "block int, bits binary")
    bits = np.zeros((n_out, BLOCK_BITS // 8), np.uint8)
    for k, b in out.toLocalIterator():
        bits[k] = np.frombuffer(b, np.uint8)
    return bits.ravel(), n_out


def _suspected(h: np.ndarray, bits: np.ndarray, n_blocks: int, n_out: int) -> np.ndarray:
    base = (_block(h, n_blocks) % n_out) * BLOCK_BITS
    ok = np.ones(len(h), bool)
    for b in _bits(h):
        at = base + b.astype(np.int64)
        ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_keys(docs: DataFrame, bits: object, n_blocks: int, n_out: int, min_chars: int, min_docs: int) -> DataFrame:
    """Each confirmed key's digest and the document that keeps it, from exact counts over the suspected lines."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = bits.value
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), {}
            for piece in tb.pieces(batch.column(1)):
                data, _, _, rows, s, e, h, long = _keys(piece, min_chars)
                ok = np.flatnonzero(_suspected(h, filter_, n_blocks, n_out))
                for a, z, r in zip(s[ok].tolist(), e[ok].tolist(), rows[long[ok]].tolist(), strict=True):
                    if (doc := ids[piece.first + r]) is not None:
                        held.setdefault(_digest(data[a:z].tobytes()), set()).add(doc)
            # of one key no more than the min_docs largest documents of a batch matter
            flat = [(k, d) for k, ds in held.items() for d in (ds if len(ds) <= min_docs else sorted(ds)[-min_docs:])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in flat], pa.binary()), pa.array([d for _, d in flat], pa.int64())], names=["key", "doc_id"])

    found = docs.select("doc_id", "text").mapInArrow(lean(suspects), "key binary, doc_id bigint")
    return found.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("kept_in")).where(F.col("n_docs") >= min_docs)


def _clean(ids: list, column: pa.Array, min_chars: int, filter_: np.ndarray, n_blocks: int, n_out: int, goes) -> tuple[list, list, list]:
    n_lines, n_dropped, kept = [], [], []
    for piece in tb.pieces(column):
        data, starts, ends, rows, s, e, h, long = _keys(piece, min_chars)
        drop = np.zeros(len(starts), bool)
        ok = np.flatnonzero(_suspected(h, filter_, n_blocks, n_out))
        for a, z, line in zip(s[ok].tolist(), e[ok].tolist(), long[ok].tolist(), strict=True):
            row = piece.first + int(rows[line])
            if ids[row] is not None and goes(row, _digest(data[a:z].tobytes())):
                drop[line] = True
        at = tb.bounds(rows, piece.last - piece.first)
        n_lines += np.diff(at).tolist()
        total = np.concatenate([[0], np.cumsum(drop)])
        gone = total[at[1:]] - total[at[:-1]]
        n_dropped += gone.tolist()
        for r in range(piece.last - piece.first):
            if gone[r]:
                raw = piece.data
                kept.append(b"\n".join(raw[starts[i] : ends[i]].tobytes() for i in range(at[r], at[r + 1]) if not drop[i]).decode("utf-8", "replace"))
            else:
                kept.append(None)
    return n_lines, n_dropped, kept


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, filter_bits: int = FILTER_BITS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The documents with their kept lines as ``text``, and ``n_lines`` and ``n_dropped``. Other columns stay; of these two names only the new ones."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    low = [c.lower() for c in names]
    at_id, at_text = low.index("doc_id"), low.index("text")
    two = docs.select(F.col(f"c{at_id}").cast("bigint").alias("doc_id"), F.col(f"c{at_text}").alias("text"))
    octets = two.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = slices(octets * 8 // max(min_chars, 8), BLOCK_BITS)
    found, n_out = twice_filter(two.where("doc_id IS NOT NULL"), min_chars, n_blocks, filter_bits)
    bits = spark.sparkContext.broadcast(found)
    confirmed = saved(repeated_keys(two, bits, n_blocks, n_out, min_chars, min_docs), "repeated-lines")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cleaned(batch: pa.RecordBatch, goes) -> pa.RecordBatch:
        columns = list(batch.columns[: len(names)])
        ids = columns[at_id].cast(pa.int64()).to_pylist()
        n_lines, n_dropped, kept = _clean(ids, columns[at_text], min_chars, bits.value, n_blocks, n_out, goes)
        changed = pa.array([k is not None for k in kept])
        columns[at_text] = pyarrow.compute.if_else(changed, pa.array(kept, columns[at_text].type), columns[at_text])
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    if confirmed.count() <= broadcast_keys:
        keep = spark.sparkContext.broadcast({bytes(k): d for k, d in confirmed.select("key", "kept_in").toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = keep.value
            for batch in batches:
                ids = batch.column(at_id).cast(pa.int64()).to_pylist()
                yield cleaned(batch, lambda row, key, ids=ids: table.get(key, ids[row]) != ids[row])

        out = docs.mapInArrow(lean(run), schema)
    else:

        def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_ = bits.value
            for batch in batches:
                ids, held = batch.column(0).to_pylist(), set()
                for piece in tb.pieces(batch.column(1)):
                    data, _, _, rows, s, e, h, long = _keys(piece, min_chars)
                    ok = np.flatnonzero(_suspected(h, filter_, n_blocks, n_out))
                    held |= {(ids[piece.first + r], _digest(data[a:z].tobytes())) for a, z, r in zip(s[ok].tolist(), e[ok].tolist(), rows[long[ok]].tolist(), strict=True)}
                held = [x for x in held if x[0] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary())], names=["doc_id", "key"])

        # a document's list is bounded by its own lines; AQE splits a key that most documents share
        lost = two.mapInArrow(lean(holders), "doc_id bigint, key binary").join(confirmed, "key").where("doc_id <> kept_in").groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
        joined = docs.join(lost.withColumnRenamed("doc_id", "lost_id"), F.col(f"c{at_id}").cast("bigint") == F.col("lost_id"), "left").select(*docs.columns, "lost")

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lost_of = [set(x or ()) for x in batch.column(len(names)).to_pylist()]
                yield cleaned(batch, lambda row, key, lost_of=lost_of: key in lost_of[row])

        out = joined.mapInArrow(lean(run_joined), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n_lines", "n_dropped")
