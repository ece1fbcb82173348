"""Substring dedup over sliding spans of sentences.

Words are runs without white space, A-Z lowered for comparing. A sentence ends behind a word that ends
with ``.``, ``!`` or ``?`` (closing quotes and brackets may follow), and at a line's end. Sentences of at most
``long_words`` words are never cut; longer ones (lists, tables, text without stops) are cut before every
word whose hash is a multiple of ``CUT_ONE_IN``, so that copies fall into step wherever they begin. From
every sentence the span of at least ``run`` consecutive sentences and at least ``min_words`` words is hashed,
to 128 bits. Of equal spans, anywhere in the corpus, the one with the smallest document and place stays;
the sentences that any other one covers are removed.

A task decides by itself which of its own equal spans are not first, and sends each span once; so a
passage in a third of all documents costs one posting a task. Postings move packed, sliced by hash.
What is to be removed is a list of places a document, bounded by its text; it is joined to the texts
by document, the same way at every size.

Edge cases: null and empty texts have no sentences and stay; rows with a null doc_id are neither
compared nor changed (ids are integers, or text that casts to them); rows that repeat a doc_id with the
same text are one document and share its fate (with other texts: told apart by a hash of the text); other
columns pass through; columns called ``n_sentences`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .nearjoin import _joined, _packed, _sliced
from .sparkio import bound_batches, saved, slices

FLUSH = 1 << 18
SLICE = 1 << 19
LONG_WORDS = 60
CUT_ONE_IN = 4
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]}")] = True


def sentences(piece: tb.Piece, long_words: int) -> tuple[np.ndarray, ...]:
    """Start bytes, rows and first words of all sentences, each row's first sentence, and the words' hashes and rows."""
    data, n = tb.LOWER[piece.data], piece.last - piece.first
    starts, ends, row = tb.words(tb.Piece(data, piece.offsets, piece.first, piece.last), tb.NOT_SPACE)
    m = len(starts)
    if not m:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(n + 1, np.int64), none.astype(np.uint64), row
    last = data[ends - 1]
    before = data[np.maximum(ends - 2, starts)]
    stops = _END[last] | (_CLOSE[last] & _END[before])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(m, bool)
    new[1:] = stops[:-1] | (lines[starts[1:]] > lines[starts[:-1]]) | (row[1:] != row[:-1])
    h = tb.hash_spans(data, starts, ends)
    sizes = np.diff(np.append(np.flatnonzero(new), m))
    new |= np.repeat(sizes > long_words, sizes) & (h % np.uint64(CUT_ONE_IN) == 0)
    first = np.flatnonzero(new)
    return starts[first], row[first], first, tb.bounds(row[first], n), h, row


def span_hashes(first: np.ndarray, row: np.ndarray, at: np.ndarray, words: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Of every sentence that begins a span: its number, the end of the span (exclusive), and the span's two hashes."""
    k = len(first)
    if not k:
        return first, first, words, words
    ends = np.append(first[1:], len(words))  # words past each sentence
    past = np.maximum(np.arange(k) + run, np.searchsorted(ends, first + min_words) + 1)
    fits = np.flatnonzero(past <= at[row + 1])
    past = past[fits]
    # polynomials over word hashes, like that over bytes
    p, inverse = tb._power(len(words) + 1)
    a, z = first[fits], ends[past - 1]
    both = []
    for w, seed in ((words, 51), (tb.mix(words, 52), 53)):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(w * p[: len(words)], out=total[1:])
        both.append(tb.mix((total[z] - total[a]) * inverse[a] + (z - a).astype(np.uint64), seed))
    return fits, past, *both


def text_hash(piece: tb.Piece) -> np.ndarray:
    return tb.hash_spans(piece.data, piece.offsets[:-1], piece.offsets[1:]).view(np.int64)


NAMES = ("slice", "hashes", "seconds", "docs", "texts", "places", "pasts", "lost")
KINDS = dict(zip(NAMES[1:7], (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32), strict=True))


def repeated_spans(docs: DataFrame, run: int, min_words: int, long_words: int, spans: int) -> DataFrame:
    """``doc_id``, ``text_hash`` and packed (first, past) sentence numbers of its spans that are not first."""
    n_slices = slices(spans, SLICE)

    def losers(h: np.ndarray, g: np.ndarray, d: np.ndarray, t: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by hashes, document, text and place, and which in it repeats an earlier one."""
        order = np.lexsort((i, t, d, g, h))
        return order, np.append(False, (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])) if len(h) else np.zeros(0, bool)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            h, g, d, t, i, z = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, again = losers(h, g, d, t, i)
            h, g, d, t, i, z = (x[order] for x in (h, g, d, t, i, z))
            # the same place of a repeated row is no other occurrence
            same = np.append(False, again[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (i[1:] == i[:-1]))
            lead = np.maximum.accumulate(np.where(~again, np.arange(len(h)), 0))
            own = (d == d[lead]) & (t == t[lead]) & (i == i[lead])
            lost, keep = again & ~own & ~same, ~again
            rows = [(*r, b"") for r in _sliced(h[keep], n_slices, *(x[keep] for x in (h, g, d, t, i, z)))]
            rows += [(k, b"", b"", *r, b"1") for k, *r in _sliced(d[lost].view(np.uint64), n_slices, *(x[lost] for x in (d, t, i, z)))]
            return _packed(rows, list(NAMES))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for piece in tb.pieces(batch.column(1)):
                _, row, first, at, words, _ = sentences(piece, long_words)
                fits, past, h, g = span_hashes(first, row, at, words, run, min_words)
                if len(fits):
                    r = row[fits]
                    held.append((h, g, ids[piece.first + r], text_hash(piece)[r], (fits - at[r]).astype(np.int32), (past - at[r]).astype(np.int32)))
                    count += len(h)
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.equal(pa.compute.binary_length(table["lost"]), 0))
        done = table.filter(pa.compute.greater(pa.compute.binary_length(table["lost"]), 0))
        h, g, d, t, i, z = (_joined(own[c], KINDS[c]) for c in NAMES[1:7])
        order, again = losers(h, g, d, t, i)
        d, t, i, z = (x[order] for x in (d, t, i, z))
        if len(h):
            lead = np.maximum.accumulate(np.where(~again, np.arange(len(d)), 0))
            again &= (d != d[lead]) | (t != t[lead]) | (i != i[lead])
        d, t, i, z = (np.concatenate([x[again], _joined(done[c], KINDS[c])]) for x, c in zip((d, t, i, z), NAMES[3:7], strict=True))
        return pa.Table.from_batches([_packed(list(_sliced(d.view(np.uint64), n_slices, d, t, i, z)), ["bucket", *NAMES[3:7]])])

    def by_document(table: pa.Table) -> pa.Table:
        d, t, i, z = (_joined(table[c], KINDS[c]) for c in NAMES[3:7])
        order = np.lexsort((i, t, d))
        d, t, i, z = (x[order] for x in (d, t, i, z))
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts, len(d))[1:]
        packed = [np.column_stack([i[a:b], z[a:b]]).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.table({"doc_id": d[starts], "text_hash": t[starts], "spans": pa.array(packed, pa.binary())})

    schema = "slice int, " + ", ".join(f"{n} binary" for n in NAMES[1:])
    # by the number of slices, whatever the session's number of shuffle partitions
    lost = docs.mapInArrow(emit, schema).repartition(n_slices, "slice").groupBy("slice").applyInArrow(merge, "bucket int, docs binary, texts binary, places binary, pasts binary")
    return lost.repartition(n_slices, "bucket").groupBy("bucket").applyInArrow(by_document, "doc_id bigint, text_hash bigint, spans binary")


def remove_repeated_spans(docs: DataFrame, run: int = 2, min_words: int = 20, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents with the sentences kept as ``text``, and ``n_sentences`` (before) and ``n_removed``."""
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    docs = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    low = [c.lower() for c in names]
    at_text = low.index("text")
    source = docs.withColumn("key_id", F.col(f"c{low.index('doc_id')}").cast("bigint"))
    known = source.where("key_id IS NOT NULL").select("key_id", F.col(f"c{at_text}").alias("text"))
    octets = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lost = saved(repeated_spans(known, run, min_words, long_words, octets // 48), "repeated-spans")

    keyed_names = [*source.columns, "key_text"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.concatenate([text_hash(p) for p in tb.pieces(batch.column(at_text))]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], names=keyed_names)

    keyed = source.mapInArrow(hashed, T.StructType([*source.schema.fields, T.StructField("key_text", T.LongType())]))
    joined = keyed.join(lost, (F.col("key_id") == F.col("doc_id")) & (F.col("key_text") == F.col("text_hash")), "left").select(*docs.columns, "spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, column = batch.column(len(names)).to_pylist(), batch.column(at_text)
            total, removed, kept = [], [], []
            for piece in tb.pieces(column):
                start, _, _, at, _, _ = sentences(piece, long_words)
                total += np.diff(at).tolist()
                for r in range(piece.last - piece.first):
                    if not spans[piece.first + r]:
                        removed.append(0)
                        kept.append(None)
                        continue
                    mark = np.zeros(at[r + 1] - at[r] + 1, np.int64)
                    pairs = np.frombuffer(spans[piece.first + r], np.int32).reshape(-1, 2)
                    np.add.at(mark, pairs[:, 0], 1)
                    np.add.at(mark, pairs[:, 1], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    a = start[at[r] : at[r + 1]]
                    z = np.append(a[1:], piece.offsets[r + 1])
                    raw = piece.data
                    parts = [raw[piece.offsets[r] : a[0]].tobytes()] + [raw[x:y].tobytes() for x, y in zip(a[~gone].tolist(), z[~gone].tolist(), strict=True)]
                    removed.append(int(gone.sum()))
                    kept.append(b"".join(parts).decode("utf-8", "replace"))
            columns = list(batch.columns[: len(names)])
            columns[at_text] = pa.compute.if_else(pa.array([k is not None for k in kept], pa.bool_()), pa.array(kept, column.type), column)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(clean, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "n_sentences", "n_removed")
