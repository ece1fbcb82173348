"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Tokens are runs of letters and digits (A-Z lowered) and runs of other visible characters. Features are
the hashes, into ``2**bits`` weights, of each token, of each pair of neighbours, and of each pair of
neighbours' shapes (case, length, digits or the symbol run; equal neighbours have a shape of their own). A text's feature counts, divided by its tokens,
form a sparse vector; its score is the logistic function of the vector's dot product with the weights.

Training uses at most ``max_rows`` labelled rows, the first in the order of a hash of the id, and whole
texts; features are made by the executors, and the driver runs ``epochs`` passes of FTRL-proximal over
them. Only the weights, of fixed size, go back. Scoring is one pass over the texts without a shuffle.

Edge cases: null and empty texts have the score of the intercept; null labels and labels other than
0 and 1 teach nothing; a document with both labels teaches both; without any label to learn from
the score is 0.5; repeated rows are scored alike; columns of the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .sparkio import bound_batches, unused

MAX_ROWS = 4000
BITS = 20
SCALE = 8.0
_VISIBLE = tb.NOT_SPACE & (np.arange(256) > 32) & (np.arange(256) != 127)
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = True
_LETTER[65:91] = True
_LETTER[97:123] = True
_LETTER[128:] = True


def features(piece: tb.Piece, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers with the row of each, and the tokens of each row."""
    raw, n = piece.data, piece.last - piece.first
    data = tb.LOWER[raw]
    letter = _LETTER[raw]
    s1, e1 = tb.runs(letter, piece.offsets)
    s2, e2 = tb.runs(_VISIBLE[raw] & ~letter, piece.offsets)
    starts, ends = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(starts, kind="stable")
    starts, ends, is_word = starts[order], ends[order], order < len(s1)
    row = piece.row_of(starts)
    h = tb.hash_spans(data, starts, ends)
    upper = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=upper[1:])
    digit = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 48) & (raw <= 57), out=digit[1:])
    ups, digits = upper[ends] - upper[starts], digit[ends] - digit[starts]
    shape = np.where(is_word, (np.minimum(ups, 2) + 3 * (digits > 0) + 6 * np.minimum((ends - starts) // 6, 3)).astype(np.uint64), h)
    same = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pair = tb.mix(h[same] * np.uint64(3) + h[same + 1], 2)
    shapes = tb.mix(np.where(h[same] == h[same + 1], np.uint64(1), shape[same] * np.uint64(5) + shape[same + 1]), 3)
    ids = np.concatenate([h, pair, shapes]) >> np.uint64(64 - bits)
    return ids.astype(np.int64), np.concatenate([row, row[same], row[same]]), np.bincount(row, minlength=n)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept from (feature numbers, values, label) rows, one follow-the-regularised-leader step a row."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            ids, x, label = rows[k]
            i, x = np.append(ids, size - 1), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The sample's feature vectors. ``labels`` must hold only rows to learn from."""
    chosen = labels.selectExpr("cast(doc_id AS bigint) AS doc_id", f"cast(`{label}` AS int) AS label").where("doc_id IS NOT NULL AND label IN (0, 1)").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # at most max_rows rows of two numbers are broadcast
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece in tb.pieces(batch.column(2)):
                ids, row, tokens = features(piece, bits)
                key, count = np.unique((row << bits) | ids, return_counts=True)
                at = tb.bounds(key >> bits, piece.last - piece.first)
                for r in range(piece.last - piece.first):
                    part = slice(at[r], at[r + 1])
                    out.append(((key[part] & ((1 << bits) - 1)).astype(np.int32).tobytes(), (count[part] * (SCALE / max(1, tokens[r]))).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["doc_id", "label", "ids", "x"])

    rows = sample.mapInArrow(run, "doc_id bigint, label int, ids binary, x binary").toLocalIterator()
    found = sorted(((r.doc_id, r.label, bytes(r.ids), bytes(r.x)) for r in rows))
    return [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32).astype(float), y) for _, y, i, x in found]


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: list[str] | None = None, max_rows: int = MAX_ROWS, bits: int = BITS, threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` of each document (all, if None), ``score`` (0 to 1) and ``predicted``."""
    bound_batches(docs.sparkSession)
    weights, intercept = train_ftrl(labelled_rows(docs, labels, label, max_rows, bits), bits)
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    scanned = unused(docs, "scanned")
    source = docs.select(*(f"`{c}`" for c in keep), docs["text"].alias(scanned))
    schema = T.StructType([*source.drop(scanned).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            scores = []
            for piece in tb.pieces(batch.column(len(keep))):
                ids, row, tokens = features(piece, bits)
                dot = np.bincount(row, weights=w[ids], minlength=len(tokens)) * (SCALE / np.maximum(tokens, 1)) + b
                scores.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=schema.names)

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
