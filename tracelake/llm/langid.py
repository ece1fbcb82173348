"""Language identification with a bidirectional gated recurrent network over bytes.

One network reads a text's bytes forwards and one backwards; both states together label every byte. A
document's probabilities are the means over all its bytes; the language of the largest wins, and that mean
is the score. To be read in parallel, texts are cut into windows of ``WINDOW`` bytes, but no window begins
blank: the forward network has read the ``CONTEXT`` bytes before it and the backward one those behind it
(all there are, near a text's ends), so states, words and characters go on across the cuts. Memory stays
bounded whatever a text's length.

Training, in numpy on the driver by backpropagation through time, uses for each language at most
``rows_per_lang`` rows, chosen by a hash of the id, and of each at most ``WINDOWS_PER_ROW`` windows of ``TAUGHT``
bytes spread over the whole text. Every language found is learnt; beyond ``STEP_LANGS`` the training takes more steps in
proportion. The network's few thousand numbers are broadcast. Prediction is one pass over the
whole texts without a shuffle.

Edge cases: texts that are null or hold no letter (Unicode) are ``und`` with score 0; so is every text
if there is nothing to learn from; ties go to the language first in byte order; null languages teach
nothing; repeated rows are alike; columns of the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .sparkio import bound_batches, lean, unused

WINDOW = 128
CONTEXT = 32
HIDDEN = 12
TAUGHT = 64
ROWS_PER_LANG = 400
WINDOWS_PER_ROW = 6
STEP_LANGS = 256
STEPS = 260
BATCH_WINDOWS = 4096
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = True
_ASCII_LETTER[97:123] = True


class Network(NamedTuple):
    """``inputs`` (direction, byte, 3H) with biases, ``states`` (direction, H, 3H), ``out`` (2H, labels), ``bias``; gates in the order update, reset, candidate."""

    inputs: np.ndarray
    states: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def squash(x: np.ndarray) -> np.ndarray:
    """In place, a rational sigmoid from -1 to 1, smooth and flat from 3 on; several times as fast as tanh."""
    np.clip(x, -3, 3, out=x)
    square = x * x
    x *= square + 27
    square *= 9
    square += 27
    x /= square
    return x


def squash_slope(x: np.ndarray) -> np.ndarray:
    """The derivative of ``squash`` at x."""
    square = np.minimum(x * x, 9)
    return ((9 - square) / (3 * (3 + square))) ** 2


def label_bytes(net: Network, forwards: np.ndarray, backwards: np.ndarray, unread: np.ndarray | None = None, context: int = 0) -> np.ndarray:
    """Probabilities (position, window, label). ``forwards`` and ``backwards`` (step, window) hold the bytes in reading order, ``context`` of them before the window; ``unread`` (direction, step, window, 1) marks steps that leave the state alone, None if there are none."""
    length, n = forwards.shape
    size = net.states.shape[1]
    seen = np.empty((2, length - context, n, size), np.float32)
    read = None if unread is None else (~unread).astype(np.float32)
    gates, recurrent, c, uc = (np.empty((n, k * size), np.float32) for k in (2, 2, 1, 1))
    for d, columns in enumerate((forwards, backwards)):
        # update and reset gates are squash(x / 2) / 2 + 1 / 2
        gate_in, cand_in = np.ascontiguousarray(net.inputs[d][:, : 2 * size]) / 2, np.ascontiguousarray(net.inputs[d][:, 2 * size :])
        gate_state, cand_state = np.ascontiguousarray(net.states[d][:, : 2 * size]) / 2, np.ascontiguousarray(net.states[d][:, 2 * size :])
        h = np.zeros((n, size), np.float32)
        for t in range(length):
            np.take(gate_in, columns[t], axis=0, out=gates, mode="clip")
            np.take(cand_in, columns[t], axis=0, out=c, mode="clip")
            gates += np.matmul(h, gate_state, out=recurrent)
            squash(gates)
            gates *= 0.5
            gates += 0.5
            np.matmul(h, cand_state, out=uc)
            uc *= gates[:, size:]
            c += uc
            squash(c)
            c -= h
            c *= gates[:, :size]
            if unread is not None:
                c *= read[d, t]
            h += c
            if t >= context:
                seen[d, t - context if d == 0 else length - 1 - t] = h
    logits = seen[0].reshape(-1, size) @ net.out[:size]
    logits += seen[1].reshape(-1, size) @ net.out[size:]
    logits += net.bias
    np.exp(logits, out=logits)  # the states are within -1 and 1, so sums stay small
    logits /= logits.sum(1, keepdims=True)
    return logits.reshape(length - context, n, -1)


def gradients(net: Network, windows: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    n, length = windows.shape
    size = net.states.shape[1]
    order = np.stack([np.arange(length), np.arange(length)[::-1]])
    kind = net.states.dtype
    h, inside = np.zeros((2, n, size), kind), inside.astype(kind)
    past, z_, r_, c_, uc_, gs_, cs_ = ([None] * length for _ in range(7))
    seen = np.zeros((2, length, n, size), kind)
    for t in range(length):
        a = np.stack([net.inputs[d][windows[:, order[d, t]]] for d in (0, 1)])
        m = np.stack([inside[:, order[d, t]] for d in (0, 1)])[:, :, None]
        u = h @ net.states
        gate_in = (a[:, :, : 2 * size] + u[:, :, : 2 * size]) / 2
        gates = squash(gate_in.copy()) / 2 + 0.5
        z, r = gates[:, :, :size] * m, gates[:, :, size:]
        c_in = a[:, :, 2 * size :] + r * u[:, :, 2 * size :]
        c = squash(c_in.copy())
        past[t], z_[t], r_[t], c_[t], uc_[t] = h, z, r, c, u[:, :, 2 * size :]
        gs_[t], cs_[t] = squash_slope(gate_in) / 4, squash_slope(c_in)
        h = h + z * (c - h)
        for d in (0, 1):
            seen[d, order[d, t]] = h[d]
    both = np.concatenate([seen[0], seen[1]], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    weight = inside.T / max(kind.type(1), inside.sum())
    loss = -(np.log(p[:, np.arange(n), labels] + 1e-12) * weight).sum()
    p[:, np.arange(n), labels] -= 1
    p *= weight[:, :, None]
    g_out = np.tensordot(both, p, ([0, 1], [0, 1]))
    g_seen = p @ net.out.T
    g_in, g_state = np.zeros_like(net.inputs), np.zeros_like(net.states)
    dh, da_ = np.zeros((2, n, size), kind), np.empty((2, length, n, 3 * size), kind)
    for t in reversed(range(length)):
        dh = dh + np.stack([g_seen[order[d, t]][:, d * size : (d + 1) * size] for d in (0, 1)])
        h, z, r, c, uc = past[t], z_[t], r_[t], c_[t], uc_[t]
        m = np.stack([inside[:, order[d, t]] for d in (0, 1)])[:, :, None]
        dz = dh * (c - h) * gs_[t][:, :, :size] * m
        dc = dh * z * cs_[t]
        dr = dc * uc * gs_[t][:, :, size:]
        da = np.concatenate([dz, dr, dc], axis=2)
        du = np.concatenate([dz, dr, dc * r], axis=2)
        for d in (0, 1):
            da_[d, order[d, t]] = da[d]
        g_state += h.transpose(0, 2, 1) @ du
        dh = dh * (1 - z) + du @ net.states.transpose(0, 2, 1)
    read = windows.T.ravel()
    for d in (0, 1):
        flat = da_[d].reshape(-1, 3 * size)
        for k in range(3 * size):
            g_in[d][:, k] = np.bincount(read, weights=flat[:, k], minlength=256)
    return float(loss), Network(g_in, g_state, g_out, p.sum((0, 1)))


def train(windows: np.ndarray, inside: np.ndarray, labels: np.ndarray, n_labels: int, hidden: int = HIDDEN, steps: int = STEPS, batch: int = 96, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam over random batches in which every label is as likely; the rate falls to a tenth."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (2, 256, 3 * hidden)), rng.normal(0, 0.6 / np.sqrt(hidden), (2, hidden, 3 * hidden)), rng.normal(0, 0.3, (2 * hidden, n_labels)), np.zeros(n_labels))
    net = Network(*(p.astype(np.float32) for p in net))
    first, second = ([np.zeros_like(p) for p in net] for _ in range(2))
    by_label = [np.flatnonzero(labels == k) for k in range(n_labels)]
    for step in range(1, steps + 1):
        at = np.array([rng.choice(by_label[k]) for k in rng.integers(0, n_labels, batch)])
        _, grads = gradients(net, windows[at], inside[at], labels[at])
        now = rate * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(net, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def training_windows(docs: DataFrame, rows_per_lang: int) -> list[tuple[str, bytes]]:
    """Sampled (language, window) pairs, in a fixed order. ``docs`` must hold only rows to learn from."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    # uniform in the hash; twice the bound on average, cut to the bound below
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "share": pa.array([min(1.0, 2 * rows_per_lang / r["count"]) for r in counts], pa.float64())}))
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                n = -(-len(raw) // TAUGHT)
                for k in sorted({int(x) for x in np.linspace(0, max(0, n - 1), WINDOWS_PER_ROW)}) if n else []:
                    out.append((i, lang, raw[k * TAUGHT : (k + 1) * TAUGHT]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary())], names=["doc_id", "lang", "window"])

    found: dict[str, list] = {}
    for i, lang, w in chosen.mapInArrow(lean(run), "doc_id bigint, lang string, window binary").toLocalIterator():
        found.setdefault(lang, []).append((int(tb.mix(np.array([i], np.int64))[0]), i, bytes(w)))
    return [(lang, w) for lang in sorted(found) for _, _, w in sorted(found[lang])[: rows_per_lang * WINDOWS_PER_ROW]]


def as_matrix(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in windows])
    return np.frombuffer(b"".join(w.ljust(TAUGHT, b"\0") for w in windows), np.uint8).reshape(-1, TAUGHT), (np.arange(TAUGHT) < lengths[:, None]).astype(float)


def document_probabilities(net: Network, piece: tb.Piece) -> np.ndarray:
    """The mean label probabilities over all bytes of each row; zeros for rows without bytes."""
    n, lengths = piece.last - piece.first, np.diff(piece.offsets)
    size = max(1, BATCH_WINDOWS * STEP_LANGS // max(STEP_LANGS, len(net.bias)))
    total = np.zeros((n, len(net.bias)))
    count = -(-lengths // WINDOW)
    row = np.repeat(np.arange(n), count)
    starts = piece.offsets[row] + tb.ranges(np.zeros(n, np.int64), count) * WINDOW
    ends = np.minimum(starts + WINDOW, piece.offsets[row + 1])
    # windows whose every step reads a byte of the text need no marks, so they go together
    inner = (ends - starts == WINDOW) & (starts - CONTEXT >= piece.offsets[row]) & (ends + CONTEXT <= piece.offsets[row + 1])
    for whole in (True, False):
        chosen = np.flatnonzero(inner == whole)
        chosen = chosen if whole else chosen[np.argsort(starts[chosen] - ends[chosen], kind="stable")]  # like lengths together
        for k in range(0, len(chosen), size if whole else size // 4 + 1):
            w = chosen[k : k + (size if whole else size // 4 + 1)]
            longest = int((ends[w] - starts[w]).max())
            step = np.arange(-CONTEXT, longest)[:, None]
            forwards, backwards = starts[w] + step, starts[w] + longest - 1 - step
            unread = None
            if not whole:
                first, past = piece.offsets[row[w]], piece.offsets[row[w] + 1]
                unread = np.stack([(forwards < first) | (forwards >= past), (backwards < first) | (backwards >= past)])[:, :, :, None]
                forwards, backwards = (np.clip(x, 0, len(piece.data) - 1) for x in (forwards, backwards))
            p = label_bytes(net, piece.data[forwards].astype(np.intp), piece.data[backwards].astype(np.intp), unread, CONTEXT)
            if not whole:
                p *= (np.arange(longest)[:, None] < ends[w] - starts[w])[:, :, None]
            np.add.at(total, row[w], p.sum(0, dtype=float))
    return total / np.maximum(lengths, 1)[:, None]


def has_letter(piece: tb.Piece) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(_ASCII_LETTER[piece.data])])
    out = count[piece.offsets[1:]] > count[piece.offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(piece.data >= 128)])
    for r in np.flatnonzero(~out & (high[piece.offsets[1:]] > high[piece.offsets[:-1]])):
        out[r] = any(c.isalpha() for c in piece.text(r).decode("utf-8", "replace"))
    return out


def learn(learn_from: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], Network | None]:
    """The languages found in byte order, and the network that tells them; none if there is nothing to learn from."""
    sample = training_windows(learn_from, rows_per_lang)
    names = sorted({lang for lang, _ in sample}, key=str.encode)
    if not names:
        return names, None
    windows, inside = as_matrix([w for _, w in sample])
    number = {lang: k for k, lang in enumerate(names)}
    return names, train(windows, inside, np.array([number[lang] for lang, _ in sample]), len(names), steps=STEPS * -(-len(names) // STEP_LANGS))


def identify_language(docs: DataFrame, learn_from: DataFrame, keep: list[str] | None = None, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """The columns ``keep`` of each document (all, if None), ``lang_pred`` and ``score``. ``learn_from`` has doc_id, text and lang."""
    bound_batches(docs.sparkSession)
    names, net = learn(learn_from, rows_per_lang)
    model = docs.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    scanned = unused(docs, "scanned")
    source = docs.select(*(f"`{c}`" for c in keep), docs["text"].alias(scanned))
    schema = T.StructType([*source.drop(scanned).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            langs, scores = [], []
            for piece in tb.pieces(batch.column(len(keep))):
                known = has_letter(piece) if net else np.zeros(piece.last - piece.first, bool)
                p = document_probabilities(net, piece) if net else np.zeros((len(known), 1))
                langs += [names[k] if ok else "und" for k, ok in zip(p.argmax(1).tolist(), known.tolist(), strict=True)]
                scores += np.where(known, np.clip(p.max(1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(lean(run), schema)
