"""Secret scans: fixed patterns, and windows of high Shannon entropy in candidate strings.

Base kinds, leftmost and non-overlapping each: ``assign`` (a credential name, ``:`` or ``=`` and a value
of 12 characters or more), ``access`` (``AKIA`` and upper-case letters or digits, 18 or more) and ``hex``
(lower-case hex digits, 16 or more).

Method: a candidate is a maximal run of one character class, at least as long as the class's window;
each class is judged by its own window and threshold, so a hex run behind ``sig=`` is windowed as hex.
A window slides over it; its counts of symbols, and with them the sum of ``n log2 n``, change by the one
symbol that enters and the one that leaves, so each step costs the same whatever the window. Windows
whose entropy reaches the class's threshold are merged, over all classes, to spans of kind ``entropy``,
unless the candidate, or the widest run that it is in, is on the allow-list (patterns; a name and ``=``
may stand in front), or the span lies in a base span, which is already reported.

Edge cases: null and empty texts have no spans; equal spans cannot occur within a kind; spans are in
code points with an exclusive end; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes as tb
from .sparkio import bound_batches, unused

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


class CharClass(NamedTuple):
    """Candidates of one alphabet: window in characters, and least entropy in bits."""

    name: str
    alphabet: bytes
    window: int
    bits: float


#: The classes from the narrowest to the widest; each alphabet holds the ones before.
CLASSES = (
    CharClass("hex", b"0123456789abcdefABCDEF", 20, 3.0),
    CharClass("alnum", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20, 3.7),
    CharClass("base64", b"+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", 24, 4.0),
)
#: Candidates that are not secrets: UUIDs, decimal numbers, dates and times, file and web paths, and words of at most 15
#: letters, alone or joined by case or marks. A longer run of letters is no word; its entropy decides.
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+/=_-]+",
    r"[A-Z]?[a-z]{1,15}(?:[-_/=.][A-Z]?[a-z]{1,15}|[A-Z][a-z]{1,15})*[0-9]{0,4}",
    r"[A-Z]{1,15}(?:[-_/=.][A-Z]{1,15})*[0-9]{0,4}",
    r"(?:/[A-Za-z0-9_-]{0,15}){2,}",
)

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list(CLASSES[-1].alphabet)] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TERMS = [0.0] + [n * math.log2(n) for n in range(1, 4096)]


def entropy_windows(s: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy is at least ``bits``, by incremental counts."""
    if len(s) < window:
        return []
    counts, total, spans = [0] * 256, 0.0, []
    term = _TERMS if window < len(_TERMS) else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9
    for i, c in enumerate(s):
        n = counts[c]
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= window:
            c = s[i - window]
            n = counts[c]
            counts[c] = n - 1
            total += term[n - 1] - term[n]
        if i >= window - 1 and total <= most:
            a = i - window + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
    return spans


def _classes() -> list[tuple[CharClass, re.Pattern]]:
    return [(c, re.compile(b"[" + re.escape(c.alphabet) + b"]+")) for c in CLASSES]


def entropy_spans(s: bytes, classes: list[tuple[CharClass, re.Pattern]], allow: re.Pattern) -> list[tuple[int, int]]:
    """Merged spans of the windows of every class's candidates in a run of the widest class."""
    if allow.fullmatch(s):
        return []
    spans: list[tuple[int, int]] = []
    for c, p in classes:
        for m in p.finditer(s):
            if len(m[0]) >= c.window and not allow.fullmatch(m[0]):
                spans += [(m.start() + x, m.start() + y) for x, y in entropy_windows(m[0], c.window, c.bits)]
    merged: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if merged and x <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
        else:
            merged.append((x, y))
    return merged


def scan_piece(piece: tb.Piece, allow: re.Pattern) -> list[list[tuple[int, int, int]]]:
    """For each row its spans (start, end, kind number) in bytes from the row's start."""
    raw, n = piece.data, piece.last - piece.first
    whole, found = raw.tobytes(), [[] for _ in range(n)]

    def each(pattern: re.Pattern, rows) -> Iterator[tuple[int, re.Match]]:
        for r in rows:
            for m in pattern.finditer(whole, int(piece.offsets[r]), int(piece.offsets[r + 1])):
                yield r, m

    low = whole.lower()

    def rows_with(words: tuple[bytes, ...], text: bytes) -> list[int]:
        at = [m.start() for w in words for m in re.finditer(re.escape(w), text)]
        return sorted(set(piece.row_of(np.array(at, np.int64)).tolist())) if at else []

    for r, m in each(ASSIGN, rows_with((b"passw", b"secret", b"token", b"key"), low)):
        if len(m[1]) >= 12:
            found[r].append((m.start() - int(piece.offsets[r]), m.end() - int(piece.offsets[r]), 0))
    for r, m in each(ACCESS, rows_with((b"AKIA",), whole)):
        if len(m[0]) >= 18:
            found[r].append((m.start() - int(piece.offsets[r]), m.end() - int(piece.offsets[r]), 1))
    starts, ends = tb.runs(_HEX[raw], piece.offsets)
    long = ends - starts >= 16
    rows = piece.row_of(starts[long])
    for r, a, z in zip(rows.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        found[r].append((a - int(piece.offsets[r]), z - int(piece.offsets[r]), 2))

    starts, ends = tb.runs(_CANDIDATE[raw], piece.offsets)
    long = ends - starts >= min(c.window for c in CLASSES)
    starts, ends = starts[long], ends[long]
    classes = _classes()
    for r, a, z in zip(piece.row_of(starts).tolist(), starts.tolist(), ends.tolist(), strict=True):
        s, base = whole[a:z], a - int(piece.offsets[r])
        for x, y in entropy_spans(s, classes, allow):
            if not any(p <= base + x and base + y <= q for p, q, k in found[r] if k < 3):
                found[r].append((base + x, base + y, 3))
    return found


FIELDS = [T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``secrets``: kind, start and end (code points) by start, then kind."""
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "secrets"]
    scanned = unused(docs, "scanned")
    source = docs.select(*(f"`{c}`" for c in keep), docs[text].alias(scanned))
    schema = T.StructType(source.drop(scanned).schema.fields + FIELDS)
    allowed = f"(?:[A-Za-z_]{{1,15}}=)?(?:{'|'.join(f'(?:{a})' for a in allow) or '(?!)'})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(allowed.encode())
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            out = []
            for piece in tb.pieces(batch.column(len(keep))):
                before = None
                for r, spans in enumerate(scan_piece(piece, pattern)):
                    if spans and before is None:
                        before = tb.code_points_before(piece.data)
                    base = int(piece.offsets[r])
                    out.append([{"kind": KINDS[k], "start": int(before[base + a] - before[base]), "end": int(before[base + z] - before[base])} for a, z, k in sorted(spans, key=lambda x: (x[0], x[2], x[1]))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.list_(kind))], names=schema.names)

    return source.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each span, merged where they overlap, replaced by a mark."""
    out, at = [], 0
    for a, z in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join(out) + text[at:]


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()
