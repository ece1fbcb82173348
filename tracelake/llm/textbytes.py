"""Vectorised work on the UTF-8 bytes of Arrow string columns: lines, words and 64-bit hashes.

Everything here works on *pieces*: runs of whole rows holding about ``PIECE_BYTES`` of text, so
temporaries stay small whatever the size of an Arrow batch. One very long row is a piece of its own.
Null texts count as empty. All hashes are fixed functions of the bytes, alike in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INV = pow(_STEP, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: byte -> byte with A-Z lowered
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: \x20 and \x09-\x0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~IS_SPACE
#: lowered bytes outside \x00-\x2F, \x3A-\x60 and \x7B-\x7F
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = True
IS_ALNUM[97:123] = True
IS_ALNUM[128:] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h.astype(_U) + _U((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, step in enumerate((_STEP, _STEP_INV)):
            p = np.full(size, _U(step))
            p[0] = _U(1)
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Piece:
    """Rows ``first`` to ``last`` (exclusive) of a batch: their bytes, and where each row starts in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
        self.data, self.offsets, self.first, self.last = data, offsets, first, last

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE_BYTES) -> Iterator[Piece]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield Piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j)
        i = j


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True, which never cross a row's border."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[inner - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    p, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def hash_windows(words: np.ndarray, starts: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A hash of ``length`` consecutive word hashes from each start."""
    h = np.zeros(len(starts), _U)
    for k in range(length):
        h = mix(h * _U(_STEP) + words[starts + k], seed)
    return h


def code_points_before(data: np.ndarray) -> np.ndarray:
    """At each byte position, the code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def lines(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; every row has one line more than newlines."""
    breaks = np.flatnonzero(piece.data == 10)
    starts = np.concatenate([piece.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, piece.offsets[1:]])
    rows = np.arange(len(piece.offsets) - 1)
    of_break = np.searchsorted(piece.offsets, breaks, side="right") - 1
    # a break's row is the last row that starts at or before it, so empty rows get none
    order = np.lexsort((starts, np.concatenate([rows, of_break])))
    row = np.concatenate([rows, of_break])[order]
    end_order = np.lexsort((ends, np.concatenate([of_break, rows])))
    return starts[order], ends[end_order], row


def strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without spaces at their ends; spans of spaces become empty."""
    solid = np.flatnonzero(NOT_SPACE[data])
    if not len(solid):
        return starts, starts.copy()
    first, past = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    s = np.where(first < past, solid[np.minimum(first, len(solid) - 1)], starts)
    e = np.where(first < past, solid[np.maximum(past - 1, 0)] + 1, s)
    return s, e


def words(piece: Piece, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of member bytes; pass bytes lowered if case is not to count."""
    starts, ends = runs(member[piece.data], piece.offsets)
    return starts, ends, piece.row_of(starts)


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted list of row numbers, with the end as last."""
    return np.searchsorted(rows, np.arange(n + 1))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
