"""Benchmark decontamination with training suffix arrays.

Training texts are dealt into shards (runs of rows of a few MB, never cut inside a row). Each shard
sorts its suffixes, by words, into a suffix array; every suffix of every test item is binary-searched
in it. The places found give the verbatim matches, which are then extended word by word to their full
length. A suffix that begins with no test item's first words can match nothing, so it is left out of
the array before sorting; this loses no match and keeps the array small.

Words: A-Z lowered, then maximal runs of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

Test items go to the executors in blocks of at most ``block_words`` words each; a shard is searched for
one block after another. At most ``most_blocks`` blocks are broadcast at once: a benchmark of more is
searched in several passes, each of which adds to what the rows carry of the passes before. No shuffle is
needed: every decision about a document is made where its row is.

Edge cases: null and empty texts have no words and are clean; items without words match nothing;
an empty benchmark or an empty corpus gives clean rows or none; repeated rows are decided each alone;
equal items all count; item ids are whole numbers, or anything else as text; items without an id are left out, or with ``unnamed`` searched like the others, a null in
``item_ids`` standing for all of them. Columns of the same names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .sparkio import bound_batches, lean, saved, unused

SHARD_BYTES = 1 << 22
BLOCK_WORDS = 1 << 20
MOST_BLOCKS = 4
_BITS = 20


class Block(NamedTuple):
    """Test windows, distinct and padded with 0 to ``width`` words, the number of each one's item among ``ids``, and what can start a match."""

    windows: np.ndarray
    lengths: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    ids: list
    rest: np.ndarray
    rest_at: np.ndarray
    first: np.ndarray
    pair: np.ndarray | None


def _word_hashes(piece: tb.Piece) -> tuple[np.ndarray, np.ndarray]:
    data = tb.LOWER[piece.data]
    starts, ends = tb.runs(tb.IS_ALNUM[data], piece.offsets)
    h = tb.hash_spans(data, starts, ends)
    h[h == 0] = 1  # 0 stands for the end of a text
    return h, piece.row_of(starts)


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(3) + b) >> np.uint64(64 - _BITS)


def make_block(ids: list, texts: list[str], window: int) -> Block:
    """Every window of the items, by its suffix: the words after it are kept for extending matches."""
    starts, lengths, owners, all_words, ends, base = [], [], [], [], [], 0
    for piece in tb.pieces(pa.array(texts, pa.large_string())):
        h, row = _word_hashes(piece)
        at = tb.bounds(row, piece.last - piece.first)
        all_words.append(h)
        for k in range(piece.last - piece.first):
            n = int(at[k + 1] - at[k])
            if n:
                m = max(1, n - window + 1)
                starts.append(base + at[k] + np.arange(m))
                lengths.append(np.full(m, min(n, window)))
                ends.append(np.full(m, base + at[k + 1]))
                owners.append(np.full(m, piece.first + k, np.int64))
        base += len(h)
    none = [np.zeros(0, np.int64)]
    start, length, owner, end = (np.concatenate(x or none) for x in (starts, lengths, owners, ends))
    words = np.concatenate(all_words) if all_words else np.zeros(0, np.uint64)
    columns = np.arange(window)
    windows = np.where(columns < length[:, None], words[np.minimum(start[:, None] + columns, max(len(words) - 1, 0))], np.uint64(0)) if len(start) else np.zeros((0, window), np.uint64)
    distinct, inverse = np.unique(np.column_stack([length.astype(np.uint64), windows]), axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    owner_at = np.searchsorted(inverse.ravel()[order], np.arange(len(distinct) + 1))
    windows, lengths = distinct[:, 1:], distinct[:, 0].astype(np.int64)
    first = np.zeros(1 << _BITS, bool)
    first[(windows[:, 0] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    pair = None
    if len(lengths) and lengths.min() > 1:
        pair = np.zeros(1 << _BITS, bool)
        pair[_pair_key(windows[:, 0], windows[:, 1]).astype(np.int64)] = True
    rest_len = (end - start - length)[order]
    rest = words[tb.ranges((start + length)[order], rest_len)]
    return Block(windows, lengths, owner_at, owner[order], list(ids), rest, np.concatenate([[0], np.cumsum(rest_len)]), first, pair)


class SuffixArray:
    """The suffixes of a shard that some window could begin, sorted by their first ``width`` words."""

    def __init__(self, words: np.ndarray, row: np.ndarray, n_rows: int, block: Block):
        self.words, self.row, width = words, row, block.windows.shape[1]
        self.end = tb.bounds(row, n_rows)[1:]
        at = np.flatnonzero(block.first[(words >> np.uint64(64 - _BITS)).astype(np.int64)])
        if block.pair is not None:
            at = at[(at + 1 < len(words)) & (row[np.minimum(at + 1, len(words) - 1)] == row[at])]
            at = at[block.pair[_pair_key(words[at], words[at + 1]).astype(np.int64)]]
        keys = self.suffix_words(at, width)
        order = np.lexsort(keys.T[::-1])
        self.at, self.keys = at[order], keys[order]

    def suffix_words(self, at: np.ndarray, width: int) -> np.ndarray:
        p = at[:, None] + np.arange(width)
        inside = p < self.end[self.row[at]][:, None] if len(at) else np.zeros((0, width), bool)
        return np.where(inside, self.words[np.minimum(p, max(len(self.words) - 1, 0))], np.uint64(0)) if len(at) else np.zeros((0, width), np.uint64)

    def search(self, windows: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of all windows at once: the first suffix not below (upper: above) each, by its own length."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.at), np.int64)
        used = np.arange(windows.shape[1]) < lengths[:, None]
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            have = self.keys[np.minimum(mid, len(self.at) - 1)]
            differs = (have != windows) & used
            k = differs.argmax(1)
            any_ = differs.any(1)
            i = np.arange(len(windows))
            below = np.where(any_, have[i, k] < windows[i, k], upper)
            lo = np.where(open_ & below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        return lo


def _search_shard(words: np.ndarray, row: np.ndarray, n_rows: int, block: Block) -> tuple[np.ndarray, ...]:
    """Each occurrence of a window: its word position, its length, its window; and the full length of its longest match."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(block.windows):
        return none, none, none, none
    array = SuffixArray(words, row, n_rows, block)
    if not len(array.at):
        return none, none, none, none
    lo, hi = (array.search(block.windows, block.lengths, upper) for upper in (False, True))
    found = np.flatnonzero(hi > lo)
    which = np.repeat(found, (hi - lo)[found])
    at = array.at[tb.ranges(lo[found], (hi - lo)[found])]
    length = block.lengths[which]
    # extend each match by the words that follow in the longest item behind its window
    longest = length.copy()
    for k in range(int((block.owner_at[1:] - block.owner_at[:-1])[found].max()) if len(found) else 0):
        own = block.owner_at[which] + k
        live = np.flatnonzero(own < block.owner_at[which + 1])
        own, more = own[live], np.zeros(len(live), np.int64)
        going = np.arange(len(live))
        while len(going):
            p, r = at[live[going]] + length[live[going]] + more[going], block.rest_at[own[going]] + more[going]
            ok = (p < array.end[row[at[live[going]]]]) & (r < block.rest_at[own[going] + 1])
            ok[ok] = words[p[ok]] == block.rest[r[ok]]
            going = going[ok]
            more[going] += 1
        np.maximum.at(longest, live, length[live] + more)
    return at, length, which, longest


def _fields(item: T.DataType) -> list[T.StructField]:
    return [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(item)),
        T.StructField("longest_words", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("contaminated", T.BooleanType()),
    ]


class Found(NamedTuple):
    """What a row's passes have found: words, hit runs as packed (start, past), items, longest match and its place (-1: none)."""

    n_words: int
    hits: bytes
    items: set
    longest: int
    at: int


def _scan(column: pa.Array, blocks: list, shard_bytes: int, before: list[Found] | None) -> list[Found]:
    out: list[Found] = []
    for piece in tb.pieces(column, shard_bytes):
        n = piece.last - piece.first
        h, row = _word_hashes(piece)
        at_row = tb.bounds(row, n)
        marks = np.zeros(len(h) + 1, np.int64)
        earlier = before[piece.first : piece.last] if before else [Found(0, b"", set(), 0, -1)] * n
        found: list[set] = [set(f.items) for f in earlier]
        best, best_at = np.array([f.longest for f in earlier], np.int64), np.array([f.at for f in earlier], np.int64)
        for r, f in enumerate(earlier):
            if f.hits:
                runs = np.frombuffer(f.hits, np.int32).reshape(-1, 2)
                np.add.at(marks, at_row[r] + runs[:, 0], 1)
                np.add.at(marks, at_row[r] + runs[:, 1], -1)
        for b in blocks:
            block = b.value
            at, length, which, full = _search_shard(h, row, n, block)
            if len(at):
                np.add.at(marks, at, 1)
                np.add.at(marks, at + length, -1)
                order = np.lexsort((at, -full))
                rows, firsts = np.unique(row[at[order]], return_index=True)
                o = order[firsts]
                place = (at[o] - at_row[rows]).astype(np.int64)
                better = (full[o] > best[rows]) | ((full[o] == best[rows]) & (place < best_at[rows]))
                best[rows[better]], best_at[rows[better]] = full[o][better], place[better]
                pairs = np.unique(np.column_stack([row[at], which]), axis=0)
                for r, w in pairs.tolist():
                    found[r].update(block.ids[i] for i in block.owners[block.owner_at[w] : block.owner_at[w + 1]].tolist())
        inside = np.cumsum(marks[:-1]) > 0
        for r in range(n):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[at_row[r] : at_row[r + 1]], [False]]).astype(np.int8)))
            out.append(Found(int(at_row[r + 1] - at_row[r]), edge.astype(np.int32).tobytes(), found[r], int(best[r]), int(best_at[r])))
    return out


def benchmark_blocks(benchmark: DataFrame, item_type: T.DataType, window: int = 10, block_words: int = BLOCK_WORDS, item: str = "item_id", text: str = "text", unnamed: bool = False) -> Iterator:
    """Blocks of the test items, at most ``block_words`` words each (or one longer item), read through the driver one at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(f"`{item}`").cast(item_type), F.col(f"`{text}`").cast("string")).where(f"`{text}` IS NOT NULL" + ("" if unnamed else f" AND `{item}` IS NOT NULL"))
    for i, t in rows.toLocalIterator():
        if ids and size + len(t) // 2 + 1 > block_words:
            yield make_block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t) // 2 + 1
    if ids:
        yield make_block(ids, texts, window)


def _passes(blocks: Iterator, most: int) -> Iterator[tuple[list, bool]]:
    """Groups of at most ``most`` blocks, and whether each is the last; one empty group if there are no blocks."""
    group: list = []
    for block in blocks:
        if len(group) == most:
            yield group, False
            group = []
        group.append(block)
    yield group, True


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, text: str = "text", shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS, unnamed: bool = False) -> DataFrame:
    """The columns ``keep`` of each document (all, if None), and its words, hit words, items with a window in it, longest verbatim match and where that begins (in words). ``unnamed``: items without an id count too."""
    if window < 1:
        raise ValueError("window must be at least 1")
    spark = docs.sparkSession
    item_type = T.LongType() if isinstance(benchmark.schema["item_id"].dataType, T.IntegralType) else T.StringType()
    fields = _fields(item_type)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    bound_batches(spark)
    scanned, state = unused(docs, "scanned"), ("hits", "items", "longest", "at")
    source = docs.select(*(f"`{c}`" for c in keep), docs[text].alias(scanned))
    carried = T.StructType([*source.schema.fields, *(T.StructField(unused(docs, f"found_{n}"), t) for n, t in zip(state, (T.BinaryType(), T.ArrayType(item_type), T.LongType(), T.LongType()), strict=True))])
    final = T.StructType(source.drop(scanned).schema.fields + fields)
    arrow_item = pa.int64() if item_type == T.LongType() else pa.string()
    ordered = lambda items: sorted(items - {None}) + [None] * (None in items)

    def pass_over(rows: DataFrame, group: list, first: bool, last: bool) -> DataFrame:
        blocks = [spark.sparkContext.broadcast(b) for b in group]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = None
                if not first:
                    before = [Found(0, h, set(i), n, a) for h, i, n, a in zip(*(batch.column(len(keep) + 1 + k).to_pylist() for k in range(4)), strict=True)]
                found = _scan(batch.column(len(keep)), blocks, shard_bytes, before)
                items = pa.array([ordered(f.items) for f in found], pa.list_(arrow_item))
                if last:
                    n_hit = [int((np.frombuffer(f.hits, np.int32).reshape(-1, 2) @ np.array([-1, 1])).sum()) for f in found]
                    arrays = [pa.array([f.n_words for f in found], pa.int64()), pa.array(n_hit, pa.int64()), items, pa.array([f.longest for f in found], pa.int64()), pa.array([None if f.at < 0 else f.at for f in found], pa.int64()), pa.array([bool(f.hits) for f in found], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=final.names)
                else:
                    arrays = [pa.array([f.hits for f in found], pa.binary()), items, pa.array([f.longest for f in found], pa.int64()), pa.array([f.at for f in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *arrays], names=carried.names)

        return rows.mapInArrow(lean(run), final if last else carried)

    first = True
    for group, last in _passes(benchmark_blocks(benchmark, item_type, window, block_words, text=text, unnamed=unnamed), most_blocks):
        source = pass_over(source, group, first, last)
        if not last:
            source, first = saved(source, "contamination"), False
    return source


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, unnamed: bool = False) -> DataFrame:
    """The documents in which no window of a test item occurs, with their own columns."""
    columns = docs.columns
    marked = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(columns)))
    at = [c.lower() for c in columns].index("text")
    scanned = find_contamination(marked.withColumnRenamed(f"c{at}", "text"), benchmark, window, unnamed=unnamed)
    return scanned.where("NOT contaminated").select(*(scanned["text" if i == at else f"c{i}"].alias(c) for i, c in enumerate(columns)))


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
