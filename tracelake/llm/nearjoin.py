"""Exact Jaccard join over word shingles with token-combination prefixes.

Documents are sets of shingles (64-bit hashes). Two link when ``100 * |A & B| >= percent * |A | B|``, so of a
set of ``n`` at most ``t = n - ceil(percent * n / 100)`` shingles can be missing from a partner.

1. Equal sets are one class, kept as its smallest document; its copies are never paired.
2. Filter: each document shows the ``t + l`` smallest hashes of its set, its extended prefix. Of two linked
   documents one has at least ``l`` of them in the other's prefix, so a document with fewer of them in any
   other document has no partner. A hash that repeats within a task counts there, and goes on once.
3. Among the classes left, shingles are counted exactly and put in the order rarest first. A prefix is
   extended until it must hold a common signature: a shingle of the rare class is a signature alone;
   shingles of the frequent class (in more than ``frequent`` documents) are dealt to subclasses, and every
   pair of a subclass is a signature. A subclass with ``m`` of them must lose ``m - 1`` to lose all
   common pairs, so the prefix ends once the sum of rare ones and ``max(0, m - 1)`` is over ``t``.
   Signatures are made per band of set sizes, where linked sets fall in one band or neighbouring ones.
4. Holders of one signature form a star; the stars' components are clusters that no link leaves.
5. Each cluster is verified with whole sets: a search from one document to those not yet reached finds
   components without visiting all pairs of a dense group. Candidates can chain up to clusters of any size;
   those over ``group_shingles`` are not verified as wholes: the holders of each of their signatures are, as
   every link lies within one. Only a signature whose own holders are too many is cut into blocks, each two
   of which meet in one task. The true links found so are joined by components again.

Postings move packed in binary columns, sliced by hash, a task a slice, so that no task holds more than its
slice. Shingles that hold more than a ten-thousandth of all postings, which are fewer than
ten thousand, are counted with the others, but their postings need no look-up by slice: their counts are broadcast. Classes with more than a ten-thousandth of all rows, of which there can't be ten thousand, meet their
rows by broadcast, so no class is one task's.

Edge cases: null or empty texts and texts without words have the empty set and link with nothing; with
fewer words than a shingle the whole sequence is the one shingle; ids are integers, or text that casts to
them; rows with a null doc_id are returned without a component; rows that repeat a doc_id with the same text count once (a doc_id names one text:
with other texts under it, each row gets the component of its own text, and both may be joined);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .sparkio import bound_batches, fitting, lean, lean_groups, saved, slices, unused

FLUSH = 1 << 18
SLICE = 1 << 19
GROUP_SHINGLES = 1 << 21
BROADCAST_ROWS = 2_000_000
FREQUENT = 32
SMALL_SET = 20
HOT_CLASSES = 10_000
HOT_SHINGLES = 10_000


def missing(n, percent: int):
    """How many of ``n`` shingles a partner may lack."""
    return n - -(-percent * n // 100)


def extra(n, percent: int):
    """By how many shingles the prefix of the filter is extended; as many must be shared."""
    return 1 + missing(n, percent) // 2


def shingle_sets(piece: tb.Piece, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and where each row begins."""
    data, n = tb.LOWER[piece.data], piece.last - piece.first
    starts, ends, row = tb.words(tb.Piece(data, piece.offsets, piece.first, piece.last), tb.NOT_SPACE)
    at = tb.bounds(row, n)
    h = tb.hash_spans(data, starts, ends)
    count = np.diff(at)
    many = np.maximum(count - length + 1, 0)
    first = tb.ranges(at[:-1], many)
    hashes, rows = [tb.hash_windows(h, first, length)], [np.repeat(np.arange(n), many)]
    for k in range(1, length):
        few = np.flatnonzero(count == k)
        hashes.append(tb.hash_windows(h, at[few], k, 100 + k))
        rows.append(few)
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], tb.bounds(rows[new], n)


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def describe(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id``, set size ``n`` and the 128-bit digest ``s1, s2`` of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] * 3]
            for piece in tb.pieces(batch.column(1)):
                sets, at = shingle_sets(piece, length)
                out.append([np.diff(at), _row_sums(tb.mix(sets, 11), at), _row_sums(tb.mix(sets, 12), at)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c)) for c in zip(*out, strict=True))], names=["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n bigint, s1 bigint, s2 bigint")


def _sliced(key: np.ndarray, n_slices: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows (slice, bytes of each column) of what falls into each slice."""
    slice_ = (tb.mix(key, 21) % np.uint64(n_slices)).astype(np.int64)
    order = np.argsort(slice_, kind="stable")
    at = tb.bounds(slice_[order], n_slices)
    columns = [c[order] for c in columns]
    for k in np.unique(slice_).tolist():
        yield k, *(c[at[k] : at[k + 1]].tobytes() for c in columns)


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys, and the run of each key."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def shared_counts(docs: DataFrame, length: int, percent: int, postings: int, n_docs: int) -> DataFrame:
    """``doc_id`` and in how many hashes ``shared`` of its extended prefix it is not alone."""
    n_slices, n_buckets = slices(postings, SLICE), slices(n_docs, SLICE // 4)
    names = ["slice", "hashes", "docs", "credited", "credit"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            h, d = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            starts, run = _groups(h)
            sizes = np.diff(np.append(starts, len(h)))
            several = (np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts)) & (sizes > 1) if len(h) else np.zeros(0, bool)
            doc, credit = np.unique(d[several[run]], return_counts=True)
            send = np.where(several, -1, d[starts]) if len(h) else d
            rows = {k: (a, b, b"", b"") for k, a, b in _sliced(h[starts], n_slices, h[starts], send)}
            for k, a, b in _sliced(doc.view(np.uint64), n_slices, doc, credit):
                rows[k] = (*rows.get(k, (b"", b""))[:2], a, b)
            return _packed([(k, *v) for k, v in rows.items()], names)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for piece in tb.pieces(batch.column(1)):
                sets, at = shingle_sets(piece, length)
                n = np.diff(at)
                show = np.minimum(n, missing(n, percent) + extra(n, percent)) * (n > 0)
                held.append((sets[tb.ranges(at[:-1], show)], np.repeat(ids[piece.first : piece.last], show)))
                count += len(held[-1][0])
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        h, d = _joined(table["hashes"], np.uint64), _joined(table["docs"], np.int64)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        if len(h):
            starts, run = _groups(h)
            several = (np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts)) | (np.minimum.reduceat(d, starts) < 0)
            d = d[several[run] & (d >= 0)] if (d >= 0).any() else d[:0]
        docs = np.concatenate([d, _joined(table["credited"], np.int64)])
        credit = np.concatenate([np.ones(len(d), np.int64), _joined(table["credit"], np.int64)])
        doc, inverse = np.unique(docs, return_inverse=True)
        credit = np.bincount(inverse, weights=credit, minlength=len(doc)).astype(np.int64)
        return pa.Table.from_batches([_packed(list(_sliced(doc.view(np.uint64), n_buckets, doc, credit)), ["bucket", "docs", "credit"])])

    def add(table: pa.Table) -> pa.Table:
        doc, inverse = np.unique(_joined(table["docs"], np.int64), return_inverse=True)
        return pa.table({"doc_id": doc, "shared": np.bincount(inverse, weights=_joined(table["credit"], np.int64), minlength=len(doc)).astype(np.int64)})

    found = docs.mapInArrow(lean(emit), "slice int, hashes binary, docs binary, credited binary, credit binary").repartition(n_slices, "slice").groupBy("slice").applyInArrow(lean_groups(merge), "bucket int, docs binary, credit binary")
    return found.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(lean_groups(add), "doc_id bigint, shared bigint")


def whole_sets(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id``, ``n`` and the set's sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece in tb.pieces(batch.column(1)):
                sets, at = shingle_sets(piece, length)
                rows += [sets[at[k] : at[k + 1]].tobytes() for k in range(piece.last - piece.first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // 8 for r in rows], pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "n", "hashes"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n bigint, hashes binary")


def _flat_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    sizes = batch.column("n").to_numpy()
    return np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64), np.repeat(batch.column("doc_id").to_numpy(), sizes)


def hot_shingles(known: DataFrame, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles with more than ``share`` postings of ``HOT_SHINGLES * share``: fewer than ``HOT_SHINGLES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = (np.concatenate([np.frombuffer(x, t) for x in batch.column(k).to_pylist()] or [np.zeros(0, t)]) for k, t in ((0, np.uint64), (1, np.int64)))
            hot = n > share
            yield pa.RecordBatch.from_arrays([pa.array(h[hot].view(np.int64)), pa.array(n[hot])], names=["hash", "count"])

    found = known.select("hashes", "other").mapInArrow(lean(run), "hash bigint, count bigint").toArrow()
    h, n = found["hash"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def with_frequencies(sets: DataFrame, shingles: int) -> DataFrame:
    """``bucket`` (of documents) with packed ``docs``, ``hashes`` and ``counts``: of each document those shingles that others hold too."""
    n_slices = slices(shingles, SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, times = np.unique(_flat_sets(batch)[0], return_counts=True)
            yield _packed(list(_sliced(h, n_slices, h, times)), ["slice", "hashes", "counts"])

    def add(table: pa.Table) -> pa.Table:
        h, inverse = np.unique(_joined(table["hashes"], np.uint64), return_inverse=True)
        n = np.bincount(inverse, weights=_joined(table["counts"], np.int64), minlength=len(h)).astype(np.int64)
        several = n > 1
        return pa.table({"slice": pa.array(table["slice"].to_pylist()[:1], pa.int32()), "kind": pa.array([0], pa.int32()), "hashes": pa.array([h[several].tobytes()], pa.binary()), "other": pa.array([n[several].tobytes()], pa.binary()), "counts": pa.array([b""], pa.binary())})

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d = _flat_sets(batch)
            own, times = hot.value
            at = np.minimum(np.searchsorted(own, h), max(len(own) - 1, 0))
            known_here = own[at] == h if len(own) else np.zeros(len(h), bool)
            rows = [(k, 1, a, b, b"") for k, a, b in _sliced(h[~known_here], n_slices, h[~known_here], d[~known_here])]
            rows += [(k, 2, a, b, c) for k, a, b, c in _sliced(d[known_here].view(np.uint64), n_slices, h[known_here], d[known_here], times[at[known_here]])]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["slice", "kind", "hashes", "other", "counts"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for _, kind, hashes, other, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:  # the slice's counts come before its postings
                    known, counts = np.frombuffer(hashes, np.uint64), np.frombuffer(other, np.int64)
                    continue
                h, d = np.frombuffer(hashes, np.uint64), np.frombuffer(other, np.int64)
                if kind == 2:
                    out += list(_sliced(d.view(np.uint64), n_slices, d, h, np.frombuffer(own, np.int64)))
                    continue
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                ok = known[at] == h if len(known) else np.zeros(len(h), bool)
                h, d, n = h[ok], d[ok], counts[at[ok]]
                out += list(_sliced(d.view(np.uint64), n_slices, d, h, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], names=["bucket", "docs", "hashes", "counts"])

    schema = "slice int, kind int, hashes binary, other binary, counts binary"
    known = sets.mapInArrow(lean(count), "slice int, hashes binary, counts binary").repartition(n_slices, "slice").groupBy("slice").applyInArrow(lean_groups(add), schema)
    known = saved(known, "near-counts")
    # those with more than this share of all postings are fewer than HOT_SHINGLES
    hot = sets.sparkSession.sparkContext.broadcast(hot_shingles(known, shingles // HOT_SHINGLES + 1))
    return known.union(sets.mapInArrow(lean(postings), schema)).repartition(n_slices, "slice").sortWithinPartitions("slice", "kind").mapInArrow(lean(look_up), "bucket int, docs binary, hashes binary, counts binary")


def band_limits(percent: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands; linked sets are in one band or in neighbouring ones."""
    limits = [1]
    while limits[-1] < most:
        limits.append(limits[-1] * 100 // percent + 1)
    return np.array(limits)


def signatures(n: int, hashes: np.ndarray, counts: np.ndarray, percent: int, frequent: int, limits: np.ndarray) -> np.ndarray:
    """The signatures of a set of ``n``, of which ``hashes`` are held by ``counts`` documents and the rest by it alone."""
    need = missing(n, percent) + 1 - (n - len(hashes))
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((hashes, counts))
    hashes, counts = hashes[order], counts[order]
    out, own = [], int(np.searchsorted(limits, n, side="right")) - 1
    for band in (own, own + 1):
        combined = counts > frequent if limits[band] >= SMALL_SET else np.zeros(len(hashes), bool)
        q = -(-(missing(int(limits[band]), percent) + 1) // 8)
        part = (tb.mix(hashes, 31) % np.uint64(q)).astype(np.int64)
        first = np.zeros(len(hashes), bool)
        at = np.flatnonzero(combined)
        first[at[np.unique(part[at], return_index=True)[1]]] = True
        gained = np.cumsum(~first)
        end = int(np.searchsorted(gained, need)) + 1
        take, mixed = hashes[:end], combined[:end]
        seed = 1000 + band
        out.append(tb.mix(take[~mixed], seed))
        h, p = take[mixed], part[:end][mixed]
        order = np.argsort(p, kind="stable")
        h, p = h[order], p[order]
        starts, run = _groups(p)
        ends = np.append(starts[1:], len(p))
        i = np.repeat(np.arange(len(h)), ends[run] - np.arange(len(h)) - 1) if len(h) else np.zeros(0, np.int64)
        j = tb.ranges(np.arange(len(h)) + 1, ends[run] - np.arange(len(h)) - 1) if len(h) else i
        out.append(tb.mix(np.minimum(h[i], h[j]) * np.uint64(3) + np.maximum(h[i], h[j]), seed))
    return np.concatenate(out)


def _stars(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct edges from each key's documents to its smallest one; then the keys once, and their smallest documents."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    if not len(keys):
        return np.zeros((0, 2), np.int64), keys, docs
    starts, run = _groups(keys)
    least = np.minimum.reduceat(docs, starts)
    edges = np.column_stack([docs, least[run]])
    return np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0), keys[starts], least


def _by_bucket(parts: DataFrame, sets: DataFrame, shingles: int):
    """What ``with_frequencies`` gave and the sets' sizes, grouped by the same buckets of documents."""
    n_buckets = slices(shingles, SLICE)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield _packed(list(_sliced(d.view(np.uint64), n_buckets, d, n)), ["bucket", "docs", "n"])

    sized = sets.select("doc_id", "n").mapInArrow(lean(sizes), "bucket int, docs binary, n binary").repartition(n_buckets, "bucket").groupBy("bucket")
    return parts.repartition(n_buckets, "bucket").groupBy("bucket").cogroup(sized)


def _bucket_signatures(table: pa.Table, known: pa.Table, percent: int, frequent: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a bucket's documents, and the document of each."""
    doc, hashes, counts = _joined(table["docs"], np.int64), _joined(table["hashes"], np.uint64), _joined(table["counts"], np.int64)
    size = dict(zip(_joined(known["docs"], np.int64).tolist(), _joined(known["n"], np.int64).tolist(), strict=True))
    order = np.argsort(doc, kind="stable")
    doc, hashes, counts = doc[order], hashes[order], counts[order]
    starts, _ = _groups(doc)
    ends = np.append(starts, len(doc))[1:]  # none if the bucket shares nothing
    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
        found = signatures(max(size[int(doc[a])], z - a), hashes[a:z], counts[a:z], percent, frequent, limits)
        held.append((found, np.full(len(found), doc[a])))
    keys, docs = zip(*held, strict=True)
    return np.concatenate(keys), np.concatenate(docs)


def signature_holders(parts: DataFrame, sets: DataFrame, shingles: int, percent: int, frequent: int) -> DataFrame:
    """``doc_id`` and ``label``, a signature of it, for all documents and signatures."""
    limits = band_limits(percent)

    def emit(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, docs = _bucket_signatures(table, known, percent, frequent, limits)
        return pa.table({"doc_id": docs, "label": keys.view(np.int64)})

    return _by_bucket(parts, sets, shingles).applyInArrow(lean_groups(emit, 2), "doc_id bigint, label bigint")


def candidate_edges(parts: DataFrame, sets: DataFrame, shingles: int, percent: int, frequent: int) -> DataFrame:
    """Edges (a, b) of the stars of all signatures. ``parts`` is what ``with_frequencies`` gave for the sets."""
    limits, n_slices = band_limits(percent), slices(shingles, 4 * SLICE)
    names = ["slice", "keys", "docs", "ea", "eb"]

    def emit(table: pa.Table, known: pa.Table) -> pa.Table:
        edges, keys, least = _stars(*_bucket_signatures(table, known, percent, frequent, limits))
        rows = {k: (x, y, b"", b"") for k, x, y in _sliced(keys, n_slices, keys, least)}
        for k, x, y in _sliced(edges[:, 0].astype(np.uint64), n_slices, edges[:, 0], edges[:, 1]):
            rows[k] = (*rows.get(k, (b"", b""))[:2], x, y)
        return pa.Table.from_batches([_packed([(k, *v) for k, v in rows.items()], names)])

    def merge(table: pa.Table) -> pa.Table:
        edges, _, _ = _stars(_joined(table["keys"], np.uint64), _joined(table["docs"], np.int64))
        old = np.column_stack([_joined(table["ea"], np.int64), _joined(table["eb"], np.int64)])
        edges = np.unique(np.concatenate([edges, old]), axis=0)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    starred = _by_bucket(parts, sets, shingles).applyInArrow(lean_groups(emit, 2), "slice int, keys binary, docs binary, ea binary, eb binary")
    return starred.repartition(n_slices, "slice").groupBy("slice").applyInArrow(lean_groups(merge), "a bigint, b bigint")


def linked_stars(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges from every document to the smallest of its component, among these sets alone."""
    sizes = np.array([len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[token] > 1
    row = np.repeat(np.arange(len(sets)), sizes)[keep]
    token = token[keep]
    own = tb.bounds(row, len(sets))
    open_ = np.ones(len(sets), bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(open_[row])
        order = live[np.argsort(token[live], kind="stable")]
        return row[order], np.searchsorted(token[order], np.arange(len(times) + 1))

    holders, at = index()
    left = indexed = len(sets)
    out = []
    for start in np.argsort(ids, kind="stable").tolist():
        if not open_[start]:
            continue
        open_[start] = False
        left -= 1
        queue, members = [start], [start]
        while queue and left:
            x = queue.pop()
            mine = token[own[x] : own[x + 1]]
            shared = np.bincount(holders[tb.ranges(at[mine], at[mine + 1] - at[mine])], minlength=len(sets))
            near = np.flatnonzero(open_ & (100 * shared >= percent * (sizes + sizes[x] - shared)) & (shared > 0))
            open_[near] = False
            left -= len(near)
            queue += near.tolist()
            members += near.tolist()
            if left < indexed // 2:
                holders, at = index()
                indexed = left
        root = int(ids[members].min())
        out += [(int(ids[m]), root) for m in members if ids[m] != root]
    return out


def verified_edges(sets: DataFrame, groups: DataFrame, percent: int, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Edges between linked documents of a group (doc_id, label), each to the smallest it reaches there."""
    sized = saved(sets.join(groups, "doc_id").select("doc_id", "label", "n", "hashes"), "near-groups")
    load = sized.groupBy("label").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("members")).where("members > 1")
    packs = slices(sized.agg(F.sum("n")).first()[0] or 0, group_shingles // 4)
    blocks = F.ceil(F.col("load") / F.lit(group_shingles // 2)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = sized.join(load, "label").withColumn("blocks", blocks).withColumn("block", mine)
    small = rows.where("blocks <= 1").select(F.pmod(F.xxhash64("label"), F.lit(packs)).alias("g1"), F.lit(-1).alias("g2"), F.lit(-1).alias("g3"), "label", "doc_id", "hashes")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = rows.where("blocks > 1").select("label", "doc_id", "hashes", "block", other.alias("to")).where("block <> to")
    large = large.select(F.col("label").alias("g1"), F.least("block", "to").alias("g2"), F.greatest("block", "to").alias("g3"), "label", "doc_id", "hashes")

    def verify(table: pa.Table) -> pa.Table:
        ids, label = table["doc_id"].to_numpy(), table["label"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        order = np.argsort(label, kind="stable")
        starts, _ = _groups(label[order])
        edges = []
        for part in np.split(order, starts[1:]):
            if len(part) > 1:
                edges += linked_stars(ids[part], [sets[i] for i in part], percent)
        edges = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return small.union(large).groupBy("g1", "g2", "g3").applyInArrow(lean_groups(verify), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80, text: str = "text", frequent: int = FREQUENT, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest doc_id reachable by links) of each row."""
    bound_batches(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = two.where("doc_id IS NOT NULL")
    described = saved(describe(two, length), "near-described")
    full = described.where("doc_id IS NOT NULL AND n > 0")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))

    t = F.col("n") - F.ceil(F.col("n") * percent / 100)
    postings, n_docs = (x or 0 for x in full.agg(F.sum(t + 1 + F.floor(t / 2)), F.count(F.lit(1))).first())
    least = F.ceil(F.col("n") * percent / 100)
    t_least = least - F.ceil(least * percent / 100)
    shared = shared_counts(known, length, percent, int(postings), n_docs)
    left = saved(classes.join(shared, F.col("rep") == F.col("doc_id")).where(F.col("shared") >= 1 + F.floor(t_least / 2)).select("doc_id", "n"), "near-left")
    count, shingles = left.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not count:
        return _with_components(described, classes, None, 0, n_docs)

    sets = saved(whole_sets(known.join(fitting(left.select("doc_id"), count, BROADCAST_ROWS), "doc_id", "left_semi"), length), "near-sets")
    parts = saved(with_frequencies(sets, int(shingles)), "near-frequencies")
    clusters = saved(components(candidate_edges(parts, sets, int(shingles), percent, frequent)).withColumnsRenamed({"node": "doc_id"}), "near-clusters")
    sizes = sets.select("doc_id", "n").join(clusters, "doc_id").groupBy("label").agg(F.sum("n").alias("load"))
    chained = saved(sizes.where(F.col("load") > group_shingles // 2).select("label"), "near-chained")
    cut = bool(chained.take(1))
    if cut:
        within = clusters.join(chained, "label", "left_semi").select("doc_id")
        holders = signature_holders(parts, sets, int(shingles), percent, frequent).join(within, "doc_id", "left_semi").distinct()
        clusters = clusters.join(chained, "label", "left_anti").select("doc_id", "label").union(holders)
    links = saved(verified_edges(sets, clusters, percent, group_shingles).distinct(), "near-links")
    labels = components(links) if cut or _repeats(sets) else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return _with_components(described, classes, labels, links.count(), n_docs)


def _repeats(sets: DataFrame) -> bool:
    return bool(sets.groupBy("doc_id").count().where("count > 1").take(1))


def _with_components(described: DataFrame, classes: DataFrame, labels: DataFrame | None, n_labels: int, n_docs: int) -> DataFrame:
    """Each row with the label of its class; documents without a class, or alone in it, are their own component."""
    if labels is None:
        named = classes.withColumn("component", F.col("rep"))
    else:
        labels = fitting(labels.withColumnRenamed("node", "rep"), n_labels, BROADCAST_ROWS)
        named = classes.join(labels, "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    named = saved(named.where("members > 1 OR component <> rep").select("n", "s1", "s2", "members", "component"), "near-named")
    # fewer than HOT_CLASSES classes can have more than this share of the rows each
    share = n_docs // HOT_CLASSES + 1
    keys = ["n", "s1", "s2"]
    hot = F.broadcast(named.where(F.col("members") > share).select(*keys, F.col("component").alias("hot")))
    marked = described.where("n > 0 AND doc_id IS NOT NULL").join(hot, keys, "left")
    cold = marked.where("hot IS NULL").join(named.where(F.col("members") <= share).select(*keys, "component"), keys, "left")
    own = described.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = own.union(marked.where("hot IS NOT NULL").select("doc_id", "n", "hot")).union(cold.select("doc_id", "n", F.coalesce("component", "doc_id")))
    return out.withColumnsRenamed({"n": "n_shingles", "component": "component_id"})


def keep_one(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those of a component that are not its smallest; rows with a null doc_id stay."""
    name = unused(docs, "gone_id")
    gone = saved(near_duplicates(docs, length, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "near-gone")
    return docs.join(fitting(gone, gone.count(), BROADCAST_ROWS), docs["doc_id"].cast("bigint") == gone[name], "left_anti")
