"""Approximate nearest neighbours by multi-index hashing over learned, rotated binary codes.

1. Equal vectors are one index entry with its ``k + 1`` smallest ids; of a larger group no more can be
   among anyone's ``k`` nearest. A window limit cuts groups before they are shuffled.
2. A rotation is learned by iterative quantisation from at most ``sample`` vectors; the signs of the
   rotated principal components are a code of up to 64 bits. From the sample's neighbours is learned, too,
   within how many bits of a query ``target`` of all vectors at a given distance lie: the *reach* of a distance.
3. The entries are dealt to shards of about ``shard_rows``. Each shard cuts its codes into ``m`` substrings of
   about the binary logarithm of its size and keeps a bucket table of each. Level ``a`` of a search probes,
   in one table after another, the buckets whose number differs from the query's in exactly ``a`` bits. By the
   pigeonhole principle all codes within ``r = a m + b`` bits are known once ``b + 1`` tables are done; those found
   farther wait. The others are ranked by their floats, nearest codes first.
4. A search ends as soon as ``r`` covers the reach of the ``k + 1``-th distance so far; so queries with
   near neighbours look at a few buckets, and one that finds too few goes on, up to all codes.
5. Queries reach the shards by an exchange, behind the shard's entries in one sorted partition: they stream
   through a task that holds its shard only, and nothing passes through the driver.

The index prunes as far as neighbours' codes agree. Between vectors without any structure (as in uniformly
random ones, whose neighbours differ in a third of all bits) a third of the codes must be looked at.

Edge cases: ids (integers, or text that casts to them) that are null, vectors that are null, empty, zero or
hold null or non-finite numbers take no part; nor do those not of the most common length, as no distance to
the others is defined; rows that repeat an id are one row (with other vectors: several, none a neighbour of
its own id); ties go to the smaller id; with fewer than ``k`` candidates all are returned; columns of any
other name are of no concern.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .sparkio import bound_batches, saved, slices

SAMPLE = 8192
SHARD_ROWS = 1 << 15
TARGET = 0.9
WHOLE_LEVELS = 3
MOST_SUBSTRING_BITS = 18


class Coder(NamedTuple):
    mean: np.ndarray
    rotation: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").astype(np.uint64) @ (np.uint64(1) << np.arange(0, 8 * -(-bits.shape[1] // 8), 8, dtype=np.uint64))

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 5) -> Coder:
    """Iterative quantisation: alternate codes and the rotation that brings the components nearest to them."""
    mean = x.mean(0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    main = vectors[:, ::-1][:, :bits]
    v = (x - mean) @ main
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return Coder(mean, main @ r)


class Reach(NamedTuple):
    """Within how many bits of a vector ``target`` of those at most ``distances[i]`` away lie: ``bits[i]``, rising."""

    distances: np.ndarray
    bits: np.ndarray

    def of(self, distance: float) -> int:
        return int(self.bits[min(int(np.searchsorted(self.distances, distance)), len(self.bits) - 1)])


def learn_reach(coder: Coder, x: np.ndarray, k: int, target: float, queries: int = 512, steps: int = 16) -> Reach:
    """From the ``4 k`` nearest others of evenly chosen sample vectors; for lesser distances, from moving vectors that far towards others."""
    codes, norms, distances, bits = coder.codes(x), (x * x).sum(1), [], []
    chosen = np.arange(0, len(x), max(1, len(x) // queries))
    for i in chosen:
        d = norms - 2 * (x @ x[i]) + norms[i]
        d[i] = np.inf
        near = np.argpartition(d, min(4 * k, len(x) - 1) - 1)[: 4 * k]
        near = near[near != i]
        distances.append(np.sqrt(np.maximum(d[near], 0)))
        bits.append(np.bitwise_count(codes[near] ^ codes[i]))
    d, b = np.concatenate(distances), np.concatenate(bits)
    if not len(d):
        return Reach(np.zeros(1), np.array([coder.bits]))
    least, reach = [], []
    rng = np.random.default_rng(9)
    ways = x[rng.permutation(len(x))[: len(chosen)]] - x[rng.permutation(len(x))[: len(chosen)]]
    ways /= np.maximum(np.sqrt((ways * ways).sum(1)), 1e-300)[:, None]
    parts = np.array_split(np.argsort(d, kind="stable"), min(steps, len(d)))
    for part in range(steps):
        least.append(float(d[parts[0]].max()) * part / steps)
        reach.append(int(np.quantile(np.bitwise_count(coder.codes(x[chosen] + least[-1] * ways) ^ codes[chosen]), target, method="higher")))
    for p in parts:
        least.append(float(d[p].max()))
        reach.append(int(np.quantile(b[p], target, method="higher")))
    # farther than all the sample's neighbours: every code
    return Reach(np.array([*least, np.inf]), np.maximum.accumulate([*reach, coder.bits]))


class MultiIndex:
    """Bucket tables over the substrings of a shard's codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        width = min(MOST_SUBSTRING_BITS, max(1, int(np.log2(max(2, len(codes))))))
        self.m = max(1, -(-bits // width), round(bits / width))
        edges = np.linspace(0, bits, self.m + 1).astype(int)
        self.cuts = [(int(a), int(z - a)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
        orders, starts, self.base, at = [], [], [], 0
        for a, w in self.cuts:
            part = self.part(codes, a, w)
            order = np.argsort(part, kind="stable")
            orders.append(order.astype(np.int32))
            starts.append(np.searchsorted(part[order], np.arange((1 << w) + 1)) + len(codes) * len(self.base))
            self.base.append(at)
            at += (1 << w) + 1
        self.order, self.starts = np.concatenate(orders), np.concatenate(starts)
        flips = {w: self.flips(w) for _, w in self.cuts}
        self.levels = [[f[a] if a < len(f) else f[0][:0] for f in (flips[w] for _, w in self.cuts)] for a in range(max(w for _, w in self.cuts) + 1)]

    @staticmethod
    def flips(width: int) -> list[np.ndarray]:
        """The masks of a substring by their number of bits."""
        masks = np.arange(1 << width)
        count = np.bitwise_count(masks)
        order = np.argsort(count, kind="stable")
        return np.split(masks[order], np.cumsum(np.bincount(count))[:-1])

    @staticmethod
    def part(codes: np.ndarray, at: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, code: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each level the radius that is now complete, and the positions newly known to be in it, nearest codes first, with their bits; each position once."""
        known, code = np.zeros(len(self.codes), bool), int(code)
        waiting, far = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        # the few buckets of the first levels are probed in all tables at once
        rounds = [(a, range(self.m)) for a in range(min(WHOLE_LEVELS, len(self.levels)))] + [(a, range(j, j + 1)) for a in range(WHOLE_LEVELS, len(self.levels)) for j in range(self.m)]
        for a, tables in rounds:
            buckets = np.concatenate([(((code >> self.cuts[j][0]) & ((1 << self.cuts[j][1]) - 1)) ^ self.levels[a][j]) + self.base[j] for j in tables])
            lo = self.starts[buckets]
            n = self.starts[buckets + 1] - lo
            full = n > 0
            fresh = np.zeros(len(self.codes), bool)
            fresh[self.order[tb.ranges(lo[full], n[full])]] = True
            new = np.flatnonzero(fresh & ~known)
            known |= fresh
            at = np.concatenate([waiting, new])
            bits = np.concatenate([far, np.bitwise_count(self.codes[new] ^ np.uint64(code))])
            radius = min(self.bits, a * self.m + tables[-1])
            near = bits <= radius
            waiting, far = at[~near], bits[~near]
            at, bits = at[near], bits[near]
            order = np.argsort(bits, kind="stable")
            yield radius, at[order], bits[order]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within the radius, each once."""
        found = []
        for complete, at, _ in self.search(code):
            found.append(at)
            if complete >= radius:
                break
        at = np.sort(np.concatenate(found))
        return at[np.bitwise_count(self.codes[at] ^ np.uint64(code)) <= radius]


def nearest_in_shard(index: MultiIndex, own: np.ndarray, x: np.ndarray, v: np.ndarray, code: np.uint64, n: int, reach: Reach) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``n`` nearest entries found (ties to the smaller id), their distances, and how many floats were compared."""
    best, dist, compared = np.zeros(0, np.int64), np.zeros(0), 0
    for radius, at, bits in index.search(code):
        while len(at):
            # the nearest codes first; what they find tells how far to look
            limit = reach.of(float(dist.max())) if len(best) >= n else int(bits[min(len(at), 4 * n) - 1])
            take = int(np.searchsorted(bits, limit, side="right"))
            if not take:
                break
            d = np.sqrt(((x[at[:take]] - v) ** 2).sum(1))
            best, dist, compared = np.concatenate([best, at[:take]]), np.concatenate([dist, d]), compared + take
            at, bits = at[take:], bits[take:]
            if len(best) > n:
                near = np.flatnonzero(dist <= np.partition(dist, n - 1)[n - 1])
                best, dist = best[near], dist[near]
        if len(best) >= n and radius >= reach.of(float(dist.max())):
            break
    order = np.lexsort((own[best], dist))[:n]
    return best[order], dist[order], compared


def _valid(vector: Column, vec_id: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec_id.isNotNull() & vector.isNotNull() & F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, target: float = TARGET) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of the ``k`` nearest others of each query row."""
    bound_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(_valid(F.col("v"), F.col("id")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == common["n"]).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    rows = rows.dropDuplicates(["h1", "h2", "id"])
    by_vector = Window.partitionBy("h1", "h2").orderBy("id")
    # the limit on row_number is applied before the shuffle too, so a group sends k + 2 rows a task at most
    members = saved(rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 2).withColumn("entry", F.first("id").over(by_vector)).select("h1", "h2", "entry", "id", "n", F.when(F.col("n") == 1, F.col("v")).alias("v")), "ann-members")
    entries = members.where("n = 1").select("entry", "v")
    wanted = saved(rows.where("q").select("id", "h1", "h2").distinct().join(members.where("n = 1").select("h1", "h2", "entry"), ["h1", "h2"]).select(F.col("id").alias("query_id"), "entry"), "ann-queries")

    n_entries = entries.count()
    taken = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = _matrix(taken)
    coder = learn_rotation(x, min(64, x.shape[1])) if len(x) > 1 else Coder(np.zeros(x.shape[1]), np.eye(x.shape[1])[:, :64])
    reach = learn_reach(coder, x, k, target) if len(x) > 1 else Reach(np.zeros(1), np.array([coder.bits]))
    model = spark.sparkContext.broadcast((coder, reach))
    shards = slices(n_entries, shard_rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries and queries of whole shards, each shard's entries first."""
        (coder, reach), shard, held, built = model.value, None, [], None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1]))) if len(number) else []
            for a, z in zip(cuts, [*cuts[1:], len(number)], strict=True):
                ids, vs = batch.column(2).slice(a, z - a).to_numpy(), _matrix(batch.column(3).slice(a, z - a))
                if number[a] != shard:
                    shard, held, built = number[a], [], None
                if kind[a] == 0:
                    held.append((ids, vs))
                    continue
                if built is None:
                    if not held:
                        continue  # a shard without entries
                    own, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    held, built = [], (own, x, MultiIndex(coder.codes(x), coder.bits))
                own, x, index = built
                found = [nearest_in_shard(index, own, x, v, code, k + 1, reach)[:2] for v, code in zip(vs, coder.codes(vs), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(own[np.concatenate([f[0] for f in found])]), pa.array(np.concatenate([f[1] for f in found]))], names=["query", "entry", "score"])

    asked = entries.join(wanted.select("entry").distinct(), "entry", "left_semi")
    dealt = entries.select(F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "entry", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "entry", "v")
    found = dealt.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "entry").mapInArrow(search, "query bigint, entry bigint, score double")

    def first(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)

    near = first(found, "query", ["score", "entry"], k + 1).drop("rank")
    spread = first(near.join(members.select("entry", "id"), "entry"), "query", ["score", "id"], k + 1).drop("rank")
    paired = wanted.join(spread.select(F.col("query").alias("entry"), "id", "score"), "entry").where("id <> query_id")
    # one id can have several vectors; its nearest counts
    return first(paired.groupBy("query_id", "id").agg(F.min("score").alias("score")), "query_id", ["score", "id"], k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
