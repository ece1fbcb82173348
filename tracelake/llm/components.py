"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkio import checkpointed, slices

PART_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def _packed(edges: DataFrame, rows: int) -> DataFrame:
    """Edges of which there are some ``rows``, in as many parts as they need, but one for each core: each round reads, and writes, every part."""
    return edges.coalesce(slices(rows, PART_EDGES, edges.sparkSession.sparkContext.defaultParallelism))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node of the edges (a, b). Loops, repeats and direction do not matter."""
    now = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(rounds):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        now = checkpointed(_packed(_small_star(_large_star(now)), state[0]))
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(now.select("b", "b").distinct())
