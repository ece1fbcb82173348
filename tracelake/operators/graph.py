"""Edge lists: neighbourhoods, induced subgraphs and merged relationships, without OR joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: node, other, direction and the edge's own columns."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("direction"), *rest))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The edges at one node; a loop counts once. Filtered on either side before the union."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    out = edges.where(F.col("source") == node).select(F.col("target").alias("other"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(edges.where((F.col("target") == node) & (F.col("source") != node)).select(F.col("source").alias("other"), F.lit("in").alias("direction"), *rest))


def with_ends(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Adds the ends' names; ``names`` has node and name."""
    source = names.select(F.col("node").alias("source"), F.col("name").alias("source_name"))
    target = names.select(F.col("node").alias("target"), F.col("name").alias("target_name"))
    return edges.join(source, "source", "left").join(target, "target", "left")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def merged(edges: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Of equal relationships the first wins; later ones only support it."""
    by = Window.partitionBy("kind", "source", "target").orderBy(ordinal)
    return edges.withColumn("role", F.when(F.row_number().over(by) == 1, "primary").otherwise("supporting"))
