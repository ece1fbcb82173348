"""The evidence model: merges with provenance, idempotent upserts, lookups that must be unique, and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def provenance_full(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Links with locator and parser of the artifact where they have none of their own (columns artifact_id, locator, parser)."""
    own = artifacts.select("artifact_id", F.col("locator").alias("_l"), F.col("parser").alias("_p"))
    return links.join(own, "artifact_id", "left").withColumns({"locator": F.coalesce("locator", "_l"), "parser": F.coalesce("parser", "_p")}).drop("_l", "_p")


def provenance_compact(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The reverse: what equals the artifact's becomes null, and equal links (nulls being equal) are kept once."""
    own = artifacts.select("artifact_id", F.col("locator").alias("_l"), F.col("parser").alias("_p"))
    out = links.join(own, "artifact_id", "left").withColumns({"locator": F.nullif("locator", "_l"), "parser": F.nullif("parser", "_p")}).drop("_l", "_p")
    return out.dropDuplicates()


def provenance_roles(rows: DataFrame, keys: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """The first occurrence of each object is its primary source, later ones support it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordinal))
    return rows.withColumn("role", F.when(n == 1, "primary").otherwise("supporting"))


def missing_references(references: DataFrame, kind: str, objects: dict[str, DataFrame]) -> DataFrame:
    """References to objects that don't exist, by their kind: one anti join for each."""
    parts = [references.where(F.col(kind) == k).join(o.select(F.col(o.columns[0]).alias("object_id")), "object_id", "left_anti") for k, o in objects.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered_ids(findings: DataFrame, base: Column, order: Sequence[str]) -> DataFrame:
    """``id``: the content hash; findings that share one get -2, -3 in order."""
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*order))
    return findings.withColumn("_base", base).withColumn("_n", n).withColumn("id", F.when(F.col("_n") > 1, F.concat("_base", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


def unique_mapping(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value, and that value; ambiguous keys give nothing."""
    return pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_max")).where(F.col(value) == F.col("_max")).drop("_max")


def merged_attributes(rows: DataFrame, entity: str, attribute: str, value: str, ordinal: str) -> DataFrame:
    """Of each entity's attributes the first value in order wins."""
    return rows.where(F.col(value).isNotNull()).groupBy(entity, attribute).agg(F.min_by(value, ordinal).alias(value))


def display_names(rows: DataFrame, entity: str, name: str, ordinal: str) -> DataFrame:
    """The first name that is no bare SID, else the first name."""
    real = F.when(~F.startswith(name, F.lit("S-1-")), F.col(ordinal))
    return rows.groupBy(entity).agg(F.coalesce(F.min_by(F.when(~F.startswith(name, F.lit("S-1-")), F.col(name)), real), F.min_by(name, ordinal)).alias("display_name"))


def first_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_new(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base and those delta rows whose key it lacks, each key once; a rerun changes nothing. ``inserted`` marks the new ones."""
    fresh = delta.dropDuplicates(list(keys)).join(base.select(*keys), list(keys), "left_anti")
    return base.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def upsert_entities(base: DataFrame, delta: DataFrame, key: str, first: str, last: str, keep: Sequence[str]) -> DataFrame:
    """Seen times widen; of all other columns the stored value wins, and a stored null is filled."""
    both = base.withColumn("_side", F.lit(0)).unionByName(delta.withColumn("_side", F.lit(1)))
    return both.groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_side"))).alias(c) for c in keep))


def fill_missing(base: DataFrame, delta: DataFrame, key: str, column: str) -> DataFrame:
    """A value is filled once: only where there is none and a new one is known. ``updated`` marks the rows filled."""
    new = delta.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_new"))
    joined = base.join(new, key, "left").withColumn("updated", F.col(column).isNull() & F.col("_new").isNotNull())
    return joined.withColumn(column, F.coalesce(column, "_new")).drop("_new")


def union_padded(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null there."""
    return left.unionByName(right, allowMissingColumns=True)


def is_interpretation(derivation: Column) -> Column:
    """Whether a derivation goes beyond what was observed, parsed or derived."""
    return ~derivation.isin("observed", "parsed", "derived")
