"""Masking, permissions and audit chains over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import govern
from tracelake.session import table

from .registry import query


@query("""SELECT doc_id, 'lang=' || lang || ';wert=' || CASE WHEN toxic = 1 THEN '[maskiert]' ELSE source END AS fields FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)""")
def mask_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field ``wert`` of documents labelled toxic, which stand for sensitive objects, is masked."""
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fields = F.create_map(F.lit("lang"), F.col("lang"), F.lit("wert"), F.col("source"))
    docs = table(spark, sf_dir, "documents").join(flags, "doc_id", "left").withColumn("m", govern.mask_fields(fields, F.coalesce(F.col("toxic") == 1, F.lit(False))))
    return docs.select("doc_id", F.concat(F.lit("lang="), F.col("m")["lang"], F.lit(";wert="), F.col("m")["wert"]).alias("fields"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN '[maskiert]' ELSE text END AS value FROM conversations")
def mask_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = govern.mask_fields(F.create_map(F.lit("klartext"), F.col("text")), F.col("role") == "system")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fields["klartext"].alias("value"))


@query("""SELECT DISTINCT c_custkey AS user_id, permission FROM (
SELECT c_custkey, r_name AS permission FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0
UNION ALL SELECT c_custkey, r_name FROM customer, region WHERE c_acctbal > 9000)""")
def rbac_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, nations as roles, regions as permissions; the richest are super-administrators, debtors inactive."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"), (F.col("c_acctbal") > 9000).alias("superadmin"))
    roles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role"))
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("permission"))
    grants = table(spark, sf_dir, "nation").join(regions, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("role"), "permission")
    return govern.effective_permissions(users, roles, grants, regions)


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each user, of that user's events in order."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    events = table(spark, sf_dir, "events").select("user_id", number.alias("n"), F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string")).alias("payload"))
    return govern.build_chains(events, "user_id", "n", "payload")


_CHAINS = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, event_type || ':' || event_id AS payload FROM events),
c AS (SELECT user_id, sequence, payload, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || chr(10) || sequence || chr(10) || payload) AS hash FROM e WHERE sequence = 1
UNION ALL SELECT e.user_id, e.sequence, e.payload, c.hash, sha256(c.hash || chr(10) || e.sequence || chr(10) || e.payload) FROM e JOIN c ON e.user_id = c.user_id AND e.sequence = c.sequence + 1)"""


@query(f"{_CHAINS} SELECT user_id, sequence, payload, previous_hash, hash FROM c")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains(spark, sf_dir)


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events)
SELECT user_id, count(*) AS n, 0::BIGINT AS gaps, 0::BIGINT AS predecessors, count(*) FILTER (sequence = 2 AND user_id % 5 = 0) AS contents, user_id % 7 <> 0 AS head_ok FROM e GROUP BY user_id""")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain checked, row by row and against the head kept apart; every fifth chain's second payload and every seventh's head were altered."""
    rows = chains(spark, sf_dir).withColumn("payload", F.when((F.col("sequence") == 2) & (F.col("user_id") % 5 == 0), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    kept = F.max_by("hash", "sequence")
    heads = rows.groupBy("user_id").agg(F.when(F.col("user_id") % 7 == 0, F.sha2(kept, 256)).otherwise(kept).alias("head_hash"), F.max("sequence").alias("head_sequence"))
    faults = govern.verify_chains(rows, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gap").alias("gaps"), F.count_if("predecessor").alias("predecessors"), F.count_if("content").alias("contents"))
    return faults.join(govern.head_matches(rows, heads, "user_id").select("user_id", "head_ok"), "user_id")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, sequence, sequence = 6 AS gap, sequence = 6 AS predecessor, sequence = 3 AS content FROM s WHERE sequence <> 5 AND sequence IN (3, 6)""")
def audit_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 3 altered and row 5 deleted in every chain: the rows where this shows."""
    rows = chains(spark, sf_dir).where("sequence <> 5").withColumn("payload", F.when(F.col("sequence") == 3, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return govern.verify_chains(rows, "user_id").where("gap OR predecessor OR content").select("user_id", "sequence", "gap", "predecessor", "content")
