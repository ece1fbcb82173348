"""The correlation input of a stored case: events of users on hosts, with orders as their sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import casebase
from tracelake.session import table
from tracelake.workspace import shared_folder

from .registry import query
from .timeline import micros

CASE = 1


def stored(spark: SparkSession, sf_dir: str) -> casebase.Case:
    """Events are of case 0 or 1 by their user's remainder; entities, artifacts, evidence and observations mostly, but not always, of the same."""
    n, user = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("click", "process_start", "view", "dns_query", "signup", "service_installed", "purchase", "service_started", "error", "unbekannt"))), F.col("event_type"))
    base = table(spark, sf_dir, "events").select("event_id", "user_id", (user % 2).alias("case_id"), kind.alias("kind"), F.when(n % 17 != 0, micros("ts")).alias("occurred"), F.when(n % 13 == 0, "inferred").otherwise("parsed").alias("derivation"))
    entity = base.select("event_id", F.when(n % 5 == 0, "user").otherwise("object").alias("role"), (user * 10 + n % 3).alias("entity_id"))
    hosts = base.select("event_id", F.lit("host").alias("role"), (F.lit(-1) - user % 7).alias("entity_id"))
    entities = base.select("user_id").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "user_id").select((user * 10 + F.col("k")).alias("entity_id"), F.get(F.array(F.lit("process"), F.lit("service"), F.lit("url")), F.col("k")).alias("kind"), F.when(user % 11 == 0, 1 - user % 2).otherwise(user % 2).alias("case_id"))
    machines = base.select((user % 7).alias("m"), "case_id").distinct().select((F.lit(-1) - F.col("m")).alias("entity_id"), F.when(F.col("m") == 6, "network").otherwise("host").alias("kind"), "case_id")
    provenance = base.select("event_id", (n % 50).alias("artifact_id"), (n % 50 % 4).alias("evidence_id"), F.when(n % 3 != 0, n).alias("observation_id"), F.lit("primary").alias("role"), F.concat(F.lit("p"), (n % 2).cast("string")).alias("parser"))
    both = spark.createDataFrame([(0,), (1,)], "case_id bigint")
    ids = base.select((n % 50).alias("artifact_id")).distinct()
    artifacts = ids.crossJoin(F.broadcast(both)).where("artifact_id % 10 <> 9 OR case_id = 0").select("artifact_id", (F.col("artifact_id") % 4).alias("evidence_id"), "case_id")
    evidence = spark.createDataFrame([(k, c) for k in range(4) for c in (0, 1) if (k, c) != (3, 1)], "evidence_id bigint, case_id bigint")
    observations = base.where(n % 4 != 0).select(n.alias("observation_id"), (n % 50).alias("artifact_id"), "case_id", F.when(n % 7 != 0, F.when(n % 2 == 0, F.create_map(F.lit("herkunft"), F.lit("VSS#1"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))).alias("fields"))
    folder = shared_folder(spark, "case")
    name = os.path.basename(folder).replace("-", "_")
    people = casebase.participants_with_entities(entity.unionByName(hosts), entities.unionByName(machines))
    return casebase.store_case(name, folder, base.drop("user_id"), people, casebase.sources_with_artifacts(provenance, artifacts, evidence, observations), int(spark.conf.get("spark.sql.shuffle.partitions")))


_SQL = """WITH b AS (SELECT event_id, user_id, user_id % 2 AS c, CASE event_type WHEN 'click' THEN 'process_start' WHEN 'view' THEN 'dns_query' WHEN 'signup' THEN 'service_installed' WHEN 'purchase' THEN 'service_started' END AS kind, epoch_us(ts) AS occurred FROM events),
t AS (SELECT event_id, kind, user_id * 10 + event_id % 3 AS entity_id, CASE event_id % 3 WHEN 0 THEN 'process' ELSE 'service' END AS entity_kind, CASE WHEN event_id % 5 = 0 THEN 'user' ELSE 'object' END AS role, -1 - user_id % 7 AS host_id, occurred,
 CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 7 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'VSS#1' ELSE 'live' END END AS snapshot, event_id % 50 % 4 AS evidence_id, event_id % 50 AS artifact_id, CASE WHEN event_id % 3 <> 0 THEN event_id END AS observation_id, 'p' || event_id % 2 AS parser
 FROM b WHERE c = 1 AND kind IS NOT NULL AND event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 3 <> 2 AND user_id % 11 <> 0 AND user_id % 7 <> 6 AND event_id % 50 % 10 <> 9 AND event_id % 50 % 4 <> 3)"""


@query(f"{_SQL} SELECT * FROM t")
def correlation_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole input of one case, from buckets."""
    return casebase.correlation_input(spark, stored(spark, sf_dir), CASE).drop("derivation", "source_role")


@query(f"{_SQL} SELECT event_id, entity_id, host_id, (SELECT count(*) FROM t) > 300 AS limited FROM t ORDER BY occurred, event_id, entity_id LIMIT 300")
def correlation_input_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 traces of it, and whether there are more."""
    first, limited = casebase.first_traces(casebase.correlation_input(spark, stored(spark, sf_dir), CASE), 300)
    return first.select("event_id", "entity_id", "host_id").crossJoin(F.broadcast(limited))  # one row
