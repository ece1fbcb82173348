"""Correlation input from a case's model tables, stored so that it is read without dealing the facts again.

A case is written once and read by every run. Participants are joined with their entities, and sources with their artifact, evidence and
observation, when they are written; these tables and the events are bucketed by the event and sorted in their buckets.
The run's join of events, participants, hosts and sources is then one of co-located buckets: no exchange on any side.
"""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.correlate import DERIVATIONS

#: fixed values: what a run looks at, and how many traces it takes
EVENT_KINDS = ("process_start", "network_connection", "dns_query", "http_request", "service_installed", "service_started", "scheduled_task_created", "scheduled_task_executed")
ENTITY_KINDS = ("file", "application", "process", "service", "scheduled_task")
MOST_TRACES = 10_000


class Case(NamedTuple):
    """The stored tables: event, participant (with its entity), source (with artifact, evidence and observation)."""

    event: str
    participant: str
    source: str


def participants_with_entities(participants: DataFrame, entities: DataFrame) -> DataFrame:
    """event_id, role, entity_id, with the entity's kind and case."""
    return participants.join(entities.select("entity_id", F.col("kind").alias("entity_kind"), F.col("case_id").alias("entity_case")), "entity_id").select("event_id", "role", "entity_id", "entity_kind", "entity_case")


def sources_with_artifacts(provenance: DataFrame, artifacts: DataFrame, evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """Provenance (event_id, artifact_id, evidence_id, observation_id, role, parser) of events with artifact and evidence of one case, and the observation's snapshot (``live`` if its fields name none), if it is of the artifact and case."""
    a = artifacts.select("artifact_id", "evidence_id", F.col("case_id").alias("source_case"))
    v = evidence.select("evidence_id", F.col("case_id").alias("source_case"))
    o = observations.select("observation_id", "artifact_id", F.col("case_id").alias("source_case"), F.when(F.col("fields").isNotNull(), F.coalesce(F.col("fields")["herkunft"], F.lit("live"))).alias("snapshot"))
    found = provenance.join(a, ["artifact_id", "evidence_id"]).join(v, ["evidence_id", "source_case"]).join(o, ["observation_id", "artifact_id", "source_case"], "left")
    return found.select("event_id", "artifact_id", "evidence_id", "observation_id", F.col("role").alias("source_role"), "parser", "source_case", "snapshot")


def store_case(name: str, folder: str, events: DataFrame, participants: DataFrame, sources: DataFrame, buckets: int) -> Case:
    """Writes the three tables to ``folder`` and registers them as ``name``_event, ``name``_participant and ``name``_source, over those of the same name.

    A bucket should be some hundred MB of its largest table; each is written by one task, whatever the case's size.
    """
    made = Case(*(f"{name}_{part}" for part in Case._fields))
    for table, rows in zip(made, (events, participants, sources), strict=True):
        rows.repartition(buckets, "event_id").write.bucketBy(buckets, "event_id").sortBy("event_id").mode("overwrite").option("path", os.path.join(folder, table)).saveAsTable(table)
    return made


def correlation_input(spark: SparkSession, case: Case, case_id: int | str) -> DataFrame:
    """Every trace of a case that rules may look at: an event with an entity, a host and a source, all of the case."""
    e = spark.table(case.event).where((F.col("case_id") == case_id) & F.col("occurred").isNotNull() & F.col("derivation").isin(*DERIVATIONS) & F.col("kind").isin(*EVENT_KINDS))
    p = spark.table(case.participant).where(F.col("entity_case") == case_id)
    hosts = p.where("role = 'host' AND entity_kind = 'host'").select("event_id", F.col("entity_id").alias("host_id"))
    sources = spark.table(case.source).where(F.col("source_case") == case_id).drop("source_case")
    joined = e.select("event_id", "kind", "occurred", "derivation").join(p.where(F.col("entity_kind").isin(*ENTITY_KINDS)).drop("entity_case"), "event_id").join(hosts, "event_id").join(sources, "event_id")
    return joined.select("event_id", "kind", "entity_id", "entity_kind", "role", "host_id", "occurred", "snapshot", "derivation", "evidence_id", "artifact_id", "observation_id", "parser", "source_role")


def first_traces(traces: DataFrame, most: int = MOST_TRACES) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` traces by time, event, entity, host and source (a sort with a limit), and one row that tells whether the input was ``limited``."""
    order = ["occurred", "event_id", "entity_id", "host_id", "evidence_id", "artifact_id", "observation_id", "source_role", "role"]
    first = traces.orderBy(*order).limit(most)
    return first, traces.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("limited"))
