"""The stored case: co-located joins, and case consistency at every step."""

from __future__ import annotations

import pytest

from tracelake.operators import casebase


@pytest.fixture
def sorted_joins(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def stored(spark, folder, **changed):
    """One good trace of case 1; ``changed`` replaces one of the tables."""
    t = {
        "events": spark.createDataFrame([(1, 1, "process_start", 5, "parsed"), (2, 1, "web_visit", 5, "parsed"), (3, 1, "process_start", None, "parsed"), (4, 1, "process_start", 5, "inferred"), (5, 2, "process_start", 5, "parsed")], "event_id long, case_id long, kind string, occurred long, derivation string"),
        "participants": spark.createDataFrame([(e, r, i) for e in range(1, 6) for r, i in (("executable", 10), ("host", 20), ("user", 30))], "event_id long, role string, entity_id long"),
        "entities": spark.createDataFrame([(10, "file", 1), (20, "host", 1), (30, "windows_user", 1)], "entity_id long, kind string, case_id long"),
        "provenance": spark.createDataFrame([(e, 7, 8, 9, "primary", "p") for e in range(1, 6)], "event_id long, artifact_id long, evidence_id long, observation_id long, role string, parser string"),
        "artifacts": spark.createDataFrame([(7, 8, 1)], "artifact_id long, evidence_id long, case_id long"),
        "evidence": spark.createDataFrame([(8, 1)], "evidence_id long, case_id long"),
        "observations": spark.createDataFrame([(9, 7, 1, {"herkunft": "VSS#3"})], "observation_id long, artifact_id long, case_id long, fields map<string,string>"),
    } | changed
    people = casebase.participants_with_entities(t["participants"], t["entities"])
    sources = casebase.sources_with_artifacts(t["provenance"], t["artifacts"], t["evidence"], t["observations"])
    return casebase.store_case(f"case_{folder.name}".replace("-", "_"), str(folder), t["events"], people, sources, 3)


def test_one_trace_and_no_exchange(spark, tmp_path, sorted_joins):
    found = casebase.correlation_input(spark, stored(spark, tmp_path), 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3 and "Bucketed: true" in plan
    assert [(r.event_id, r.entity_id, r.host_id, r.snapshot, r.source_role) for r in found.collect()] == [(1, 10, 20, "VSS#3", "primary")]
    first, limited = casebase.first_traces(found, 1)
    assert first.count() == 1 and not limited.first().limited
    assert casebase.correlation_input(spark, stored(spark, tmp_path), 2).collect() == []


@pytest.mark.parametrize(("table", "rows", "schema"), [
    ("entities", [(10, "file", 2), (20, "host", 1)], "entity_id long, kind string, case_id long"), ("entities", [(10, "file", 1), (20, "host", 2)], "entity_id long, kind string, case_id long"),
    ("entities", [(10, "file", 1), (20, "network", 1)], "entity_id long, kind string, case_id long"), ("artifacts", [(7, 8, 2)], "artifact_id long, evidence_id long, case_id long"),
    ("artifacts", [(7, 9, 1)], "artifact_id long, evidence_id long, case_id long"), ("evidence", [(8, 2)], "evidence_id long, case_id long"),
])
def test_other_cases_stay_out(spark, tmp_path, table, rows, schema):
    assert casebase.correlation_input(spark, stored(spark, tmp_path, **{table: spark.createDataFrame(rows, schema)}), 1).collect() == []


@pytest.mark.parametrize(("row", "snapshot"), [((9, 7, 2, {"herkunft": "VSS#3"}), None), ((9, 6, 1, {"herkunft": "VSS#3"}), None), ((9, 7, 1, {"x": "y"}), "live"), ((9, 7, 1, None), None)])
def test_observations_are_optional(spark, tmp_path, row, snapshot):
    observations = spark.createDataFrame([row], "observation_id long, artifact_id long, case_id long, fields map<string,string>")
    assert [r.snapshot for r in casebase.correlation_input(spark, stored(spark, tmp_path, observations=observations), 1).collect()] == [snapshot]
