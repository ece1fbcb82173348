"""A run of the correlation rules against a loop over all pairs, with and without its limits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import correlate

SCHEMA = "event_id bigint, artifact_id string, entity_id bigint, entity_kind string, role string, kind string, semantics string, parser string, time_ns bigint"
WINDOWS = dict(correlate.RULE_WINDOWS)
SECOND = 10**9


def rule(a, b):
    if a["event_id"] == b["event_id"] or a["artifact_id"] == b["artifact_id"]:
        return None
    timed = [t["semantics"] == "event_time" for t in (a, b)]
    kinds = (a["kind"], b["kind"])
    if kinds == ("process_start",) * 2 and a["entity_kind"] in ("file", "application") and a["role"] == b["role"] == "executable" and all(timed) and a["parser"] != b["parser"]:
        return "execution-sources"
    if (a["entity_kind"], *kinds) in (("service", "service_installed", "service_started"), ("scheduled_task", "scheduled_task_created", "scheduled_task_executed")) and timed[1]:
        return "persistence-activity"
    if a["entity_kind"] == "process" and a["role"] == b["role"] == "process" and kinds[0] == "process_start" and kinds[1] in ("network_connection", "dns_query", "http_request") and all(timed):
        return "process-network"
    return None


def run(traces, comparisons, matches):
    """One comparison after the other, until a limit."""
    order = [c.split()[0] for c in SCHEMA.split(", ")]
    groups, seen, done, found = {}, set(), 0, []
    for t in traces:
        groups.setdefault(t["entity_id"], []).append(t)
    for g in sorted(groups):
        rows = sorted(groups[g], key=lambda t: (t["time_ns"], t["event_id"], t["artifact_id"], *(t[c] for c in order)))
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                delta = b["time_ns"] - a["time_ns"]
                if delta // SECOND > 86400:
                    break
                if done == comparisons or len(found) == matches:
                    return found, done, True
                done += 1
                x, y = (a, b) if rule(a, b) or delta else (b, a)
                name = rule(x, y)
                key = (name, tuple(x.values()), tuple(y.values()))
                if name and delta <= WINDOWS[name] and key not in seen:
                    seen.add(key)
                    found.append((name, x["event_id"], y["event_id"], done - 1))
    return found, done, False


def traces(seed, n):
    rnd = random.Random(seed)
    kinds = [("file", "executable", "process_start"), ("application", "executable", "process_start"), ("service", "service", "service_installed"), ("service", "service", "service_started"), ("scheduled_task", "task", "scheduled_task_created"), ("scheduled_task", "task", "scheduled_task_executed"), ("process", "process", "process_start"), ("process", "process", "dns_query")]
    out = []
    for i in range(n):
        entity, role, kind = rnd.choice(kinds)
        time = rnd.choice([0, 1, 86_400, 86_401, 200_000, 300]) * SECOND + rnd.choice([0, 0, 1, 2 * SECOND, 999_999_999])
        out.append({"event_id": i if i % 9 else 0, "artifact_id": f"a{i % 17}", "entity_id": rnd.choice([1, 1, 2, 3]), "entity_kind": entity, "role": role, "kind": kind, "semantics": rnd.choice(["event_time", "event_time", "artifact_time"]), "parser": rnd.choice("pq"), "time_ns": time})
    return out + out[:3]


@pytest.mark.parametrize(("seed", "comparisons", "matches"), [(1, 10**6, 10**6), (2, 10**6, 5), (3, 137, 10**6), (4, 1, 1), (5, 400, 3), (6, 10**6, 10**6)])
def test_runs(spark, seed, comparisons, matches):
    rows = traces(seed, 90)
    wanted, done, limited = run(rows, comparisons, matches)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    found, summary = correlate.evaluated(frame, ["entity_id"], comparisons, matches)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert tuple(summary.first()) == (done, len(wanted), limited)


def all_pairs(rows):
    """Every match of the rules, by a loop."""
    out = set()
    for g in {t["entity_id"] for t in rows}:
        own = [t for t in rows if t["entity_id"] == g]
        for a in own:
            for b in own:
                name, delta = rule(a, b), b["time_ns"] - a["time_ns"]
                if name and 0 <= delta <= WINDOWS[name] and (name != "execution-sources" or delta or (a["event_id"], a["artifact_id"]) < (b["event_id"], b["artifact_id"])):
                    out.add((name, a["event_id"], b["event_id"]))
    return out


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_all_pairs_once(spark, seed):
    """Events of one trace, of equal traces, and of several traces in one group and in two; times before 1970, too."""
    rows = traces(seed, 150)
    for t in rows[::4]:
        rows = [*rows, t, {**t, "entity_id": 2, "artifact_id": t["artifact_id"] + "x"}, {**t, "parser": "r"}]
    # a task is no service
    rows = [{**t, "time_ns": t["time_ns"] - 86_400 * SECOND, "entity_id": t["entity_id"] + 9 * (t["entity_kind"] == "scheduled_task")} for t in rows]
    found = correlate.rule_pairs(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3), ["entity_id"])
    wanted = all_pairs(rows)
    assert {x[0] for x in wanted} == set(WINDOWS)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_pairs_are_not_shuffled(spark):
    """Pairs of events with one trace each are as many as they are; no aggregate stands above their join."""
    found = correlate.rule_pairs(spark.createDataFrame([tuple(r.values()) for r in traces(1, 9)], SCHEMA), ["entity_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = plan[: next(i for i, x in enumerate(plan) if "Join " in x)]
    assert "Union" in above[0] and not any(k in x for x in above for k in ("Aggregate", "Repartition", "Sort", "Window"))


def test_no_traces(spark):
    found, summary = correlate.evaluated(spark.createDataFrame([], SCHEMA), ["entity_id"])
    assert found.collect() == [] and tuple(summary.first()) == (0, 0, False)


def test_no_more_pairs_than_the_limit(spark):
    """Two thousand traces at one moment are two million comparisons, of which a hundred are made."""
    hot = spark.range(2000).select(F.col("id").alias("event_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("artifact_id"), F.lit(1).cast("bigint").alias("entity_id"), F.lit("file").alias("entity_kind"), F.lit("executable").alias("role"), F.lit("process_start").alias("kind"), F.lit("event_time").alias("semantics"), F.lit("p").alias("parser"), F.lit(5).cast("bigint").alias("time_ns"))
    pairs, total = correlate.comparisons_of(hot, ["entity_id"], 100)
    assert sorted(r.number for r in pairs.collect()) == list(range(100)) and total.first().total == 2000 * 1999 // 2
