"""The analyzer runner: one scan, tags, order, statuses, observation and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import artifacts, registry, runner

RUN = "Software\\" + registry.RUN_KEYS[0]


def rows(spark):
    values = [("i", "NTUSER", "ann", RUN, "b", "b.exe", 20), ("i", "NTUSER", "ann", RUN, "a", "a.exe", None), ("j", "SOFTWARE", None, registry.WINLOGON, "Shell", "x", 10)]
    files = [("i", "C\\start menu\\programs\\startup\\x.lnk", 5, None, None, None), ("i", "C\\Start Menu\\Programs\\Startup\\x.lnk", 4, "VSS#2", 7, 116444736000000000), ("i", None, None, None, None, None)]
    return runner.evidence(
        spark.createDataFrame(values, "image string, hive string, user string, key string, name string, text string, key_offset bigint"),
        spark.createDataFrame(files, "image string, path string, file_offset bigint, origin string, origin_volume bigint, origin_created bigint"),
    )


def test_order_tags_and_status(spark):
    found = runner.run(rows(spark), runner.ANALYZERS[:4] + runner.ANALYZERS[6:])
    seen = [(r.analyzer, r.name, r.offset, r.origin) for r in runner.ordered(found).collect()]
    assert seen == [("run_keys", "a", None, None), ("startup_folders", "x.lnk", 4, "VSS#2"), ("startup_folders", "x.lnk", 5, None), ("winlogon", "Shell", 10, None), ("run_keys", "b", 20, None)]
    old = found.where("origin IS NOT NULL").collect()[0].attributes
    assert old["herkunft"] == "VSS#2" and old["vss_volume_offset"] == "7" and old["vss_erstellt_utc"].startswith("1970-01-01T00:00:00")
    assert [(r.analyzer, r.findings) for r in runner.status(found, runner.ANALYZERS[:4] + runner.ANALYZERS[6:]).collect()] == [("run_keys", 2), ("winlogon", 1), ("appinit", 0), ("ifeo", 0), ("startup_folders", 2), ("prefetch_names", 0), ("onion_services", 0)]


def test_only_file_analyzers_see_snapshots(spark):
    old = rows(spark).withColumn("origin", F.lit("VSS#1"))
    assert {r.analyzer for r in runner.run(old, runner.ANALYZERS, runner.contexts(old)).collect()} == {"startup_folders"}


def test_one_scan_and_counts_on_the_way(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "evidence"))
    stored = spark.read.parquet(str(tmp_path / "evidence"))
    analyzers = [runner.Analyzer(f"files{k}", "x", lambda: runner.only(F.col("path").isNotNull(), runner.finding(artifacts.file_name("path"), F.col("path"))), True) for k in range(5)]
    found, status = runner.observed(runner.run(stored, analyzers), analyzers)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    found.write.parquet(str(tmp_path / "found"))
    assert [(s["analyzer"], s["findings"], s["warnings"]) for s in status()] == [(f"files{k}", 2, 0) for k in range(5)]


def test_warnings(spark):
    warns = runner.Analyzer("w", "d", lambda: F.lit(None).cast(f"array<{runner._FINDING}>"), True, lambda: F.when(F.col("path").isNotNull(), F.lit("unlesbar")))
    found = runner.run(rows(spark), [warns])
    assert sorted(r.warning for r in found.collect()) == ["[d] VSS#2: unlesbar", "[d] unlesbar"]
    assert runner.ordered(found).count() == 0 and runner.status(found, [warns]).first().warnings == 2


def test_context(spark):
    base = [("i", "SYSTEM", "Select", "current", "2"), ("i", "SYSTEM", "ControlSet002\\Control\\ComputerName\\ComputerName", "ComputerName", "PC"), ("i", "SYSTEM", "controlset001\\control\\computername\\computername", "ComputerName", "OLD"), ("i", "SYSTEM", "ControlSet002\\Control\\TimeZoneInformation", "ActiveTimeBias", "-120"), ("j", "SYSTEM", "ControlSet001\\Control\\Nls\\CodePage", "ACP", "1252"), ("k", "SOFTWARE", "Select", "Current", "1")]
    frame = spark.createDataFrame([(*b, None) for b in base], "image string, hive string, key string, name string, text string, origin string")
    found = {r.image: r.context for r in runner.contexts(frame).collect()}
    assert tuple(found["i"]) == ("ControlSet002", "PC", None, -120, None) and tuple(found["j"]) == ("ControlSet001", None, None, None, "1252") and set(found) == {"i", "j"}
    local = runner.contexts(frame).where("image = 'i'").select(runner.local_time(F.lit("2024-06-01 10:00:00").cast("timestamp")).cast("string")).first()[0]
    assert local == "2024-06-01 12:00:00"
