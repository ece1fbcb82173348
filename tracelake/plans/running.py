"""The analyzer runner over evidence rows that are made of the columns of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import registry, runner
from tracelake.session import table

from .registry import query

TICKS = 116444736000000000


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a part: nine kinds of values and files by its key; images by size, each with its own control set, host and clock; snapshots by brand."""
    n = F.col("p_partkey")
    kind, image = (n % 10).cast("int"), F.concat(F.lit("i"), (F.col("p_size") % 5).cast("string"))
    pick = lambda *options: F.get(F.array(*(F.lit(o) if not hasattr(o, "cast") else o for o in options)), kind)
    none = F.lit(None).cast("string")
    current = F.concat(F.lit("ControlSet00"), (F.col("p_size") % 5 % 2 + 1).cast("string"))
    set_one = F.when(n % 20 < 10, current).otherwise("ControlSet009")
    name, file = F.col("p_name"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".exe"))
    seconds = n * 1000 + F.lit(1_700_000_000)
    ticks = F.lpad(F.hex(seconds * 10_000_000 + F.lit(TICKS)), 16, "0")
    data = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(ticks, F.lit(".."), 0)), ""))
    run, logon, windows, options = registry.RUN_KEYS[0], registry.WINLOGON, registry.WINDOWS, registry.IMAGE_OPTIONS
    rows = table(spark, sf_dir, "part").select(
        n.alias("id"), image.alias("image"), pick("NTUSER", "SOFTWARE", "SOFTWARE", "SOFTWARE", "SYSTEM", "NTUSER", none, none, none, "SOFTWARE").alias("hive"), F.when(kind.isin(0, 5), F.concat(F.lit("u"), (n % 7).cast("string"))).alias("user"),
        pick(f"Software\\{run}", logon, windows, F.concat(F.lit(options + "\\"), file), F.concat(set_one, F.lit("\\Services\\bam\\State\\UserSettings\\S-1-5-"), (n % 9).cast("string")), F.concat(F.lit(registry.EXPLORER + "\\MountPoints2\\"), F.when(n % 3 == 0, "CPC").otherwise(file)), none, none, none, "Other\\Key").alias("key"),
        pick(name, F.when(n % 20 < 10, "shell").otherwise("Userinit"), "APPINIT_DLLS", "Debugger", F.concat(F.lit("C:\\"), file), "x", none, none, none, name).alias("name"),
        pick(name, F.when(n % 3 == 0, "C:\\Explorer.exe").otherwise(name), F.when(n % 3 == 0, "  ").otherwise(name), name, none, none, none, none, F.concat(F.lit("# "), name, F.lit("\r\n HiddenServicePort 80\nx")), name).alias("text"),
        F.when(kind == 4, F.when(n % 7 == 0, F.substring(data, 1, 4)).otherwise(data)).alias("data"), (n * 16).alias("hive_offset"), F.when(n % 4 != 0, n * 8).alias("key_offset"), (seconds * 10_000_000 + F.lit(TICKS)).cast("decimal(20,0)").alias("key_filetime"),
        F.when(kind == 6, F.concat(F.lit("Users\\x\\AppData\\Start Menu\\Programs\\Startup\\"), F.when(n % 3 == 0, "desktop.ini").otherwise(file))).when(kind == 7, F.concat(F.lit("Windows\\Prefetch\\"), F.upper(file), F.lit("-0000ab"), F.lpad(F.hex(n % 256), 2, "0"), F.lit(".pf"))).when(kind == 8, "Tor\\torrc").alias("path"),
        F.when(kind.isin(6, 7, 8), n * 32).alias("file_offset"), F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("VSS#"), F.col("p_size").cast("string"))).alias("origin"), F.when(F.col("p_brand").endswith("1"), F.col("p_size").cast("bigint")).alias("origin_volume"), F.when(F.col("p_brand").endswith("1"), seconds * 10_000_000 + F.lit(TICKS)).alias("origin_created"),
    )
    base = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).alias("s")).agg(F.max("p_partkey").alias("top"))
    value = lambda key, name, text: F.struct(F.concat(F.lit("i"), F.col("s").cast("string")).alias("image"), F.lit("SYSTEM").alias("hive"), key.alias("key"), F.lit(name).alias("name"), text.cast("string").alias("text"))
    own = lambda rest: F.concat(F.lit("ControlSet00"), (F.col("s") % 2 + 1).cast("string"), F.lit("\\" + rest))
    control = base.select(F.inline(F.array(
        value(F.lit("Select"), "Current", F.col("s") % 2 + 1), value(own("Control\\ComputerName\\ComputerName"), "ComputerName", F.concat(F.lit("PC"), F.col("top").cast("string"))),
        value(F.lit("ControlSet009\\Control\\ComputerName\\ComputerName"), "ComputerName", F.lit("OLD")), value(own("Control\\TimeZoneInformation"), "ActiveTimeBias", F.col("s") * -60),
    )))
    return rows.unionByName(control, allowMissingColumns=True)


_SQL = r"""
WITH p AS (SELECT p_partkey AS n, p_partkey % 10 AS kind, p_name AS name, replace(p_name, ' ', '_') || '.exe' AS file, p_size % 5 AS s, p_partkey % 20 < 10 AS low, p_brand LIKE '%1' AS snap, p_size FROM part),
pc AS (SELECT p_size % 5 AS s, 'PC' || max(p_partkey) AS host FROM part GROUP BY 1),
f AS (
 SELECT n, 'run_keys' AS analyzer, 'persistence' AS domain, name, 'HKCU u' || n % 7 AS source, name AS detail, CASE WHEN n % 4 <> 0 THEN n * 8 END AS "offset" FROM p WHERE kind = 0 AND NOT snap
 UNION ALL SELECT n, 'winlogon', 'persistence', CASE WHEN low THEN 'shell' ELSE 'Userinit' END, 'HKLM SOFTWARE', CASE WHEN low AND n % 3 = 0 THEN 'nein' ELSE 'ja' END, CASE WHEN n % 4 <> 0 THEN n * 8 END FROM p WHERE kind = 1 AND NOT snap
 UNION ALL SELECT n, 'appinit', 'persistence', 'AppInit_DLLs', 'HKLM SOFTWARE', 'ja', CASE WHEN n % 4 <> 0 THEN n * 8 END FROM p WHERE kind = 2 AND NOT snap AND n % 3 <> 0
 UNION ALL SELECT n, 'ifeo', 'persistence', file, 'HKLM SOFTWARE', 'ja', CASE WHEN n % 4 <> 0 THEN n * 8 END FROM p WHERE kind = 3 AND NOT snap
 UNION ALL SELECT n, 'last_executions', 'programmausfuehrung', 'C:\' || file, 'SYSTEM', host || ' ' || strftime(to_timestamp(n * 1000 + 1700000000 + s * 3600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), CASE WHEN n % 4 <> 0 THEN n * 8 END FROM p JOIN pc USING (s) WHERE kind = 4 AND NOT snap AND low AND n % 7 <> 0
 UNION ALL SELECT n, 'mount_points', 'usb', file, 'HKCU u' || n % 7, (n * 1000 + 1700000000)::VARCHAR, CASE WHEN n % 4 <> 0 THEN n * 8 END FROM p WHERE kind = 5 AND NOT snap AND n % 3 <> 0
 UNION ALL SELECT n, 'startup_folders', 'persistence', file, 'Users', 'Autostart-Ordner', n * 32 FROM p WHERE kind = 6 AND n % 3 <> 0
 UNION ALL SELECT n, 'prefetch_names', 'programmausfuehrung', upper(file), 'Windows', '0000AB' || lpad(printf('%X', n % 256), 2, '0'), n * 32 FROM p WHERE kind = 7
 UNION ALL SELECT n, 'onion_services', 'tor', 'HiddenServicePort 80', 'Tor', 'torrc_direktive', n * 32 FROM p WHERE kind = 8)"""


@query(_SQL + r"""
SELECT n AS id, analyzer, domain, f.name, source, detail, f."offset", CASE WHEN snap THEN 'VSS#' || p_size || ' ' || p_size || ' ' || strftime(to_timestamp(n * 1000 + 1700000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') END AS origin FROM f JOIN p USING (n)""")
def analyzer_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All analyzers in one scan, with each image's control set, host and clock, and what snapshots add."""
    rows = _evidence(spark, sf_dir)
    found = runner.run(rows, runner.ANALYZERS, runner.contexts(rows), keep=["id"]).where("warning IS NULL")
    of = lambda *names: F.coalesce(*(F.col("attributes")[n] for n in names))
    detail = F.when(F.col("analyzer") == "last_executions", F.concat_ws(" ", of("rechner"), of("letzte_ausfuehrung_ortszeit"))).when(F.col("analyzer") == "run_keys", of("befehl")).when(F.col("analyzer") == "mount_points", of("letzter_zugriff_unix")).otherwise(of("auffaellig", "pfad_hash", "art", "ort"))
    origin = F.when(of("herkunft").isNotNull(), F.concat_ws(" ", of("herkunft"), of("vss_volume_offset"), F.left(of("vss_erstellt_utc"), F.lit(19))))
    return found.select("id", "analyzer", "domain", "name", F.regexp_extract("source", r"^([^\\]*)", 1).alias("source"), detail.alias("detail"), "offset", origin.alias("origin"))


@query(_SQL + r""",
every(place, analyzer, domain) AS (VALUES (0, 'run_keys', 'persistence'), (1, 'winlogon', 'persistence'), (2, 'appinit', 'persistence'), (3, 'ifeo', 'persistence'), (4, 'last_executions', 'programmausfuehrung'), (5, 'mount_points', 'usb'), (6, 'startup_folders', 'persistence'), (7, 'prefetch_names', 'programmausfuehrung'), (8, 'onion_services', 'tor'))
SELECT place, analyzer, e.domain, count(f.n) AS findings, CASE WHEN place = 4 THEN (SELECT count(*) FROM p WHERE kind = 4 AND NOT snap AND n % 7 = 0) ELSE 0 END AS warnings FROM every e LEFT JOIN f USING (analyzer) GROUP BY ALL""")
def analyzer_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and warnings of each analyzer."""
    rows = _evidence(spark, sf_dir)
    return runner.status(runner.run(rows, runner.ANALYZERS, runner.contexts(rows)), runner.ANALYZERS)
