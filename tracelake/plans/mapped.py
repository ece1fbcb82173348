"""Mappers of event logs, prefetch files and executed programs over findings that are made of events, column by column; and times in the forms that evidence has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import timefn
from tracelake.operators import graph, normalize
from tracelake.session import table
from tracelake.workspace import shared_folder

from .registry import query
from .timeline import micros

CASE = "0123456789abcdef0123456789abcdef"
DOMAINS = ("eventlog", "prefetch", "programmausfuehrung")
EPOCH = timefn.EPOCH_TICKS
_NUMBERS = ("4624", "4625", "4634", "4720", "1102", "9999")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding an event: of five kinds by its number, with and without locators, security ids and domains, live and from a snapshot."""
    n, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_id") % 5
    text = lambda c: c.cast("string")
    ticks, unix = text(micros("ts") * 10 + EPOCH), text(F.floor(micros("ts") / 1000000).cast("bigint"))
    when = lambda test, value: F.when(test, value if isinstance(value, Column) else F.lit(value))
    program = kind.isin(2, 3, 4)
    values = {
        "event_id": when(kind == 0, F.get(F.array(*map(F.lit, _NUMBERS)), (F.floor(n / 5) % 6).cast("int"))), "event_record_id": when(kind == 0, text(n)), "datei_offset": when(kind == 0, text(n)), "filetime": when(kind == 0, ticks),
        "volume_offset": when(n % 2 == 0, "0"), "mft_record": when(n % 3 != 0, "9"), "herkunft": F.when(n % 7 == 0, "VSS#1").otherwise("live"),
        "benutzer": when(kind == 0, F.concat(F.lit("U"), text(u))), "benutzer_sid": when(kind == 0, F.when(u % 3 == 0, F.concat(F.lit("s-1-5-21-"), text(u))).otherwise("-")), "benutzer_domaene": when(kind == 0, F.when(u % 2 == 0, "DOM").otherwise(".")),
        "quell_ip": when(kind == 0, F.when(n % 4 == 0, F.concat(F.lit("10.0.0."), text(u % 250))).otherwise("-")),
        "quelle": F.when(kind == 2, "amcache").when(kind == 3, "shimcache"), "art": when(kind == 4, "bam"), "pfad": when(program & (n % 2 == 0), F.concat(F.lit("C:\\T/"), F.col("event_type"), text(n), F.lit(".exe"))), "hive_offset": when(program & (n % 3 == 0), text(n)),
        "eintrag": when((kind == 3) & (n % 2 == 0), text(n)), "sid": when(kind == 4, F.concat(F.lit("S-1-5-"), text(u), F.lit("-1"))),
        "letzte_ausfuehrung_unix": when(kind.isin(1, 4), unix), "letzte_ausfuehrung_filetime": when(kind == 4, F.when(n % 2 == 0, ticks).otherwise("0")), "registriert_unix": when((kind == 2) & (n % 11 != 0), unix), "letzte_aenderung_filetime": when(kind == 3, ticks),
    }
    attributes = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())), lambda k, v: v.isNotNull())
    domain = F.when(kind == 0, "eventlog").when(kind == 1, "prefetch").otherwise("programmausfuehrung")
    return table(spark, sf_dir, "events").select(n.alias("ordinal"), domain.alias("domain"), F.concat(F.upper("event_type"), F.lit(".EXE")).alias("name"), F.concat(F.lit("S\\"), F.col("event_type"), text(u)).alias("source"), attributes.alias("attributes"), F.concat(F.lit("PC"), text(u % 9)).alias("host"))


_SQL = r"""WITH e AS (SELECT *, event_id AS n, user_id AS u, event_id % 5 AS k, upper(event_type) || '.EXE' AS name, 'S\' || event_type || user_id AS source, CASE WHEN event_id % 7 = 0 THEN ':VSS#1' ELSE '' END AS origin,
 CASE WHEN event_id % 2 = 0 THEN '0' ELSE '?' END AS volume, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' AS second, lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || '0Z' AS fraction FROM events)"""


@query(_SQL + r"""
SELECT n AS ordinal, CASE k WHEN 0 THEN ['user_logon', 'authentication_attempt', 'user_logoff', 'account_created', 'log_cleared', 'unbekannt'][n // 5 % 6 + 1] WHEN 2 THEN 'amcache_recorded' WHEN 3 THEN 'file_modified' ELSE 'process_start' END AS kind,
 CASE k WHEN 0 THEN 'evtx:' || volume || ':' || CASE WHEN n % 3 <> 0 THEN '9' ELSE '?' END || ':' || n WHEN 1 THEN 'prefetch:' || volume || ':' || CASE WHEN n % 3 <> 0 THEN '9' ELSE lower(source) END WHEN 2 THEN 'registry:' || source
  WHEN 3 THEN 'registry:' || source || ':' || CASE WHEN n % 2 = 0 THEN n::VARCHAR ELSE '?' END ELSE 'registry:' || source || ':' || name END || origin AS key,
 CASE WHEN k IN (0, 3) OR k = 4 AND n % 2 = 0 THEN second || fraction WHEN k = 2 AND n % 11 = 0 THEN NULL ELSE second || '0000000Z' END AS time, CASE WHEN k = 3 THEN 'derived' ELSE 'parsed' END AS derivation,
 CASE WHEN k IN (0, 1) THEN n % 3 <> 0 ELSE n % 3 = 0 END AS located, NOT (k = 2 AND n % 11 = 0) AS told FROM e""")
def mapper_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each finding tells of: kind, key, time, derivation, and whether it says where it lies."""
    return normalize.map_findings(findings(spark, sf_dir), CASE, DOMAINS).select("ordinal", "kind", "key", "time", "derivation", F.coalesce("located", F.lit(False)).alias("located"), "told")


@query(_SQL + r"""
SELECT n AS ordinal, 'host' AS role, 'host' AS entity_kind, 'host:pc' || u % 9 AS canonical_key, 'PC' || u % 9 AS name FROM e
UNION ALL SELECT n, 'user', 'windows_user', CASE WHEN u % 3 = 0 THEN 'sid:S-1-5-21-' || u WHEN u % 2 = 0 THEN 'name:dom\u' || u ELSE 'name:u' || u END, 'U' || u FROM e WHERE k = 0
UNION ALL SELECT n, 'source', 'ip_address', 'ip:10.0.0.' || u % 250, '10.0.0.' || u % 250 FROM e WHERE k = 0 AND n % 4 = 0
UNION ALL SELECT n, 'executable', 'application', 'programm:' || lower(name), name FROM e WHERE k = 1
UNION ALL SELECT n, CASE WHEN k = 4 THEN 'executable' ELSE 'file' END, 'file', CASE WHEN n % 2 = 0 THEN 'pfad:c:\t\' || event_type || n || '.exe' ELSE 'dateiname:' || lower(name) END, CASE WHEN n % 2 = 0 THEN 'C:\T/' || event_type || n || '.exe' ELSE name END FROM e WHERE k >= 2
UNION ALL SELECT n, 'user', 'windows_user', 'sid:S-1-5-' || u || '-1', 'S-1-5-' || u || '-1' FROM e WHERE k = 4""")
def mapper_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who and what takes part in each finding."""
    mapped = normalize.map_findings(findings(spark, sf_dir), CASE, DOMAINS)
    return mapped.select("ordinal", F.inline("participants")).select("ordinal", "role", "entity_kind", "canonical_key", "name")


@query(_SQL + r""",
a AS (SELECT u, 'ACCOUNT_ON' AS kind, CASE WHEN k = 4 THEN 'sid:S-1-5-' || u || '-1' WHEN u % 3 = 0 THEN 'sid:S-1-5-21-' || u WHEN u % 2 = 0 THEN 'name:dom\u' || u ELSE 'name:u' || u END AS source, 'host:pc' || u % 9 AS target, n FROM e WHERE k IN (0, 4))
SELECT kind, source, target, min(n) AS first_ordinal, count(*) AS n_sources, min(n) AS primary_ordinal FROM a GROUP BY ALL""")
def mapper_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts on hosts as findings state them: the first wins, later ones support it. Ends are named by their keys, ids being hashes."""
    folder = shared_folder(spark, "mapped")
    normalize.map_findings(findings(spark, sf_dir), CASE, DOMAINS).write.parquet(folder)  # read several times
    mapped = spark.read.parquet(folder)
    edges = normalize.relationships(mapped, CASE, DOMAINS).where("kind = 'ACCOUNT_ON'")
    people = mapped.select(F.inline("participants")).select("entity_kind", "canonical_key").distinct()
    named = people.select(normalize.entity_id(CASE, F.col("entity_kind"), F.col("canonical_key")).alias("id"), "canonical_key")
    full = edges.join(named.select(F.col("id").alias("source"), F.col("canonical_key").alias("s")), "source").join(named.select(F.col("id").alias("target"), F.col("canonical_key").alias("t")), "target")
    p = lambda role: F.get(F.filter("participants", lambda x: x["role"] == role), F.lit(0))["canonical_key"]
    stated = mapped.select("ordinal", F.lit("ACCOUNT_ON").alias("kind"), p("user").alias("source"), p("host").alias("target")).where("source IS NOT NULL")
    first = graph.merged(stated).where("role = 'primary'").select("kind", F.col("source").alias("s"), F.col("target").alias("t"), F.col("ordinal").alias("primary_ordinal"))
    return full.join(first, ["kind", "s", "t"]).select("kind", F.col("s").alias("source"), F.col("t").alias("target"), "first_ordinal", "n_sources", "primary_ordinal")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '1601-01-01T00:00:00.0000000Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || '7Z' END AS spelt, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS stamped,
 CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000000 END AS chromium, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) // 1000000 END AS firefox FROM events""")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as text, where zero is a time, and as a timestamp; browsers' microseconds since 1601 and since 1970, unset and before 1970 too."""
    n, us = F.col("event_id"), micros("ts")
    ticks = F.when(n % 5 == 0, 0).otherwise(us * 10 + EPOCH + 7)
    chromium = F.when(n % 3 != 0, us + F.lit(11_644_473_600_000_000)).when(n % 2 == 0, 0).otherwise(1_000_000)
    firefox = F.when(n % 4 != 0, us).otherwise(-n)
    stamped = F.when(n % 5 != 0, F.unix_micros(timefn.filetime_timestamp(ticks)))
    return table(spark, sf_dir, "events").select("event_id", timefn.filetime_iso(ticks, zero_is_null=False).alias("spelt"), stamped.alias("stamped"), timefn.chromium_unix(chromium).alias("chromium"), timefn.firefox_unix(firefox).alias("firefox"))
