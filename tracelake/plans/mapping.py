"""Mappers of activity, persistence and credentials over findings made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import mappers, normalize
from tracelake.session import table

from .registry import query

CASE = "0123456789abcdef0123456789abcdef"
# domain, name, source, attributes
FINDINGS = (
    ("useraktivitaet", "C:\\Tools\\a.exe", "HKCU ann\\UA", {"art": "userassist", "benutzer": "Ann", "hive_offset": "1", "letzte_ausfuehrung_unix": "UNIX"}),
    ("useraktivitaet", "Microsoft.App", "HKCU ann\\UA", {"art": "userassist", "benutzer": "Ann", "hive_offset": "1"}),
    ("useraktivitaet", "HTTP://A.example/X", "HKCU ann\\T", {"art": "typed_url", "benutzer": "Ann", "hive_offset": "1", "eingegeben_unix": "UNIX"}),
    ("useraktivitaet", "a.txt", "HKCU ann\\R", {"art": "recent_doc", "benutzer": "Ann", "hive_offset": "1", "mru_position": "0", "key_letzte_aenderung_unix": "UNIX"}),
    ("useraktivitaet", "b.txt", "HKCU ann\\R", {"art": "recent_doc", "benutzer": "Ann", "mru_position": "1", "key_letzte_aenderung_unix": "UNIX"}),
    ("useraktivitaet", "cmd", "HKCU ann\\M", {"art": "run_mru", "benutzer": "Ann", "hive_offset": "1", "mru_position": "0", "key_letzte_aenderung_unix": "UNIX"}),
    ("persistence", "Spooler", "SYSTEM\\ControlSet001\\Services\\Spooler", {"ort": "Dienst", "befehl": "C:\\Windows\\spoolsv.exe -k", "hive_offset": "1"}),
    ("persistence", "Job", "Windows\\System32\\Tasks\\Job", {"ort": "Aufgabe", "befehl": "\"C:\\x\\j.exe\" /q", "benutzer": "DOM\\Ben", "mft_record": "7", "mft_record_offset": "7168", "datei_erstellt_unix": "UNIX"}),
    ("persistence", "Upd", "HKCU ann\\Software\\Run", {"ort": "HKCU ann", "befehl": "upd.exe", "benutzer": "ann", "hive_offset": "1"}),
    ("persistence", "a.lnk", "C:\\Users\\a\\Startup\\a.lnk", {"ort": "Autostart-Ordner"}),
    ("lsa", "_SC_Spooler", "SECURITY\\Policy", {"hive_offset": "1", "wert": "geheim"}),
    ("dpapi", "key", "C:\\Protect\\S-1-5-21-9\\guid", {"guid": "GUID-1", "mft_record": "1"}),
    ("usb", "Stick", "SYSTEM\\Enum", {"seriennummer": "S1", "benutzer": "ann"}),
    ("browser", "x", "C:\\Users\\ann\\History", {"url": "file:///C:/d/e.txt"}),
)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's installation with all findings; times are the part's number in seconds."""
    value = lambda v: F.col("p_partkey").cast("string") if v == "UNIX" else F.lit(v)
    rows = [F.struct(F.lit(i).cast("bigint").alias("n"), F.lit(d).alias("domain"), F.lit(name).alias("name"), F.lit(source).alias("source"), F.create_map(*(x for k, v in attributes.items() for x in (F.lit(k), value(v)))).alias("attributes")) for i, (d, name, source, attributes) in enumerate(FINDINGS)]
    every = table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(*rows)))
    return every.withColumns({"ordinal": F.col("p_partkey") * 100 + F.col("n"), "host": F.concat(F.lit("PC"), F.col("p_partkey").cast("string"))})


_EVENTS = "(0, 'process_start', 'parsed', true), (2, 'url_typed', 'parsed', true), (3, 'file_accessed', 'derived', true), (5, 'command_entered', 'derived', true), (7, 'scheduled_task_created', 'derived', true)"


@query(f"SELECT p_partkey, n::BIGINT AS n, kind, derivation, located, strftime(make_timestamp(p_partkey * 1000000), '%Y-%m-%dT%H:%M:%S') || '.0000000Z' AS time FROM part, (VALUES {_EVENTS}) v(n, kind, derivation, located)")
def mapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of findings; entries behind position 0 and things without a time tell of none."""
    mapped = normalize.map_findings(findings(spark, sf_dir), CASE)
    return mapped.where("told AND domain IN ('useraktivitaet', 'persistence')").select("p_partkey", "n", "kind", "derivation", "located", "time")


_ENTITIES = r"""(0, 'executable', 'file', 'pfad:c:\tools\a.exe'), (1, 'executable', 'application', 'programm:microsoft.app'), (2, 'object', 'url', 'url:http://a.example/X'), (3, 'file', 'file', 'dateiname:a.txt'), (4, 'file', 'file', 'dateiname:b.txt'),
(6, 'object', 'service', 'dienst:HOST:spooler'), (7, 'object', 'scheduled_task', 'aufgabe:HOST:job'), (8, 'object', 'registry_value', 'registry:HOST:ntuser.dat ann:software\run\upd'), (9, 'object', 'file', 'pfad:c:\users\a\startup\a.lnk'),
(10, 'object', 'credential', 'credential:HOST:lsa:_sc_spooler'), (11, 'object', 'credential', 'credential:dpapi_masterkey:guid-1')"""


@query(f"SELECT p_partkey, n::BIGINT AS n, role, entity_kind, replace(canonical_key, 'HOST', 'pc' || p_partkey) AS canonical_key FROM part, (VALUES {_ENTITIES}) v(n, role, entity_kind, canonical_key)")
def mapped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings are about, but for users and hosts; secrets are in no key."""
    mapped = normalize.map_findings(findings(spark, sf_dir), CASE)
    rows = mapped.select("p_partkey", "n", "domain", F.explode("participants").alias("p")).where("n < 12 AND p.role NOT IN ('user', 'host')")
    return rows.select("p_partkey", "n", "p.role", "p.entity_kind", "p.canonical_key")


_EDGES = r"""(0, 'USES', 'name:ann', 'pfad:c:\tools\a.exe'), (1, 'USES', 'name:ann', 'programm:microsoft.app'), (2, 'USES', 'name:ann', 'url:http://a.example/X'), (3, 'USES_FILE', 'name:ann', 'dateiname:a.txt'), (4, 'USES_FILE', 'name:ann', 'dateiname:b.txt'),
(6, 'EXECUTES', 'dienst:HOST:spooler', 'pfad:c:\windows\spoolsv.exe'), (6, 'INSTALLED_ON', 'dienst:HOST:spooler', 'host:HOST'), (7, 'EXECUTES', 'aufgabe:HOST:job', 'pfad:c:\x\j.exe'), (7, 'INSTALLED_ON', 'aufgabe:HOST:job', 'host:HOST'), (7, 'BELONGS_TO', 'aufgabe:HOST:job', 'name:dom\ben'),
(8, 'BELONGS_TO', 'registry:HOST:ntuser.dat ann:software\run\upd', 'name:ann'), (9, 'INSTALLED_ON', 'pfad:c:\users\a\startup\a.lnk', 'host:HOST'), (10, 'BELONGS_TO', 'credential:HOST:lsa:_sc_spooler', 'dienst:HOST:spooler'), (11, 'BELONGS_TO', 'credential:dpapi_masterkey:guid-1', 'sid:S-1-5-21-9'),
(12, 'USES', 'name:ann', 'usb:S1'), (12, 'LOCATED_ON', 'usb:S1', 'host:HOST'), (13, 'USES', 'name:ann', 'url:file:///C:/d/e.txt'), (13, 'REFERENCES', 'url:file:///C:/d/e.txt', 'pfad:c:\d\e.txt')"""


@query(f"SELECT p_partkey, n::BIGINT AS n, kind, replace(source_key, 'HOST', 'pc' || p_partkey) AS source_key, replace(target_key, 'HOST', 'pc' || p_partkey) AS target_key FROM part, (VALUES {_EDGES}) v(n, kind, source_key, target_key)")
def stated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationships that findings state, by the keys of their ends."""
    return findings(spark, sf_dir).select("p_partkey", "n", F.inline(normalize.stated_edges())).select("p_partkey", "n", "kind", "source_key", "target_key")


@query("""SELECT domain, n * (SELECT count(*) FROM part) AS mapped, 0::BIGINT AS no_mapper, i * (SELECT count(*) FROM part) AS incomplete_locator FROM (VALUES ('useraktivitaet', 6, 1), ('persistence', 4, 1), ('lsa', 1, 0), ('dpapi', 1, 0), ('usb', 1, 1), ('browser', 1, 1)) v(domain, n, i)""")
def mapping_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.statistics(normalize.map_findings(findings(spark, sf_dir), CASE))
