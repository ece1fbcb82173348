"""The analyzer runner: all analyzers in one scan of the evidence, on a context that is built once for all of them.

Evidence rows are registry values and files in one table (``evidence`` unites two), live or from a snapshot. An analyzer is a Column: the
findings that a row gives, as an array. The runner tags each analyzer's array with its place and explodes all of them
together, so that a further analyzer adds an expression and no scan, join or shuffle. What analyzers have to know of an
installation as a whole (its control set, host, time zone and code page) is one row an image, aggregated in one pass and joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracelake.functions import bytesfn, timefn
from tracelake.operators import artifacts, registry

#: columns of evidence rows and their types
EVIDENCE = {
    "image": "string", "hive": "string", "user": "string", "key": "string", "name": "string", "text": "string", "data": "binary", "hive_offset": "bigint", "key_offset": "bigint", "key_filetime": "decimal(20,0)",
    "path": "string", "file_offset": "bigint", "origin": "string", "origin_volume": "bigint", "origin_created": "bigint",
}
_FINDING = "struct<name:string,source:string,offset:bigint,attributes:map<string,string>>"

#: fixed values: where an installation's base data stand below its control set: field, key, value name
BASE_DATA = (
    ("host", r"Control\ComputerName\ComputerName", "ComputerName"), ("time_zone", r"Control\TimeZoneInformation", "TimeZoneKeyName"),
    ("bias_minutes", r"Control\TimeZoneInformation", "ActiveTimeBias"), ("code_page", r"Control\Nls\CodePage", "ACP"),
)


class Analyzer(NamedTuple):
    """``found`` is a row's findings, an array of ``finding``s, or null; ``warning`` a text or null. File-based ones see snapshots too."""

    name: str
    domain: str
    found: Callable[[], Column]
    file_based: bool = False
    warning: Callable[[], Column] | None = None


def finding(name: Column, source: Column, offset: Column | None = None, **attributes: Column) -> Column:
    offset = F.lit(None) if offset is None else offset
    return F.struct(name.cast("string").alias("name"), source.cast("string").alias("source"), offset.cast("bigint").alias("offset"), registry.attributes(**attributes).alias("attributes")).cast(_FINDING)


def only(test: Column, *findings: Column) -> Column:
    """The findings of rows that pass a test."""
    return F.when(test, F.array(*findings))


def evidence(values: DataFrame, files: DataFrame) -> DataFrame:
    """Both tables as evidence rows; columns that a table lacks are null, others stay out."""
    def all_columns(df: DataFrame) -> DataFrame:
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EVIDENCE.items()))

    return all_columns(values).unionByName(all_columns(files))


def contexts(rows: DataFrame) -> DataFrame:
    """``image`` and ``context``: control set in use (ControlSet001 where none is named), host, time zone, bias and ANSI code page, of live values.

    Only the values in question leave the scan, a few an image and control set; a set that isn't in use may name another host.
    """
    number = F.lpad(F.regexp_extract("text", "^([0-9]{1,3})$", 1), 3, "0")
    low = F.lower("key")
    own = F.regexp_extract(low, r"^(controlset[0-9]{3})\\", 1)
    field = F.when(registry._is("key", "Select") & registry._is("name", "Current"), "current")
    for name, key, value in BASE_DATA:
        field = F.when((own != "") & (low == F.concat(own, F.lit("\\" + key.lower()))) & registry._is("name", value), name).otherwise(field)
    wanted = rows.where("hive = 'SYSTEM' AND text IS NOT NULL AND origin IS NULL").select("image", own.alias("set"), field.alias("field"), F.when(field == "current", number).otherwise(F.col("text")).alias("text")).where("field IS NOT NULL")
    one = wanted.groupBy("image", "set", "field").agg(F.min("text").alias("text"))
    listed = one.groupBy("image").agg(F.collect_list(F.struct("set", "field", "text")).alias("base"))
    control = F.concat(F.lit("ControlSet"), F.coalesce(F.get(F.filter("base", lambda b: b["field"] == "current"), F.lit(0))["text"], F.lit("001")))
    of = lambda name: F.get(F.filter("base", lambda b: (b["field"] == name) & (b["set"] == F.lower("control_set"))), F.lit(0))["text"]
    known = listed.withColumn("control_set", control)
    return known.select("image", F.struct("control_set", of("host").alias("host"), of("time_zone").alias("time_zone"), of("bias_minutes").try_cast("int").alias("bias_minutes"), of("code_page").alias("code_page")).alias("context"))


def _tagged(place: int, a: Analyzer) -> Column:
    live = F.col("origin").isNull()
    marks = registry.attributes(herkunft=F.col("origin"), vss_volume_offset=F.when(~live, F.col("origin_volume")), vss_erstellt_utc=F.when(~live, timefn.filetime_iso(F.col("origin_created"))))
    found = F.transform(a.found(), lambda f: F.struct(F.lit(place).alias("place"), F.lit(None).cast("string").alias("warning"), f["name"].alias("name"), f["source"].alias("source"), f["offset"].alias("offset"), F.map_concat(F.map_filter(f["attributes"], lambda k, _: ~k.isin("herkunft", "vss_volume_offset", "vss_erstellt_utc")), marks).alias("attributes")))
    if a.warning:
        said = a.warning()
        none = F.struct(F.lit(place).alias("place"), F.concat(F.lit(f"[{a.domain}] "), F.when(~live, F.concat(F.col("origin"), F.lit(": "))).otherwise(""), said).alias("warning"), *(F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("source", "string"), ("offset", "bigint"), ("attributes", "map<string,string>"))))
        found = F.concat(F.coalesce(found, F.array().cast(_RESULT)), F.when(said.isNotNull(), F.array(none.cast(_RESULT[6:-1]))).otherwise(F.array().cast(_RESULT)))
    seen = F.coalesce(found.cast(_RESULT), F.array().cast(_RESULT))
    return seen if a.file_based else F.when(live, seen).otherwise(F.array().cast(_RESULT))


_RESULT = "array<struct<place:int,warning:string,name:string,source:string,offset:bigint,attributes:map<string,string>>>"


def run(rows: DataFrame, analyzers: Sequence[Analyzer], context: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The findings and warnings of all analyzers: ``keep``, ``place``, ``analyzer``, ``domain``, ``name``, ``source``, ``offset``, ``origin``, ``attributes``, ``warning``.

    ``rows`` are read once. Findings from snapshots say so in their attributes. With ``context`` (``contexts``) rows have a
    column of that name; it is joined by image, and Spark broadcasts it where it measures small.
    """
    if not analyzers:
        raise ValueError("no analyzers")
    if context is not None:
        rows = rows.join(context, "image", "left")
    every = F.flatten(F.array(*(_tagged(k, a) for k, a in enumerate(analyzers))))
    names = lambda attribute: F.get(F.array(*(F.lit(getattr(a, attribute)) for a in analyzers)), F.col("place")).alias("analyzer" if attribute == "name" else attribute)
    kept = [c for c in keep if c not in ("origin", "name")]
    fanned = rows.select(*kept, "origin", F.inline(every))
    return fanned.select(*kept, "place", names("name"), names("domain"), "name", "source", "offset", "origin", "attributes", "warning")


def ordered(found: DataFrame, *ties: str) -> DataFrame:
    """Findings by domain and offset, those without one first; live ones before snapshots, analyzers in their order, then by source, name and ``ties``."""
    return found.where("warning IS NULL").orderBy("domain", "offset", F.col("origin").isNotNull(), "origin", "place", "source", "name", *ties)


def status(found: DataFrame, analyzers: Sequence[Analyzer]) -> DataFrame:
    """Findings and warnings of each analyzer, zero included, in the analyzers' order."""
    spark = found.sparkSession
    every = spark.createDataFrame([(k, a.name, a.domain) for k, a in enumerate(analyzers)], "place int, analyzer string, domain string")
    counts = found.groupBy("place").agg(F.count_if(F.col("warning").isNull()).alias("findings"), F.count_if(F.col("warning").isNotNull()).alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counts, "place", "left").select("place", "analyzer", "domain", zero("findings"), zero("warnings")).orderBy("place")


def observed(found: DataFrame, analyzers: Sequence[Analyzer]) -> tuple[DataFrame, Callable[[], list[dict]]]:
    """The same rows, counted as they pass, and the statuses for when they have been written."""
    seen = Observation("analyzers")
    counts = [c for k in range(len(analyzers)) for c in (F.count_if((F.col("place") == k) & F.col("warning").isNull()).alias(f"f{k}"), F.count_if((F.col("place") == k) & F.col("warning").isNotNull()).alias(f"w{k}"))]
    return found.observe(seen, *counts), lambda: [{"analyzer": a.name, "domain": a.domain, "findings": seen.get[f"f{k}"], "warnings": seen.get[f"w{k}"]} for k, a in enumerate(analyzers)]


def local_time(utc: Column) -> Column:
    """A UTC timestamp as the installation's clock showed it, by its bias (minutes that are added to local time to give UTC); null without one."""
    return F.when(F.col("context.bias_minutes").isNotNull(), F.timestamp_seconds(F.unix_timestamp(utc) - F.col("context.bias_minutes") * 60))


# ---- the analyzers


def _of(hive: str) -> Column:
    return F.col("hive") == hive


def _value() -> dict[str, Column]:
    return registry._where()


def _run_keys() -> Column:
    place = F.when(_of("NTUSER"), F.concat(F.lit("HKCU "), "user")).otherwise("HKLM SOFTWARE")
    here = (_of("SOFTWARE") & registry._is("key", *registry.RUN_KEYS)) | (_of("NTUSER") & registry._is("key", *(f"Software\\{k}" for k in registry.RUN_KEYS)))
    return only(here & (F.col("name") != ""), finding(F.col("name"), F.concat(place, F.lit("\\"), "key"), F.col("key_offset"), **_value(), befehl=F.coalesce("text", F.lit("")), ort=place, benutzer=F.when(_of("NTUSER"), F.col("user"))))


def _software(test: Column, name: Column, **attributes: Column) -> Column:
    return only(_of("SOFTWARE") & test, finding(name, F.concat(F.lit("HKLM SOFTWARE\\"), "key"), F.col("key_offset"), **_value(), befehl=F.col("text"), **attributes))


def _winlogon() -> Column:
    usual = F.lit(None).cast("boolean")
    for name, text in registry.WINLOGON_USUAL:
        usual = F.when(registry._is("name", name), F.contains(F.lower("text"), F.lit(text))).otherwise(usual)
    return _software(registry._is("key", registry.WINLOGON) & usual.isNotNull(), F.col("name"), ort=F.lit("Winlogon"), auffaellig=F.when(~usual, "ja").otherwise("nein"))


def _libraries() -> Column:
    return _software(registry._is("key", registry.WINDOWS) & registry._is("name", "AppInit_DLLs") & (F.trim("text") != ""), F.lit("AppInit_DLLs"), ort=F.lit("AppInit_DLLs"), auffaellig=F.lit("ja"))


def _debuggers() -> Column:
    program = registry._below(registry.IMAGE_OPTIONS)
    return _software(program.isNotNull() & registry._is("name", "Debugger") & (F.trim("text") != ""), program, ort=F.lit("IFEO-Debugger"), auffaellig=F.lit("ja"))


def _last_executions() -> Column:
    control = F.concat(F.lower(F.coalesce("context.control_set", F.lit("ControlSet001"))), F.lit("\\"))
    path = F.when(_of("SYSTEM") & F.startswith(F.lower("key"), control), F.substr("key", F.length(control) + 1))
    at = r"(?i)^Services\\(bam|dam)\\(?:State\\)?UserSettings\\([^\\]+)$"
    here = path.rlike(at) & (F.startswith("name", F.lit("\\Device\\")) | F.contains("name", F.lit(":\\"))) & (F.octet_length("data") >= 8)
    ticks = F.when(here, bytesfn.unsigned(F.col("data"), 0, 8))
    seconds = timefn.filetime_seconds(ticks)
    shown = F.date_format(local_time(F.timestamp_seconds(seconds)), "yyyy-MM-dd'T'HH:mm:ss")
    return only(here, finding(F.col("name"), F.concat(F.lit("SYSTEM\\"), "key"), F.col("key_offset"), art=F.lower(F.regexp_extract(path, at, 1)), sid=F.regexp_extract(path, at, 2), hive_offset=F.col("hive_offset"), letzte_ausfuehrung_unix=seconds, letzte_ausfuehrung_ortszeit=shown, rechner=F.col("context.host")))


def _cut_execution() -> Column:
    return F.when(_of("SYSTEM") & F.col("key").rlike(r"(?i)\\Services\\(?:bam|dam)\\(?:State\\)?UserSettings\\[^\\]+$") & F.contains("name", F.lit("\\")) & (F.octet_length("data") < 8), F.concat(F.col("key"), F.lit(": Wert zu kurz")))


def _mount_points() -> Column:
    point = registry._below(registry.EXPLORER + r"\MountPoints2")
    return only(_of("NTUSER") & (F.upper(point) != "CPC"), finding(point, F.concat(F.lit("HKCU "), "user", F.lit("\\MountPoints2")), F.col("key_offset"), art=F.lit("mount_point"), benutzer=F.col("user"), letzter_zugriff_unix=timefn.filetime_seconds(F.col("key_filetime"))))


def _startup() -> Column:
    at = F.instr(F.lower("path"), F.lit(artifacts.STARTUP))
    rest = F.when(at > 0, F.substr("path", at + len(artifacts.STARTUP)))
    return only((rest != "") & ~F.contains(rest, F.lit("\\")) & (F.lower(rest) != "desktop.ini"), finding(rest, F.col("path"), F.col("file_offset"), ort=F.lit("Autostart-Ordner")))


def _prefetch() -> Column:
    file = artifacts.file_name("path")
    form = r"(?i)^(.+)-([0-9A-F]{8})\.pf$"
    return only(F.contains(F.lower("path"), F.lit("\\prefetch\\")) & file.rlike(form), finding(F.regexp_extract(file, form, 1), F.col("path"), F.col("file_offset"), quelle=F.lit("prefetch"), pfad_hash=F.upper(F.regexp_extract(file, form, 2))))


def _onion_service() -> Column:
    return F.transform(artifacts.onion_traces(F.col("path"), F.col("text")), lambda t: finding(t["name"], F.col("path"), F.col("file_offset"), art=t["kind"]))


ANALYZERS = (
    Analyzer("run_keys", "persistence", _run_keys), Analyzer("winlogon", "persistence", _winlogon), Analyzer("appinit", "persistence", _libraries), Analyzer("ifeo", "persistence", _debuggers),
    Analyzer("last_executions", "programmausfuehrung", _last_executions, warning=_cut_execution), Analyzer("mount_points", "usb", _mount_points),
    Analyzer("startup_folders", "persistence", _startup, file_based=True), Analyzer("prefetch_names", "programmausfuehrung", _prefetch, file_based=True), Analyzer("onion_services", "tor", _onion_service, file_based=True),
)
