"""From raw findings to the model: events, participants, entities and relationships with deterministic ids.

A mapper is an expression set for one domain: which event a finding tells of (kind, key, time, derivation),
and a list of participants (role, entity kind, canonical key, name). All mappers run in one pass over the
findings; an event seen twice is one event, and its later findings only support it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import ids, textfn, timefn
from tracelake.operators import model

# Event numbers by meaning. Kinds in the second list are custom names.
LOGON_KINDS = ((("4624", "21"), "user_logon"), (("4625", "4648", "1149"), "authentication_attempt"), (("4634", "4647"), "user_logoff"), (("4688",), "process_start"), (("4697", "7045"), "service_installed"), (("6005",), "system_boot"), (("6006",), "system_shutdown"))
CUSTOM_KINDS = (
    (("4672",), "special_privileges_assigned"), (("4720",), "account_created"), (("4722",), "account_enabled"), (("4725",), "account_disabled"), (("4726",), "account_deleted"),
    (("4728", "4732", "4756"), "group_member_added"), (("1102", "104"), "log_cleared"), (("25",), "rdp_session_reconnected"),
)
DERIVED_NUMBERS = ("6005", "6006")
# Which provider's event numbers are looked at.
SECURITY = "Microsoft-Windows-Security-Auditing"
EVENTS_OF_INTEREST = tuple((SECURITY, n) for n in (4624, 4625, 4634, 4647, 4648, 4672, 4688, 4697, 4720, 4722, 4725, 4726, 4728, 4732, 4756)) + (
    ("Microsoft-Windows-Eventlog", 1102), ("Microsoft-Windows-Eventlog", 104), ("Service Control Manager", 7045), ("EventLog", 6005), ("EventLog", 6006),
    ("Microsoft-Windows-TerminalServices-RemoteConnectionManager", 1149), ("Microsoft-Windows-TerminalServices-LocalSessionManager", 21), ("Microsoft-Windows-TerminalServices-LocalSessionManager", 25),
)
#: fixed values: attributes that say where a finding lies, not what it says
LOCATOR_KEYS = ("volume_offset", "mft_record", "datei_offset", "datei_laenge", "image_offset", "hive_offset", "herkunft")


def select_events(records: DataFrame, provider: str = "provider", number: str = "event_id") -> DataFrame:
    """Records of the (provider, number) pairs of interest; a provider's letter case does not count. The pairs are a constant of 23 rows."""
    pairs = records.sparkSession.createDataFrame([(p.lower(), n) for p, n in EVENTS_OF_INTEREST], "_p string, _n bigint")
    return records.join(F.broadcast(pairs), (F.lower(provider) == F.col("_p")) & (F.col(number) == F.col("_n")), "left_semi")


def usable_records(records: DataFrame, record_id: str, log: str) -> DataFrame:
    """Record ids that a log holds once; a repeated id points nowhere."""
    once = records.groupBy(log, record_id).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return records.join(once, [log, record_id], "left_semi")


def attribute(name: str) -> Column:
    """A finding's attribute, or null if it says nothing."""
    return textfn.present(F.try_element_at("attributes", F.lit(name)))


def number(name: str) -> Column:
    return attribute(name).try_cast("bigint")


def observation_fields() -> Column:
    return F.map_filter("attributes", lambda k, v: ~k.isin(*LOCATOR_KEYS))


def _origin() -> Column:
    """``:VSS#n`` for findings from a snapshot."""
    return F.coalesce(F.concat(F.lit(":"), F.when(attribute("herkunft") != "live", attribute("herkunft"))), F.lit(""))


def _by_number(table: tuple, column: Column) -> Column:
    out = F.lit(None).cast("string")
    for numbers, kind in table:
        out = F.when(column.isin(*numbers), kind).otherwise(out)
    return out


def _person(role: str | Column, name: str, sid: str, domain: str) -> Column:
    key = textfn.user_canonical(attribute(sid), attribute(domain), attribute(name))
    return _participant(role, "windows_user", key, F.coalesce(attribute(name), attribute(sid)))


def _participant(role: str | Column, kind: str | Column, key: Column, name: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(key.isNotNull(), F.struct(lit(role).alias("role"), lit(kind).alias("entity_kind"), key.alias("canonical_key"), F.coalesce(name, key).alias("name")))


def file_key(path: Column) -> Column:
    """``pfad:`` with volume and rest for an absolute path, else ``dateiname:`` with the name alone."""
    volume, rest = textfn.path_parts(path)
    return F.when(path.isNotNull(), F.coalesce(F.concat(F.lit("pfad:"), volume, rest), F.concat(F.lit("dateiname:"), F.lower(F.element_at(F.split(path, r"[\\/]"), -1)))))


def _mappers() -> dict[str, Callable[[], dict[str, Column]]]:
    """Domain -> what makes its mapper; a mapper is made when it is needed, as its expressions take their time."""
    from tracelake.operators import mappers  # which builds on this module

    n = attribute("event_id")
    host = _participant("host", "host", F.concat(F.lit("host:"), F.lower("host")), F.col("host"))
    place = F.concat(F.coalesce(attribute("volume_offset"), F.lit("?")), F.lit(":"), F.coalesce(attribute("mft_record"), F.lit("?")))
    ip = attribute("quell_ip")
    source = attribute("quelle")
    registry = F.concat(F.lit("registry:"), F.col("source"))
    program = F.coalesce(attribute("interner_name"), F.col("name"))
    path = F.coalesce(attribute("pfad"), F.col("name"))
    is_bam = attribute("art").isin("bam", "dam")
    url = F.coalesce(attribute("url"), F.col("name"))
    serial = F.coalesce(attribute("seriennummer"), F.col("name"))
    return {
        "eventlog": lambda: {
            "kind": F.coalesce(_by_number(LOGON_KINDS, n), _by_number(CUSTOM_KINDS, n), F.lit("unbekannt")),
            "key": F.concat(F.lit("evtx:"), place, F.lit(":"), F.coalesce(attribute("event_record_id"), F.lit("0")), _origin()),
            "ticks": number("filetime"),
            "derivation": F.when(n.isin(*DERIVED_NUMBERS), "derived").otherwise("parsed"),
            "located": attribute("mft_record").isNotNull() & number("datei_offset").isNotNull(),
            "participants": F.array(host, _person(F.when(F.coalesce(attribute("gruppe_sid"), attribute("gruppe")).isNotNull(), "subject").otherwise("user"), "benutzer", "benutzer_sid", "benutzer_domaene"), _person("actor", "ausfuehrender", "ausfuehrender_sid", "ausfuehrender_domaene"), _participant("object", "user_group", textfn.user_canonical(attribute("gruppe_sid"), F.lit(None).cast("string"), F.coalesce(attribute("gruppe"), attribute("gruppe_sid"))), F.coalesce(attribute("gruppe"), attribute("gruppe_sid"))), _participant("source", "ip_address", F.when(textfn.is_ipv4(ip), F.concat(F.lit("ip:"), ip)), ip)),
        },
        "prefetch": lambda: {
            "kind": F.lit("process_start"),
            "key": F.concat(F.lit("prefetch:"), F.coalesce(attribute("volume_offset"), F.lit("?")), F.lit(":"), F.coalesce(attribute("mft_record"), F.lower(F.coalesce(attribute("prefetch_datei"), F.col("source")))), _origin()),
            "ticks": timefn.preferred_ticks(F.col("attributes"), "letzte_ausfuehrung"),
            "derivation": F.lit("parsed"),
            "located": attribute("mft_record").isNotNull(),
            "participants": F.array(_participant("executable", "application", F.concat(F.lit("programm:"), F.lower(program)), program), host),
        },
        "programmausfuehrung": lambda: {
            "kind": F.when(source == "amcache", "amcache_recorded").when(source == "shimcache", "file_modified").when(is_bam, "process_start"),
            "key": F.when(source == "amcache", F.concat(registry, _origin())).when(source == "shimcache", F.concat(registry, F.lit(":"), F.coalesce(attribute("eintrag"), F.lit("?")), _origin())).otherwise(F.concat(registry, F.lit(":"), F.col("name"), _origin())),
            "ticks": F.when(source == "amcache", timefn.preferred_ticks(F.col("attributes"), "registriert")).when(source == "shimcache", timefn.preferred_ticks(F.col("attributes"), "letzte_aenderung")).otherwise(timefn.preferred_ticks(F.col("attributes"), "letzte_ausfuehrung")),
            "derivation": F.when(source == "shimcache", "derived").otherwise("parsed"),
            "located": number("hive_offset").isNotNull(),
            "participants": F.array(_participant(F.when(is_bam, "executable").otherwise("file"), "file", file_key(path), path), F.when(is_bam, _person("user", "benutzer", "sid", "benutzer_domaene")), host),
        },
        "browser": lambda: {
            "kind": F.lit("web_visit"),
            "key": F.concat(F.lit("verlauf:"), F.col("source"), F.lit(":"), F.coalesce(attribute("eintrag_id"), url), _origin()),
            "ticks": timefn.preferred_ticks(F.col("attributes"), "besucht"),
            "derivation": F.lit("parsed"),
            "located": attribute("mft_record").isNotNull(),
            "participants": F.array(_participant("target", "url", textfn.url_canonical(url), url), _participant("user", "windows_user", textfn.user_canonical(F.lit(None).cast("string"), F.lit(None).cast("string"), textfn.user_from_path(F.col("source"))), textfn.user_from_path(F.col("source"))), host),
        },
        "usb": lambda: {
            "kind": F.lit("device_connected"),
            "key": F.concat(registry, _origin()),
            "ticks": timefn.preferred_ticks(F.col("attributes"), "letzte_verbindung"),
            "derivation": F.lit("parsed"),
            "located": number("hive_offset").isNotNull(),
            "participants": F.array(_participant("device", "usb_device", F.concat(F.lit("usb:"), serial), F.col("name")), host),
        },
        "srum": lambda: {
            "kind": F.lit("application_usage"),
            "key": F.concat(F.lit("srum:"), F.col("source"), F.lit(":"), F.coalesce(attribute("eintrag_id"), F.lit("?")), _origin()),
            "ticks": timefn.preferred_ticks(F.col("attributes"), "zeit"),
            "derivation": F.lit("parsed"),
            "located": attribute("mft_record").isNotNull(),
            "participants": F.array(_participant("executable", "application", F.concat(F.lit("programm:"), F.lower(F.col("name"))), F.col("name")), _person("user", "benutzer", "sid", "benutzer_domaene"), host),
        },
        "useraktivitaet": lambda: mappers.activity(host),
        "persistence": lambda: mappers.persistence(host),
        "lsa": lambda: mappers.credentials(host),
        "dpapi": lambda: mappers.credentials(host),
    }


def present_domains(findings: DataFrame) -> list[str]:
    """The domains with a mapper that findings have: a scan of one column, and no more names than there are mappers."""
    return sorted(r.domain for r in findings.where(F.col("domain").isin(*_mappers())).select("domain").distinct().collect())


def map_findings(findings: DataFrame, case_hex: str, domains: Sequence[str] | None = None) -> DataFrame:
    """Findings (ordinal, domain, name, source, attributes, host) with kind, key, time, derivation, participants and event id; ``mapped`` tells whether its domain has a mapper, ``kind`` is null without an event, and ``told`` whether there is one with a time (a short test, which filters can push down).

    Each domain is a filter and a projection of its own, so that no generated code holds all mappers. With ``domains`` (``present_domains``) the others' findings are taken as if they had no mapper, which spares their part of the plan.
    """
    mappers = {d: m() for d, m in _mappers().items() if domains is None or d in domains}
    fields = {"kind": "string", "key": "string", "ticks": "bigint", "derivation": "string", "located": "boolean"}
    people = "array<struct<role:string,entity_kind:string,canonical_key:string,name:string>>"

    def branch(rows: DataFrame, mapper: dict[str, Column] | None) -> DataFrame:
        of = lambda name: mapper[name] if mapper else F.lit(None)
        who = F.array_compact(mapper["participants"]).cast(people) if mapper else F.lit(None).cast(people)
        return rows.select(*findings.columns, *(of(name).cast(t).alias(f"m_{name}") for name, t in fields.items()), who.alias("m_participants"), F.lit(mapper is not None).alias("mapped"))

    out = branch(findings.where(~F.coalesce(F.col("domain").isin(*mappers), F.lit(False))) if mappers else findings, None)
    for domain, mapper in mappers.items():
        out = out.unionByName(branch(findings.where(F.col("domain") == domain), mapper))
    # a generator keeps the conversions in one place, behind the union
    out = out.withColumn("told", F.col("m_kind").isNotNull() & F.coalesce(F.col("m_ticks") != 0, F.lit(False)))
    case = F.unhex(F.lit(case_hex))
    event = ids.derived_uuid("event", case, ids.text_part(F.col("m_kind")), ids.text_part(F.col("m_key")))
    made = F.struct(timefn.filetime_iso(F.col("m_ticks")).alias("time"), F.when(F.col("told"), event).alias("event_id"))
    out = out.select(*findings.columns, "m_kind", "m_key", "m_derivation", "m_located", "m_participants", "mapped", "told", F.inline(F.array(made)))
    return out.withColumnsRenamed({"m_kind": "kind", "m_key": "key", "m_derivation": "derivation", "m_located": "located", "m_participants": "participants"})


def entity_id(case_hex: str, kind: Column, key: Column) -> Column:
    return ids.derived_uuid("entity", F.unhex(F.lit(case_hex)), ids.text_part(kind), ids.text_part(key))


def events(mapped: DataFrame) -> DataFrame:
    """Each event once, as its first finding tells it."""
    known = mapped.where("told").select("event_id", "kind", "time", "derivation", "ordinal")
    return known.groupBy("event_id").agg(*(F.min_by(c, "ordinal").alias(c) for c in ("kind", "time", "derivation")))


def participants(mapped: DataFrame, case_hex: str) -> DataFrame:
    """Distinct (event_id, entity_id, role)."""
    rows = mapped.where("told").select("event_id", F.explode("participants").alias("p"))
    return rows.select("event_id", entity_id(case_hex, F.col("p.entity_kind"), F.col("p.canonical_key")).alias("entity_id"), F.col("p.role").alias("role")).distinct()


def entities(mapped: DataFrame, case_hex: str) -> DataFrame:
    """Entities by kind and key, with the best name and the times they were seen; findings without a time name entities too."""
    rows = mapped.select("ordinal", "time", F.explode("participants").alias("p")).select("ordinal", "time", "p.*")
    bare = F.startswith("name", F.lit("S-1-"))
    merged = rows.groupBy("entity_kind", "canonical_key").agg(F.coalesce(F.min_by(F.when(~bare, F.col("name")), F.when(~bare, F.col("ordinal"))), F.min_by("name", "ordinal")).alias("display_name"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    return merged.withColumn("entity_id", entity_id(case_hex, F.col("entity_kind"), F.col("canonical_key")))


def provenance(mapped: DataFrame) -> DataFrame:
    """The source of every event: its first finding is primary, later ones support it."""
    return model.provenance_roles(mapped.where("told"), ["event_id"], ["ordinal"]).select("event_id", "ordinal", "role")


def stated_edges() -> Column:
    """The relationships that a finding of any domain states: an array of kind and both ends (kind and key)."""
    from tracelake.operators import mappers

    found = F.lit(None)
    for domains, edges in mappers.stated_edges().items():
        found = F.when(F.col("domain").isin(*domains), edges).otherwise(found)
    return F.array_compact(F.coalesce(found, F.array()))


def relationships(mapped: DataFrame, case_hex: str, domains: Sequence[str] | None = None) -> DataFrame:
    """Edges that findings state: a user's account on a host, membership in a group, a program's file hash, and those of ``mappers.stated_edges``, of ``domains`` if given."""
    p = lambda role: F.try_element_at(F.filter("participants", lambda x: x["role"] == role), F.lit(1))
    # a generator of one row: the participants' expressions are evaluated once, and not once for each use of an end
    ends = mapped.select("ordinal", F.inline(F.array(F.struct(*(p(r).alias(r) for r in ("user", "host", "subject", "object", "file")), textfn.hash_canonical(F.lit("sha1"), attribute("sha1")).alias("sha1")))))
    eid = lambda role: F.when(F.col(role).isNotNull(), entity_id(case_hex, F.col(f"{role}.entity_kind"), F.col(f"{role}.canonical_key")))
    edges = [
        ends.select("ordinal", F.lit("ACCOUNT_ON").alias("kind"), eid("user").alias("source"), eid("host").alias("target")),
        ends.select("ordinal", F.lit("MEMBER_OF"), eid("subject"), eid("object")),
        ends.select("ordinal", F.lit("HAS_HASH"), eid("file"), F.when(F.col("sha1").isNotNull(), entity_id(case_hex, F.lit("hash"), F.col("sha1")))),
    ]
    from tracelake.operators import mappers

    for of, found in (mappers.stated_edges() if domains is None or set(domains) & set(mappers.STATING) else {}).items():
        if own := [d for d in of if domains is None or d in domains]:
            stated = mapped.where(F.col("domain").isin(*own)).select("ordinal", F.inline(F.array_compact(found)))
            edges.append(stated.select("ordinal", "kind", entity_id(case_hex, F.col("source_kind"), F.col("source_key")), entity_id(case_hex, F.col("target_kind"), F.col("target_key"))))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out.where("source IS NOT NULL AND target IS NOT NULL").groupBy("kind", "source", "target").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n_sources"))


def write_model(findings: DataFrame, case_hex: str, folder: str) -> None:
    """Findings mapped and written as ``mapped``, and the model's tables made of it, one Parquet table each: event, participant, entity, relationship, provenance. Those of an earlier run are replaced."""
    spark = findings.sparkSession
    domains = present_domains(findings)
    where = lambda name: os.path.join(folder, name)
    map_findings(findings, case_hex, domains).write.mode("overwrite").parquet(where("mapped"))
    mapped = spark.read.parquet(where("mapped"))
    tables = {"event": events(mapped), "participant": participants(mapped, case_hex), "entity": entities(mapped, case_hex), "relationship": relationships(mapped, case_hex, domains), "provenance": provenance(mapped)}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(where(name))


def statistics(mapped: DataFrame) -> DataFrame:
    """Findings by domain: mapped, without a mapper, and with an incomplete locator."""
    known = F.col("mapped")
    return mapped.groupBy("domain").agg(F.count_if(known).alias("mapped"), F.count_if(~known).alias("no_mapper"), F.count_if(known & ~F.coalesce("located", F.lit(False))).alias("incomplete_locator"))
