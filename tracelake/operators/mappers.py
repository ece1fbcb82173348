"""Mappers of user activity, persistence and credentials, and the relationships that findings state.

Each mapper is a set of expressions over a finding (domain, name, source, attributes, host), as those in
``normalize``; sub-kinds are told by the attribute ``art`` or ``ort``. A finding without an event still names
entities, and states relationships: a user uses what a list holds, a task executes a program and belongs to
the account it runs as, a service is installed on its host, a secret belongs to its service or host.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import textfn, timefn
from tracelake.operators.normalize import _origin, _participant, attribute, file_key, number

# The lists of recent things, the event that each tells of, what its entries are, and their role.
LISTS = (
    ("typed_url", "url_typed", "url", "object", "USES"), ("typed_path", "path_typed", "directory", "object", "USES"), ("recent_doc", "file_accessed", "file", "file", "USES_FILE"),
    ("dialog_datei", "file_accessed", "file", "file", "USES_FILE"), ("dialog_programm", "file_dialog_used", "application", "executable", "USES"), ("run_mru", "command_entered", None, None, None), ("explorer_suche", "explorer_search", None, None, None),
)


def _null() -> Column:
    return F.lit(None).cast("string")


def _choose(art: Column, table: list[tuple[str, Column]]) -> Column:
    out = _null()
    for name, value in table:
        out = F.when(art == name, value).otherwise(out)
    return out


def account_key(text: Column) -> Column:
    """The key of an account named as SID, ``domain\\name`` or name."""
    domain, name = F.regexp_extract(text, r"(?s)^([^\\]*)\\", 1), F.regexp_replace(text, r"^[^\\]*\\", "")
    sid = F.startswith(text, F.lit("S-1-"))
    return textfn.user_canonical(F.when(sid, text), F.when(~sid & F.contains(text, F.lit("\\")), domain), F.when(~sid, name))


def _host_part() -> Column:
    return F.lower(F.coalesce("host", F.lit("?")))


def _owner() -> Column:
    return textfn.user_canonical(_null(), _null(), attribute("benutzer"))


def _activity_target() -> tuple[Column, Column]:
    """Kind and key of what an activity was about."""
    art, name = attribute("art"), F.col("name")
    path = F.coalesce(attribute("pfad_aufgeloest"), F.when(F.contains(name, F.lit(":\\")), name))
    by_list = [(a, kind) for a, _, kind, _, _ in LISTS if kind]
    kind = F.when(art == "userassist", F.when(F.startswith(name, F.lit("UEME_CTL")), _null()).otherwise(F.when(path.isNotNull(), "file").otherwise("application"))).otherwise(_choose(art, [(a, F.lit(k)) for a, k in by_list]))
    named = F.concat(F.lit("dateiname:"), F.lower(name))
    program = F.concat(F.lit("programm:"), F.lower(name))
    key = F.when(art == "userassist", F.coalesce(file_key(path), program)).otherwise(_choose(art, [("typed_url", textfn.url_canonical(F.trim(name))), ("typed_path", file_key(name)), ("recent_doc", named), ("dialog_datei", named), ("dialog_programm", program)]))
    return kind, F.when(kind.isNotNull(), key)


def activity(host: Column) -> dict[str, Column]:
    """UserAssist and the lists of recent things; a list's own time counts, else its key's for the entry at position 0."""
    art, name = attribute("art"), F.col("name")
    attributes = F.col("attributes")
    value = F.coalesce(attribute("wertname_roh"), attribute("wert"), name)
    registry = F.concat(F.lit("registry:"), F.col("source"), F.lit(":"), value, _origin())
    typed = timefn.preferred_ticks(attributes, "eingegeben")
    first = F.when(attribute("mru_position") == "0", timefn.preferred_ticks(attributes, "key_letzte_aenderung"))
    listed = art.isin(*(a for a, *_ in LISTS))
    ticks = F.when(art == "userassist", timefn.preferred_ticks(attributes, "letzte_ausfuehrung")).when(listed, F.coalesce(typed, first))
    kind, key = _activity_target()
    user = _owner()
    nanos = (ticks - timefn.EPOCH_TICKS) * 100
    # two lists that hold the same thing tell of one event
    event_key = F.when(listed & key.isNotNull(), F.concat_ws(":", key, F.coalesce(user, F.lit("")), nanos.cast("string"))).otherwise(registry)
    role = F.when(art == "userassist", "executable").otherwise(_choose(art, [(a, F.lit(r)) for a, _, _, r, _ in LISTS if r]))
    return {
        "kind": F.when((art == "userassist") & kind.isNotNull(), "process_start").otherwise(_choose(art, [(a, F.lit(k)) for a, k, *_ in LISTS])),
        "key": event_key,
        "ticks": ticks,
        "derivation": F.when(listed & typed.isNull(), "derived").otherwise("parsed"),
        "located": number("hive_offset").isNotNull() & (listed | (art == "userassist")),
        "participants": F.array(_participant(role, kind, key, name), _participant("user", "windows_user", user, attribute("benutzer")), host),
    }


def _persistent_thing() -> tuple[Column, Column, Column]:
    """Kind, key and name of a service, task, registry value or startup file."""
    place, name = attribute("ort"), F.col("name")
    user = F.regexp_extract("source", r"^HKCU ([^\\]+)\\", 1)
    rest = F.regexp_replace("source", r"^(?:HKLM SOFTWARE|SYSTEM|HKCU [^\\]+)\\", "")
    hive = F.when(F.startswith("source", F.lit("HKLM SOFTWARE\\")), "software").when(F.startswith("source", F.lit("SYSTEM\\")), "system").when(user != "", F.concat(F.lit("ntuser.dat "), F.lower(user))).otherwise("?")
    value = F.coalesce(attribute("wert"), name)
    kind = F.when(place == "Dienst", "service").when(place == "Aufgabe", "scheduled_task").when(place == "Autostart-Ordner", "file").when(place.isNotNull(), "registry_value")
    registry = F.concat(F.lit("registry:"), _host_part(), F.lit(":"), hive, F.lit(":"), F.lower(F.concat(rest, F.lit("\\"), value)))
    key = F.when(place == "Dienst", F.concat(F.lit("dienst:"), _host_part(), F.lit(":"), F.lower(name))).when(place == "Aufgabe", F.concat(F.lit("aufgabe:"), _host_part(), F.lit(":"), F.lower(name))).when(place == "Autostart-Ordner", file_key(F.col("source"))).when(place.isNotNull(), registry)
    shown = F.when(kind == "registry_value", F.concat(rest, F.lit("\\"), value)).when(kind == "file", F.col("source")).otherwise(name)
    return kind, key, shown


def persistence(host: Column) -> dict[str, Column]:
    """Services, tasks, registry autostarts and startup folders; only a task file's creation is an event."""
    place = attribute("ort")
    kind, key, shown = _persistent_thing()
    file_place = F.concat(F.coalesce(attribute("volume_offset"), F.lit("?")), F.lit(":"), F.coalesce(attribute("mft_record"), F.lower("source")))
    in_hive = number("hive_offset").isNotNull()
    located = F.when(place == "Aufgabe", attribute("mft_record").isNotNull() & number("mft_record_offset").isNotNull()).when(place == "Autostart-Ordner", attribute("mft_record").isNotNull()).when(place.isNotNull(), in_hive)
    return {
        "kind": F.when(place == "Aufgabe", "scheduled_task_created"),
        "key": F.concat(F.lit("aufgabe:"), file_place, _origin()),
        "ticks": F.when(place == "Aufgabe", timefn.preferred_ticks(F.col("attributes"), "datei_erstellt")),
        "derivation": F.lit("derived"),
        "located": F.coalesce(located, F.lit(False)),
        "participants": F.array(_participant("object", kind, key, shown), host),
    }


def _credential() -> tuple[Column, Column]:
    """Key and name of a secret's record; the secret itself is in neither."""
    name, art = F.col("name"), attribute("art")
    guid = F.coalesce(attribute("guid"), name)
    part = lambda kind, text: F.concat(F.lit("credential:"), _host_part(), F.lit(f":{kind}:"), F.lower(text))
    lsa = F.when(art == "dcc2", part("dcc2", name)).otherwise(part("lsa", name))
    key = F.when(F.col("domain") == "dpapi", F.concat(F.lit("credential:dpapi_masterkey:"), F.lower(guid))).otherwise(lsa)
    shown = F.when(F.col("domain") == "dpapi", F.concat(F.lit("DPAPI-Masterkey "), guid)).when(art == "dcc2", F.concat(F.lit("Gecachte Anmeldung "), name)).otherwise(F.concat(F.lit("LSA-Secret "), name))
    return key, shown


def credentials(host: Column) -> dict[str, Column]:
    """LSA secrets, cached logons and master keys as sensitive entities without events."""
    key, shown = _credential()
    return {"kind": _null(), "key": key, "ticks": F.lit(None).cast("bigint"), "derivation": F.lit("parsed"), "located": number("hive_offset").isNotNull() | attribute("mft_record").isNotNull(), "participants": F.array(_participant("object", "credential", key, shown), host)}


def _edge(kind: str | Column, source_kind: Column | str, source_key: Column, target_kind: Column | str, target_key: Column, test: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    known = source_key.isNotNull() & target_key.isNotNull() & (test if test is not None else F.lit(True))
    return F.when(known, F.struct(lit(kind).alias("kind"), lit(source_kind).alias("source_kind"), source_key.alias("source_key"), lit(target_kind).alias("target_kind"), target_key.alias("target_key")))


#: domains whose findings state relationships
STATING = ("useraktivitaet", "persistence", "lsa", "dpapi", "usb", "browser")


def stated_edges() -> dict[tuple[str, ...], Column]:
    """The relationships that a finding states, by domains: an array of kind and both ends (kind and key), or nulls."""
    domain, art, place, name = F.col("domain"), attribute("art"), attribute("ort"), F.col("name")
    host = F.when(F.coalesce("host", F.lit("")) != "", F.concat(F.lit("host:"), F.lower("host")))
    user = _owner()
    target_kind, target = _activity_target()
    use = F.when(art == "userassist", "USES").otherwise(_choose(art, [(a, F.lit(r)) for a, *_, r in LISTS if r]))
    active = F.array(_edge(use, "windows_user", user, target_kind, target))
    kind, key, _ = _persistent_thing()
    program = file_key(textfn.program_path(attribute("befehl")))
    account = account_key(attribute("benutzer"))
    of_user = F.when(place == "Aufgabe", account).when(kind == "registry_value", user)
    on_host = (kind != "registry_value") | user.isNull()
    persists = F.array(_edge("EXECUTES", kind, key, "file", program, kind != "file"), _edge("INSTALLED_ON", kind, key, "host", host, on_host), _edge("BELONGS_TO", kind, key, "windows_user", of_user))
    secret, _ = _credential()
    service = F.when(F.startswith(name, F.lit("_SC_")), F.concat(F.lit("dienst:"), _host_part(), F.lit(":"), F.lower(F.substr(name, F.lit(5)))))
    sid = F.regexp_extract("source", r"(?:^|\\)(S-1-[^\\]+)", 1)
    owner_kind = F.when(domain == "dpapi", "windows_user").when(art == "dcc2", "windows_user").when(service.isNotNull(), "service").otherwise("host")
    owner = F.when(domain == "dpapi", textfn.user_canonical(F.when(sid != "", sid), _null(), _null())).when(art == "dcc2", account_key(name)).otherwise(F.coalesce(service, host))
    belongs = F.array(_edge("BELONGS_TO", "credential", secret, owner_kind, owner))
    device = F.concat(F.lit("usb:"), F.coalesce(attribute("seriennummer"), name))
    usb = F.array(_edge("USES", "windows_user", user, "usb_device", device), _edge("LOCATED_ON", "usb_device", device, "host", host))
    url = F.coalesce(attribute("url"), name)
    visitor = textfn.user_canonical(_null(), _null(), F.coalesce(attribute("benutzer"), textfn.user_from_path(F.col("source"))))
    opened = file_key(textfn.file_url_path(url))
    visits = F.array(_edge("USES", "windows_user", visitor, "url", textfn.url_canonical(url)), _edge("REFERENCES", "url", textfn.url_canonical(url), "file", opened))
    return {("useraktivitaet",): active, ("persistence",): persists, ("lsa", "dpapi"): belongs, ("usb",): usb, ("browser",): visits}
