"""Registry analyzers: findings from hive values that stand as rows.

A value row has ``image`` (the installation it comes from), ``hive`` (``SOFTWARE``, ``SYSTEM`` or ``NTUSER``),
``user`` (of an ``NTUSER`` hive), ``key``, ``name``, ``text`` (the value as text, if it is one), ``data`` (its bytes),
``hive_offset``, ``key_offset`` and ``key_filetime``. Every analyzer is a filter on key paths and a projection to
``domain``, ``name``, ``source`` and ``attributes``; values that belong together are joined by key. Rows keep the
columns asked for in ``keep``. Key and value names compare without letter case, as in the registry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import bytesfn, textfn, timefn

# Key paths, value names and what is usual there.
RUN_KEYS = (
    r"Microsoft\Windows\CurrentVersion\Run", r"Microsoft\Windows\CurrentVersion\RunOnce", r"Microsoft\Windows\CurrentVersion\RunServices",
    r"Microsoft\Windows\CurrentVersion\RunServicesOnce", r"Microsoft\Windows\CurrentVersion\Policies\Explorer\Run",
)
WINLOGON, WINDOWS = r"Microsoft\Windows NT\CurrentVersion\Winlogon", r"Microsoft\Windows NT\CurrentVersion\Windows"
IMAGE_OPTIONS = r"Microsoft\Windows NT\CurrentVersion\Image File Execution Options"
WINLOGON_USUAL = (("Shell", "explorer.exe"), ("Userinit", "userinit.exe"))
EXPLORER = r"Software\Microsoft\Windows\CurrentVersion\Explorer"
TYPED_URLS = r"Software\Microsoft\Internet Explorer\TypedURLs"
USERASSIST_BYTES, USERASSIST_VERSION = 72, 5
#: most recently used lists: key below Explorer, kind, and whether a list value orders them
MRU_KINDS = ((r"\RunMRU", "run_mru", True), (r"\TypedPaths", "typed_path", False), (r"\WordWheelQuery", "explorer_suche", True), (r"\RecentDocs", "recent_doc", True))


def _is(column: str, *texts: str) -> Column:
    return F.lower(column).isin(*(t.lower() for t in texts))


def _below(path: str) -> Column:
    """The one key name behind a path; null for other keys."""
    rest = F.substr("key", F.lit(len(path) + 2))
    return F.when(F.startswith(F.lower("key"), F.lit(path.lower() + "\\")) & (rest != "") & ~F.contains(rest, F.lit("\\")), rest)


def attributes(**values: Column) -> Column:
    """A map of the attributes that have a value, as text."""
    names, texts = list(values), [F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values.values()]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*texts)), lambda k, v: v.isNotNull())


def _where() -> dict[str, Column]:
    """What every finding says of the value it rests on."""
    written = F.col("key_filetime")
    return {"wert": F.col("name"), "hive_offset": F.col("hive_offset"), "key_hive_offset": F.col("key_offset"), "key_letzte_aenderung_filetime": F.when(written != 0, written)}


def _yes(flag: Column) -> Column:
    return F.when(flag, "ja").otherwise("nein")


def _finding(rows: DataFrame, keep: Sequence[str], domain: str, name: Column, source: Column, values: Column) -> DataFrame:
    return rows.select(*keep, F.lit(domain).alias("domain"), name.alias("name"), source.alias("source"), values.alias("attributes"))


def control_sets(values: DataFrame) -> DataFrame:
    """``image`` and ``control_set``, the one in use: a row an installation."""
    number = F.lpad(F.regexp_extract("text", "^([0-9]{1,3})$", 1), 3, "0")
    return values.where((F.col("hive") == "SYSTEM") & _is("key", "Select") & _is("name", "Current")).groupBy("image").agg(F.concat(F.lit("ControlSet"), F.min(number)).alias("control_set"))


def current_system(values: DataFrame, path: str, rows: DataFrame | None = None) -> DataFrame:
    """``SYSTEM`` values below the control set in use (``ControlSet001`` where none is named) whose keys behind it match the pattern ``path``, with ``path`` the key behind it. ``rows``: the values with more columns.

    There is a set an installation, and there may be many installations, so sets are merged with the values that match.
    """
    own = system_values(values if rows is None else rows, path)
    joined = own.join(control_sets(values).hint("merge"), "image", "left").withColumn("control_set", F.coalesce("control_set", F.lit("ControlSet001")))
    inside = F.startswith(F.lower("key"), F.concat(F.lower("control_set"), F.lit("\\")))
    return joined.where(inside).withColumn("path", F.substr("key", F.length("control_set") + 2))


def system_values(values: DataFrame, path: str) -> DataFrame:
    """``SYSTEM`` values whose keys behind any control set match the pattern ``path``."""
    return values.where((F.col("hive") == "SYSTEM") & F.col("key").rlike(rf"(?i)^[^\\]+\\{path}$"))


def autostarts(values: DataFrame, keep: Sequence[str] = ("image",)) -> DataFrame:
    """Run keys of system and users, Winlogon, AppInit_DLLs and debuggers of programs."""
    place = F.when(F.col("hive") == "NTUSER", F.concat(F.lit("HKCU "), "user")).otherwise("HKLM SOFTWARE")
    run = values.where("name <> ''").where(((F.col("hive") == "SOFTWARE") & _is("key", *RUN_KEYS)) | ((F.col("hive") == "NTUSER") & _is("key", *(f"Software\\{k}" for k in RUN_KEYS))))
    found = _finding(run, keep, "persistence", F.col("name"), F.concat(place, F.lit("\\"), "key"), attributes(**_where(), befehl=F.coalesce("text", F.lit("")), ort=place, benutzer=F.when(F.col("hive") == "NTUSER", F.col("user"))))
    software = values.where("hive = 'SOFTWARE' AND text IS NOT NULL")
    usual = F.lit(None).cast("boolean")
    for name, text in WINLOGON_USUAL:
        usual = F.when(_is("name", name), F.contains(F.lower("text"), F.lit(text))).otherwise(usual)
    logon = software.where(_is("key", WINLOGON) & usual.isNotNull())
    source = F.concat(F.lit("HKLM SOFTWARE\\"), "key")
    found = found.union(_finding(logon, keep, "persistence", F.col("name"), source, attributes(**_where(), befehl=F.col("text"), ort=F.lit("Winlogon"), auffaellig=_yes(~usual))))
    filled = software.where(F.trim("text") != "")
    libraries = filled.where(_is("key", WINDOWS) & _is("name", "AppInit_DLLs"))
    found = found.union(_finding(libraries, keep, "persistence", F.lit("AppInit_DLLs"), source, attributes(**_where(), befehl=F.col("text"), ort=F.lit("AppInit_DLLs"), auffaellig=F.lit("ja"))))
    program = _below(IMAGE_OPTIONS)
    debuggers = filled.where(program.isNotNull() & _is("name", "Debugger"))
    return found.union(_finding(debuggers, keep, "persistence", program, source, attributes(**_where(), befehl=F.col("text"), ort=F.lit("IFEO-Debugger"), auffaellig=F.lit("ja"))))


def services(values: DataFrame, keep: Sequence[str] = ("image",)) -> DataFrame:
    """Services with an image path, its rating, and their start type, display name and account."""
    at = r"Services\\([^\\]+)"
    every = Window.partitionBy("image", "key")
    text = lambda name: F.max(F.when(_is("name", name) & (F.col("text") != ""), F.col("text"))).over(every)
    # a key's values lie in one control set, so they are brought together before it is known, and only image paths are joined with it
    named = system_values(values, at).where(_is("name", "ImagePath", "Start", "DisplayName", "ObjectName") & F.col("image").isNotNull())
    paths = named.withColumns({"start": text("Start"), "shown": text("DisplayName"), "account": text("ObjectName")}).where(_is("name", "ImagePath") & F.col("text").isNotNull())
    rated = textfn.rate_commands(current_system(values, at, paths).withColumn("service", F.regexp_extract("path", rf"(?i)^{at}$", 1)), "text")
    reasons = F.concat_ws(",", F.when(F.col("path_status") == "auffaellig", F.concat(F.lit("pfad:"), F.coalesce("reason", F.lit("")))), F.when(F.col("lolbin"), "systemwerkzeug"))
    values_ = attributes(**_where(), befehl=F.col("text"), ort=F.lit("Dienst"), auffaellig=_yes(reasons != ""), pfad_status=F.col("path_status"), auffaellig_grund=F.when(reasons != "", reasons), unquotierter_pfad=F.when(F.col("unquoted_space"), "ja"), start_typ=F.col("start"), anzeigename=F.col("shown"), konto=F.col("account"))
    return _finding(rated, keep, "persistence", F.col("service"), F.concat(F.lit("SYSTEM\\"), "key"), values_)


def usb_devices(values: DataFrame) -> DataFrame:
    """One finding for each device instance under USBSTOR: its friendly name, or else its key's."""
    at = r"Enum\\USBSTOR\\([^\\]+)\\([^\\]+)"
    part = lambda k: F.regexp_extract("path", rf"(?i)^{at}$", k)
    own = current_system(values, at).withColumns({"device": part(1), "serial": part(2)})
    one = own.groupBy("image", "key", "device", "serial").agg(F.max(F.when(_is("name", "FriendlyName"), F.col("text"))).alias("friendly"), F.min("key_offset").alias("offset"))
    return _finding(one, ["image"], "usb", F.coalesce("friendly", "device"), F.concat(F.lit("SYSTEM\\"), "key"), attributes(geraet=F.col("device"), seriennummer=F.col("serial"), hive_offset=F.col("offset")))


def mounts(values: DataFrame, keep: Sequence[str] = ("image",)) -> DataFrame:
    """Mounted devices that are USB ones, and every user's mount points."""
    device = F.regexp_replace(bytesfn.utf16_units(F.col("data")), r"^[\x00-\x1f\x7f-\x9f]+|[\x00-\x1f\x7f-\x9f]+$", "")
    mounted = values.where((F.col("hive") == "SYSTEM") & _is("key", "MountedDevices")).withColumn("device", device).where(F.upper("device").rlike("USBSTOR|USB#"))
    found = _finding(mounted, keep, "usb", F.col("name"), F.lit("SYSTEM\\MountedDevices"), attributes(art=F.lit("mounted_device"), hive_offset=F.col("hive_offset"), geraet=F.col("device")))
    point = _below(EXPLORER + r"\MountPoints2")
    points = values.where((F.col("hive") == "NTUSER") & point.isNotNull()).withColumn("point", point).where("upper(point) <> 'CPC'")
    points = points.dropDuplicates([*keep, "user", "point"])
    used = attributes(art=F.lit("mount_point"), benutzer=F.col("user"), hive_offset=F.col("key_offset"), letzter_zugriff_unix=timefn.filetime_seconds(F.col("key_filetime")))
    return found.union(_finding(points, keep, "usb", F.col("point"), F.concat(F.lit("HKCU "), "user", F.lit("\\MountPoints2")), used))


def last_executions(values: DataFrame, keep: Sequence[str] = ("image",)) -> DataFrame:
    """BAM and DAM: programs by SID with the FILETIME in a value's first eight bytes."""
    at = r"Services\\(bam|dam)\\(?:State\\)?UserSettings\\([^\\]+)"
    part = lambda k: F.regexp_extract("path", rf"(?i)^{at}$", k)
    own = current_system(values, at).withColumns({"service": F.lower(part(1)), "sid": part(2)})
    own = own.where((F.startswith("name", F.lit("\\Device\\")) | F.contains("name", F.lit(":\\"))) & (F.octet_length("data") >= 8)).withColumn("ticks", bytesfn.unsigned(F.col("data"), 0, 8))
    seconds = timefn.filetime_seconds(F.col("ticks"))
    values_ = attributes(art=F.col("service"), sid=F.col("sid"), hive_offset=F.col("hive_offset"), letzte_ausfuehrung_unix=seconds, letzte_ausfuehrung_filetime=F.when(seconds.isNotNull(), F.col("ticks")))
    return _finding(own, keep, "programmausfuehrung", F.col("name"), F.concat(F.lit("SYSTEM\\"), "key"), values_)


def _activity(rows: DataFrame, keep: Sequence[str], kind: str | Column, name: Column, **more: Column) -> DataFrame:
    changed = timefn.filetime_seconds(F.col("key_filetime"))
    own = {**_where(), "key_letzte_aenderung_filetime": F.when(changed.isNotNull(), F.col("key_filetime"))}
    values = attributes(art=kind if isinstance(kind, Column) else F.lit(kind), benutzer=F.col("user"), **own, key_letzte_aenderung_unix=changed, **more)
    return _finding(rows, keep, "useraktivitaet", name, F.concat(F.lit("HKCU "), "user", F.lit("\\"), "key"), values)


def typed_urls(values: DataFrame, keep: Sequence[str] = ("image",)) -> DataFrame:
    """Typed addresses with the time that the value of the same name under ``TypedURLsTime`` holds."""
    own = values.where("hive = 'NTUSER'")
    at = own.where(_is("key", TYPED_URLS + "Time") & (F.octet_length("data") >= 8))
    times = at.select("image", "user", F.lower("name").alias("low"), bytesfn.unsigned(F.col("data"), 0, 8).alias("ticks"), F.col("hive_offset").alias("time_offset"))
    urls = own.where(_is("key", TYPED_URLS) & (F.col("text") != "")).withColumn("low", F.lower("name")).join(times, ["image", "user", "low"], "left")
    seconds = timefn.filetime_seconds(F.col("ticks"))
    known = lambda c: F.when(seconds.isNotNull(), F.col(c))
    return _activity(urls, keep, "typed_url", F.col("text"), eingegeben_unix=seconds, eingegeben_filetime=known("ticks"), eingegeben_hive_offset=known("time_offset"))


def mru_positions(values: DataFrame) -> DataFrame:
    """``image``, ``user``, ``key``, ``low`` (value name) and ``position`` of the names that a key's list value orders."""
    lists = values.where((F.col("hive") == "NTUSER") & _is("name", "MRUListEx", "MRUList"))
    # MRUListEx wins where a key has both
    best = lists.groupBy("image", "user", "key").agg(F.max_by(F.struct("name", "data", "text"), F.length("name")).alias("l"))
    count = (F.octet_length("l.data") / 4).cast("int")
    numbers = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: bytesfn.unsigned(F.col("l.data"), i * 4, 4))
    end = F.array_position(numbers, F.lit(0xFFFFFFFF).cast("decimal(20,0)")).cast("int")
    numbers = F.when(count > 0, F.when(end > 0, F.slice(numbers, F.lit(1), end - 1)).otherwise(numbers)).otherwise(F.slice(numbers, F.lit(1), F.lit(0)))
    names = F.when(F.lower("l.name") == "mrulistex", F.transform(numbers, lambda n: n.cast("string"))).otherwise(F.filter(F.split("l.text", ""), lambda c: c != ""))
    return best.select("image", "user", "key", F.posexplode(names).alias("position", "low")).groupBy("image", "user", "key", F.lower("low").alias("low")).agg(F.max("position").alias("position"))


def mru_entries(values: DataFrame, keep: Sequence[str] = ("image",)) -> DataFrame:
    """Entries of RunMRU, TypedPaths, WordWheelQuery and RecentDocs (with its subkeys) with their positions.

    There are about as many positions as entries, so they are merged: sizes that are estimated before values are read can be far too small, and a broadcast then takes them all to the driver.
    """
    kind, listed = F.lit(None).cast("string"), F.lit(False)
    for path, name, ordered in MRU_KINDS:
        here = _is("key", EXPLORER + path) | (_below(EXPLORER + path).isNotNull() if name == "recent_doc" else F.lit(False))
        kind, listed = F.when(here, name).otherwise(kind), F.when(here, ordered).otherwise(listed)
    own = values.where((F.col("hive") == "NTUSER") & ~_is("name", "MRUListEx", "MRUList", "")).withColumns({"kind": kind, "listed": listed}).where("kind IS NOT NULL")
    # commands end with \1; searches and documents are UTF-16 up to the first zero
    shown = F.when(F.col("kind") == "run_mru", F.regexp_replace("text", r"(?:\\1)*\\*$", "")).when(F.col("kind") == "typed_path", F.col("text")).otherwise(bytesfn.utf16_prefix(F.col("data")))
    own = own.withColumns({"shown": shown, "low": F.lower("name")}).where("shown <> ''").join(mru_positions(values).hint("merge"), ["image", "user", "key", "low"], "left")
    return _activity(own, keep, F.col("kind"), F.col("shown"), mru_position=F.when(F.col("listed"), F.col("position")))


def user_assist(values: DataFrame, keep: Sequence[str] = ("image",)) -> DataFrame:
    """UserAssist counters: names turned by 13 letters; only the 72-byte form of version 5 is read."""
    at = rf"(?i)^{EXPLORER}\UserAssist".replace("\\", "\\\\").replace("(?i)^Software", "(?i)^Software") + r"\\([^\\]+)"
    own = values.where("hive = 'NTUSER'").withColumns({"guid": F.regexp_extract("key", at + r"\\Count$", 1), "parent": F.regexp_extract("key", at + "$", 1)})
    versions = own.where((F.col("parent") != "") & _is("name", "Version")).groupBy("image", "user", F.lower("parent").alias("low")).agg(F.max(F.col("text").try_cast("int")).alias("version"))
    rows = own.where("guid <> ''").withColumn("low", F.lower("guid")).join(versions, ["image", "user", "low"], "left")
    size = F.coalesce(F.octet_length("data"), F.lit(0))
    read = (F.col("version") == USERASSIST_VERSION) & (size == USERASSIST_BYTES)
    field = lambda at, n=4: F.when(read, bytesfn.unsigned(F.col("data"), at, n))
    status = F.when(read, "ausgewertet").otherwise(F.concat(F.lit("nicht_ausgewertet (Version "), F.coalesce(F.col("version").cast("string"), F.lit("unbekannt")), F.lit(", "), size.cast("string"), F.lit(" Byte)")))
    ticks = F.when(field(60, 8) != 0, field(60, 8))
    values_ = attributes(art=F.lit("userassist"), benutzer=F.col("user"), wertname_roh=F.col("name"), hive_offset=F.col("hive_offset"), daten_status=status, ausfuehrungen=field(4), fokus_anzahl=field(8), fokus_zeit_ms=field(12), letzte_ausfuehrung_filetime=ticks, letzte_ausfuehrung_unix=timefn.filetime_seconds(ticks))
    return _finding(rows, keep, "useraktivitaet", textfn.rot13(F.col("name")), F.concat(F.lit("HKCU "), "user", F.lit("\\"), "key"), values_)


def shellbag_paths(bags: DataFrame, depth: int = 64) -> DataFrame:
    """``image``, ``user``, ``bag`` and ``path`` of shell bags (image, user, bag, parent, name): names from the root down, joined by parents; deeper than ``depth``, or below a missing parent, no path.

    Chains are doubled: each round joins every bag with what its ancestor already knows, so depth 64 takes six joins.
    """
    keys = ["image", "user"]
    now = bags.select(*keys, "bag", F.col("parent").alias("up"), F.array("name").alias("names"))
    known, reach = now, 1
    while reach < depth:
        above = known.select(*keys, F.col("bag").alias("up"), F.col("up").alias("further"), F.col("names").alias("above"))
        known = known.join(above, [*keys, "up"], "left").select(*keys, "bag", F.when(F.col("above").isNotNull(), F.col("further")).otherwise(F.col("up")).alias("up"), F.when(F.col("above").isNotNull(), F.concat("above", "names")).otherwise(F.col("names")).alias("names"))
        reach *= 2
    return known.select(*keys, "bag", F.when(F.col("up").isNull() & (F.size("names") <= depth), F.array_join("names", "\\")).alias("path"))


def executed_programs(amcache: DataFrame, shimcache: DataFrame) -> DataFrame:
    """Amcache entries (key, path, sha1, linked, key_filetime) and Shimcache entries (position, path, modified) as findings of one kind."""
    name = lambda c: F.element_at(F.split(c, r"[\\/]"), -1)
    a = amcache.select(F.lit("programmausfuehrung").alias("domain"), name("path").alias("name"), F.concat(F.lit("Amcache\\"), "key").alias("source"), attributes(quelle=F.lit("amcache"), pfad=F.col("path"), sha1=F.regexp_replace("sha1", "^0000", ""), verknuepft=F.col("linked"), registriert_filetime=F.when(F.col("key_filetime") != 0, F.col("key_filetime"))).alias("attributes"))
    s = shimcache.select(F.lit("programmausfuehrung").alias("domain"), name("path").alias("name"), F.lit("SYSTEM\\AppCompatCache").alias("source"), attributes(quelle=F.lit("shimcache"), pfad=F.col("path"), eintrag=F.col("position"), letzte_aenderung_filetime=F.when(F.col("modified") != 0, F.col("modified"))).alias("attributes"))
    return a.union(s)
