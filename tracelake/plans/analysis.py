"""Analyzers over value rows, files and dimension tables made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import bytesfn
from tracelake.operators import artifacts, dimensions, registry
from tracelake.session import table

from .registry import query

_RUN = "Microsoft\\Windows\\CurrentVersion\\Run"
_VALUE = "hive string, user string, key string, name string, text string, data binary"


def le_bytes(number: Column, size: int) -> Column:
    """A number's bytes, the lowest first."""
    digits = F.lpad(F.hex(number.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def value_rows(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """Every part as an installation that holds all the values; texts and bytes may be Columns over the part."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kinds = [x.split(" ") for x in _VALUE.split(", ")]
    structs = [F.struct(*(lit(x).cast(t).alias(n) for x, (n, t) in zip((*r, *[None] * (6 - len(r))), kinds, strict=True)), F.lit(i).cast("bigint").alias("hive_offset")) for i, r in enumerate(rows)]
    parts = table(spark, sf_dir, "part")
    every = parts.select(F.col("p_partkey").alias("image"), F.inline(F.array(*structs)))
    return every.withColumns({"key_offset": F.col("hive_offset") + 1000, "key_filetime": F.lit(0).cast("bigint")})


def _attributes(found: DataFrame, *names: str) -> DataFrame:
    """Findings with some of their attributes as columns."""
    return found.select(*(c for c in found.columns if c not in ("domain", "attributes")), *(F.try_element_at("attributes", F.lit(n)).alias(n) for n in names))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else x if isinstance(x, str) and x.startswith("@") else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


_OPTIONS, _LOGON, _WINDOWS = registry.IMAGE_OPTIONS, registry.WINLOGON, registry.WINDOWS
_AUTOSTARTS = [
    ("Updater", f"HKLM SOFTWARE\\{_RUN}", "HKLM SOFTWARE", None, None, None), ("Once", f"HKLM SOFTWARE\\{_RUN.lower()}once", "HKLM SOFTWARE", "", None, None), ("Chat", f"HKCU ann\\Software\\{_RUN}", "HKCU ann", "chat.exe", None, "ann"),
    ("Shell", f"HKLM SOFTWARE\\{_LOGON}", "Winlogon", "Explorer.exe", "nein", None), ("userinit", f"HKLM SOFTWARE\\{_LOGON}", "Winlogon", "C:\\x\\evil.exe", "ja", None), ("AppInit_DLLs", f"HKLM SOFTWARE\\{_WINDOWS}", "AppInit_DLLs", "a.dll", "ja", None),
    ("sethc.exe", f"HKLM SOFTWARE\\{_OPTIONS}\\sethc.exe", "IFEO-Debugger", "cmd.exe", "ja", None),
]


@query(f"""SELECT p_partkey AS image, name, source, ort, CASE WHEN name = 'Updater' THEN 'C:\\Tools\\' || p_size || '.exe' ELSE befehl END AS befehl, auffaellig, benutzer FROM part, {_values(_AUTOSTARTS)} v(name, source, ort, befehl, auffaellig, benutzer)""")
def reg_autostarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = value_rows(spark, sf_dir, [
        ("SOFTWARE", None, _RUN, "Updater", F.concat(F.lit("C:\\Tools\\"), F.col("p_size").cast("string"), F.lit(".exe"))), ("SOFTWARE", None, _RUN.lower() + "once", "Once"), ("SOFTWARE", None, _RUN, "", "x"),
        ("NTUSER", "ann", f"Software\\{_RUN}", "Chat", "chat.exe"), ("SOFTWARE", None, _LOGON, "Shell", "Explorer.exe"), ("SOFTWARE", None, _LOGON, "userinit", "C:\\x\\evil.exe"), ("SOFTWARE", None, _LOGON, "Other", "x"),
        ("SOFTWARE", None, _WINDOWS, "AppInit_DLLs", " "), ("SOFTWARE", None, _WINDOWS, "appinit_dlls", "a.dll"), ("SOFTWARE", None, f"{_OPTIONS}\\sethc.exe", "Debugger", "cmd.exe"), ("SOFTWARE", None, f"{_OPTIONS}\\a\\b", "Debugger", "cmd.exe"), ("SYSTEM", None, _RUN, "No", "x"),
    ])
    return _attributes(registry.autostarts(rows), "ort", "befehl", "auffaellig", "benutzer")


_SERVICES = [("Spooler", "C:\\Windows\\System32\\spoolsv.exe", "nein", "gewoehnlich", None, "2", "Print"), ("Bad", "%temp%\\a.exe", "ja", "auffaellig", "pfad:nutzerbeschreibbar", None, None), ("Tool", "powershell.exe -enc x", "ja", "unbestimmt", "systemwerkzeug", "3", None)]


@query(f"SELECT p_partkey AS image, name, 'SYSTEM\\ControlSet002\\Services\\' || name AS source, befehl, auffaellig, pfad_status, auffaellig_grund, start_typ, anzeigename FROM part, {_values(_SERVICES)} v(name, befehl, auffaellig, pfad_status, auffaellig_grund, start_typ, anzeigename)")
def reg_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of the control set in use; another set's are left aside."""
    at = "ControlSet002\\Services\\"
    rows: list[tuple] = [("SYSTEM", None, "Select", "Current", "2"), ("SYSTEM", None, "ControlSet001\\Services\\Old", "ImagePath", "x.exe"), ("SYSTEM", None, at + "Spooler\\Sub", "ImagePath", "x.exe")]
    for name, path, _, _, _, start, shown in _SERVICES:
        rows += [("SYSTEM", None, at + name, n, v) for n, v in (("ImagePath", path), ("Start", start), ("DisplayName", shown)) if v]
    return _attributes(registry.services(value_rows(spark, sf_dir, rows)), "befehl", "auffaellig", "pfad_status", "auffaellig_grund", "start_typ", "anzeigename")


@query(r"""SELECT p_partkey AS image, name, source, geraet, seriennummer, benutzer FROM part, LATERAL (SELECT * FROM (VALUES
('Stick ' || p_size, 'SYSTEM\ControlSet001\Enum\USBSTOR\Disk&Ven\S' || p_partkey, 'Disk&Ven', 'S' || p_partkey, NULL),
('Disk&Plain', 'SYSTEM\ControlSet001\Enum\USBSTOR\Disk&Plain\7&1', 'Disk&Plain', '7&1', NULL),
('\DosDevices\E:', 'SYSTEM\MountedDevices', '_??_usbstor#Disk#S' || p_partkey || '#{a}', NULL, NULL),
('{g' || p_size || '}', 'HKCU ann\MountPoints2', NULL, NULL, 'ann')) v(name, source, geraet, seriennummer, benutzer))""")
def reg_usb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USB devices, mounted ones and mount points; the control set is the first where none is named."""
    size, number = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    enum = "ControlSet001\\Enum\\USBSTOR\\"
    points = "Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\MountPoints2"
    rows = value_rows(spark, sf_dir, [
        ("SYSTEM", None, F.concat(F.lit(enum + "Disk&Ven\\S"), number), "FriendlyName", F.concat(F.lit("Stick "), size)), ("SYSTEM", None, F.concat(F.lit(enum + "Disk&Ven\\S"), number), "Class", "x"), ("SYSTEM", None, enum + "Disk&Plain\\7&1", "Class", "x"),
        ("SYSTEM", None, "MountedDevices", "\\DosDevices\\E:", None, utf16(F.concat(F.lit("\x01_??_usbstor#Disk#S"), number, F.lit("#{a}\x00")))), ("SYSTEM", None, "MountedDevices", "\\DosDevices\\C:", None, utf16(F.lit("DMIO:ID:"))),
        ("NTUSER", "ann", F.concat(F.lit(points + "\\{g"), size, F.lit("}")), "BaseClass", "Drive"), ("NTUSER", "ann", points + "\\CPC", "x", "y"),
    ])
    return _attributes(registry.usb_devices(rows).union(registry.mounts(rows)), "geraet", "seriennummer", "benutzer")


@query(r"""SELECT p_partkey AS image, name, art, 'S-1-5-21-' || p_size AS sid, CASE WHEN art = 'bam' THEN p_partkey::VARCHAR END AS letzte_ausfuehrung_unix, CASE WHEN art = 'bam' THEN (116444736000000005 + p_partkey * 10000000)::VARCHAR END AS letzte_ausfuehrung_filetime
FROM part, (VALUES ('\Device\HarddiskVolume3\a.exe', 'bam'), ('C:\b.exe', 'dam')) v(name, art)""")
def reg_last_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last executions by SID; an unset time is none, and a value that is no path no program."""
    sid = F.concat(F.lit("S-1-5-21-"), F.col("p_size").cast("string"))
    ticks = le_bytes(F.col("p_partkey") * 10_000_000 + F.lit(116444736000000005), 8)
    bam, dam = (F.concat(F.lit(f"ControlSet001\\Services\\{k}\\UserSettings\\"), sid) for k in ("bam\\State", "dam"))
    rows = value_rows(spark, sf_dir, [("SYSTEM", None, bam, "\\Device\\HarddiskVolume3\\a.exe", None, F.concat(ticks, F.unhex(F.lit("00FF")))), ("SYSTEM", None, dam, "C:\\b.exe", None, F.unhex(F.lit("00" * 8))), ("SYSTEM", None, bam, "SequenceNumber", None, ticks), ("SYSTEM", None, bam, "C:\\short.exe", None, F.unhex(F.lit("0102")))])
    return _attributes(registry.last_executions(rows), "art", "sid", "letzte_ausfuehrung_unix", "letzte_ausfuehrung_filetime").drop("source")


@query("""SELECT p_partkey AS image, name, eingegeben_unix FROM part, LATERAL (SELECT * FROM (VALUES ('http://' || p_size || '.example/', p_partkey::VARCHAR), ('ftp://b', NULL)) v(name, eingegeben_unix))""")
def reg_typed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed addresses with the times of the values of the same names; a time that is unset is none."""
    at = registry.TYPED_URLS
    rows = value_rows(spark, sf_dir, [
        ("NTUSER", "ann", at, "url1", F.concat(F.lit("http://"), F.col("p_size").cast("string"), F.lit(".example/"))), ("NTUSER", "ann", at, "url2", "ftp://b"), ("NTUSER", "ann", at, "url3", ""),
        ("NTUSER", "ann", at + "Time", "URL1", None, le_bytes(F.col("p_partkey") * 10_000_000 + F.lit(116444736000000000), 8)), ("NTUSER", "ann", at + "Time", "url2", None, F.unhex(F.lit("00" * 8))),
    ])
    return _attributes(registry.typed_urls(rows), "eingegeben_unix").drop("source")


@query("""SELECT p_partkey AS image, art, name, mru_position FROM part, LATERAL (SELECT * FROM (VALUES ('run_mru', 'cmd ' || p_size, '1'), ('run_mru', 'notepad', '0'), ('typed_path', 'C:\\x', NULL), ('explorer_suche', 'find ' || p_name, '0'), ('explorer_suche', 'other', NULL),
('recent_doc', 'a.txt', '1'), ('recent_doc', 'b.txt', '0')) v(art, name, mru_position))""")
def reg_mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of lists ordered by letters or by numbers up to the end mark, and of one without an order."""
    at, four = registry.EXPLORER, lambda *n: F.unhex(F.lit("".join(x.to_bytes(4, "little").hex() for x in n)))
    wide = lambda c: F.concat(utf16(c), F.unhex(F.lit("00004100")))
    rows = value_rows(spark, sf_dir, [
        ("NTUSER", "ann", at + "\\RunMRU", "a", F.concat(F.lit("cmd "), F.col("p_size").cast("string"), F.lit("\\1"))), ("NTUSER", "ann", at + "\\RunMRU", "b", "notepad\\1"), ("NTUSER", "ann", at + "\\RunMRU", "MRUList", "ba"),
        ("NTUSER", "ann", at + "\\TypedPaths", "url1", "C:\\x"), ("NTUSER", "ann", at + "\\WordWheelQuery", "7", None, wide(F.concat(F.lit("find "), "p_name"))), ("NTUSER", "ann", at + "\\WordWheelQuery", "9", None, wide(F.lit("other"))),
        ("NTUSER", "ann", at + "\\WordWheelQuery", "MRUListEx", None, four(7, 0xFFFFFFFF, 9)), ("NTUSER", "ann", at + "\\RecentDocs\\.txt", "0", None, wide(F.lit("a.txt"))), ("NTUSER", "ann", at + "\\RecentDocs\\.txt", "1", None, wide(F.lit("b.txt"))),
        ("NTUSER", "ann", at + "\\RecentDocs\\.txt", "MRUListEx", None, four(1, 0)),
    ])
    return _attributes(registry.mru_entries(rows), "art", "mru_position").drop("source")


@query(r"""SELECT p_partkey AS image, name, status AS daten_status, CASE WHEN status = 'ausgewertet' THEN p_size::VARCHAR END AS ausfuehrungen, CASE WHEN status = 'ausgewertet' THEN p_partkey::VARCHAR END AS letzte_ausfuehrung_unix
FROM part, (VALUES ('C:\Tool.exe', 'ausgewertet'), ('UEME_CTLSESSION', 'nicht_ausgewertet (Version 5, 4 Byte)')) v(name, status)""")
def reg_user_assist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with their names turned back; data of another length are said not to be read."""
    at = registry.EXPLORER + "\\UserAssist\\{GUID}"
    zero = lambda n: F.unhex(F.lit("00" * n))
    data = F.concat(zero(4), le_bytes(F.col("p_size"), 4), zero(52), le_bytes(F.col("p_partkey") * 10_000_000 + F.lit(116444736000000000), 8), zero(4))
    rows = value_rows(spark, sf_dir, [("NTUSER", "ann", at, "Version", "5"), ("NTUSER", "ann", at + "\\Count", "P:\\Gbby.rkr", None, data), ("NTUSER", "ann", at + "\\count", "HRZR_PGYFRFFVBA", None, zero(4))])
    return _attributes(registry.user_assist(rows), "daten_status", "ausfuehrungen", "letzte_ausfuehrung_unix").drop("source")


@query(r"""SELECT c_custkey + 1000 AS bag, r_name || '\' || n_name || '\' || c_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_nationkey + 100, r_name || '\' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, NULL""")
def shellbag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of regions, nations and customers; one bag's parent is missing."""
    node = lambda t, bag, parent, name: table(spark, sf_dir, t).select(F.lit("i").alias("image"), F.lit("u").alias("user"), bag.cast("bigint").alias("bag"), parent.cast("bigint").alias("parent"), F.col(name).alias("name"))
    bags = node("region", F.col("r_regionkey"), F.lit(None), "r_name").union(node("nation", F.col("n_nationkey") + 100, F.col("n_regionkey"), "n_name")).union(node("customer", F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, "c_name"))
    lost = spark.createDataFrame([("i", "u", -1, -2, "lost")], bags.schema)
    return registry.shellbag_paths(bags.union(lost), 8).select("bag", "path")


@query(r"""SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 4 = 0 THEN 'tool.exe' WHEN o_custkey % 4 = 1 THEN 'S-1-5-21-7' WHEN o_orderkey % 2 = 0 THEN 'Netz' ELSE 'T' END AS name, CASE o_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '3' WHEN 2 THEN '1' END AS programm_id_typ,
CASE o_custkey % 4 WHEN 2 THEN 'IdBlob leer' END AS programm_hinweis, 'S-1-5-18' AS konto, CASE WHEN o_orderkey % 2 = 0 THEN 'Netz' END AS anbieter, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') END AS zeitpunkt_utc FROM orders""")
def usage_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as usage rows; programs are a text, a SID, an empty blob and one without an entry."""
    days = F.unix_date(F.col("o_orderdate").cast("date")) + 25569
    facts = table(spark, sf_dir, "orders").select(F.lit("db").alias("database"), F.when(F.col("o_orderkey") % 2 == 0, "{a-1}").otherwise("T").alias("table"), F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 4).cast("int").alias("app_id"), F.lit(9).alias("user_id"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(0.0)).otherwise(days.cast("double")).alias("ole_time"))
    sid = lambda *subs: bytes([1, len(subs), 0, 0, 0, 0, 0, 5]) + b"".join(x.to_bytes(4, "little") for x in subs)
    ids = [("db", 1, 0, 0, bytearray("old.exe".encode("utf-16-le"))), ("db", 2, 0, 0, bytearray("tool.exe\0".encode("utf-16-le"))), ("db", 3, 1, 3, bytearray(sid(21, 7))), ("db", 4, 2, 1, bytearray(b"")), ("db", 5, 9, 3, bytearray(sid(18)))]
    id_map = spark.createDataFrame(ids, "database string, entry int, id int, id_type int, blob binary")
    found = dimensions.usage_findings(facts, id_map, spark.createDataFrame([("{A-1}", "Netz")], "guid string, provider string"))
    return _attributes(found, "programm_id_typ", "programm_hinweis", "konto", "anbieter", "zeitpunkt_utc").drop("database", "source")


@query(r"""SELECT page_id AS row_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN ':2024: ann@' || url ELSE url END AS name, CASE WHEN page_id % 4 < 2 THEN url END AS url, CASE WHEN page_id % 4 < 2 THEN 'ann' END AS url_konto, CASE WHEN page_id % 4 = 1 THEN '20240101-20240102' END AS zeitraum,
CASE WHEN page_id % 4 <> 3 AND page_id % 3 < 2 THEN 'C:\Cache\' || CASE page_id % 3 WHEN 0 THEN 'ABCDEFGH' ELSE 'IJKLMNOP' END || '\f' || page_id || '.htm' END AS cache_datei, CASE WHEN page_id % 4 = 3 THEN 'webcache_tabelle' ELSE 'webcache_eintrag' END AS art, CASE WHEN page_id % 4 <> 3 THEN page_id::VARCHAR END AS letzter_zugriff_unix FROM pages""")
def cache_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cache entries in both history forms and in none, in sub-folders one, two and a missing third."""
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("Visited: ann@"), "url")).when(k == 1, F.concat(F.lit(":2024010120240102: ann@"), "url")).when(k == 2, F.concat(F.lit(":2024: ann@"), "url")).otherwise(F.col("url"))
    entries = table(spark, sf_dir, "pages").select(F.lit("db").alias("database"), F.when(k == 3, "Other").otherwise("Container_7").alias("table"), F.col("page_id").alias("row_id"), url.alias("url"), F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".htm")).alias("file_name"), (F.col("page_id") % 3 + 1).cast("int").alias("folder"), (F.col("page_id") * 10_000_000 + F.lit(116444736000000000)).alias("accessed"), F.lit(0).cast("bigint").alias("created"))
    containers = spark.createDataFrame([("db", 7, "History", "C:\\Cache\\", "ABCDEFGHIJKLMNOPrest")], "database string, container_id bigint, container string, directory string, secure string")
    return _attributes(dimensions.cache_findings(entries, containers), "url", "url_konto", "zeitraum", "cache_datei", "art", "letzter_zugriff_unix").drop("database", "source")


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'app' || p_size WHEN p_partkey % 3 = 1 THEN NULL END AS program, CASE WHEN p_partkey % 2 = 0 THEN 'SER' || p_size END AS serial, CASE WHEN p_partkey % 5 <> 0 THEN '{ab-' || p_size || '}' END AS guid FROM part""")
def name_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs, serial numbers and GUIDs inside longer names."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    app = F.when(key % 3 == 0, F.concat(F.lit("!!app"), size, F.lit("!x!y"))).when(key % 3 == 1, F.lit("!!!x")).otherwise(F.lit("!app"))
    device = F.when(key % 2 == 0, F.concat(F.lit("_??_UsbStor#Disk&Ven#SER"), size, F.lit("#{g}"))).otherwise(F.lit("SCSI#Disk#1"))
    name = F.when(key % 5 != 0, F.concat(F.lit("\\??\\Volume{AB-"), size, F.lit("}"))).otherwise(F.lit("C:"))
    return table(spark, sf_dir, "part").select("p_partkey", dimensions.timeline_name(app).alias("program"), dimensions.device_serial(device).alias("serial"), dimensions.braced_guid(name).alias("guid"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'S-1-5-21-' || p_partkey END AS sid, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS text, CASE WHEN p_partkey % 4 <> 0 THEN 'S-1-5-21-' || p_partkey ELSE '0102000000000005' END AS identifier FROM part")
def binary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary SIDs, some cut short, and UTF-16LE texts, some of odd length."""
    head = F.unhex(F.lit("0102000000000005"))
    data = F.when(F.col("p_partkey") % 4 == 0, head).otherwise(F.concat(head, le_bytes(F.lit(21), 4), le_bytes(F.col("p_partkey"), 4)))
    wide = F.when(F.col("p_partkey") % 3 == 0, F.concat(utf16(F.col("p_name")), F.unhex(F.lit("41")))).otherwise(F.concat(utf16(F.col("p_name")), F.unhex(F.lit("0000"))))
    short = F.when(F.col("p_partkey") % 4 == 0, F.lower(F.hex(data))).otherwise(bytesfn.identifier_text(data))
    return table(spark, sf_dir, "part").select("p_partkey", bytesfn.sid_text(data).alias("sid"), bytesfn.utf16_text(wide).alias("text"), short.alias("identifier"))


_TASK = "<Task><RegistrationInfo><Date>2024</Date><Author>a &amp; b</Author></RegistrationInfo><Actions><Exec><Command>{c}</Command><Arguments>{a}</Arguments></Exec>{m}</Actions></Task>"


@query(r"""SELECT p_partkey AS file_id, 'Job\t' || p_partkey AS name, CASE WHEN k = 2 THEN '' WHEN k = 0 THEN '"C:\Windows\System32\x.exe" /q' ELSE 'powershell.exe -enc ' || p_size END AS befehl, CASE k WHEN 0 THEN 'exec,com_handler' WHEN 1 THEN 'exec' ELSE 'sonstige' END AS aktion, CASE k WHEN 1 THEN 'ja' ELSE 'nein' END AS auffaellig,
CASE k WHEN 1 THEN 'systemwerkzeug_argumente:kodiert,pfad:nutzerbeschreibbar' END AS auffaellig_grund, CASE k WHEN 1 THEN 'C:\Users\a\b.exe' END AS weitere_befehle, CASE k WHEN 0 THEN '{c}' END AS com_handler, CASE k WHEN 0 THEN 'gewoehnlich' WHEN 1 THEN 'unbestimmt' END AS pfad_status, 'a & b' AS autor FROM (SELECT *, p_partkey % 3 AS k FROM part)""")
def task_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with a command and a COM handler, with two commands, and with none."""
    k = F.col("p_partkey") % 3
    more = "<Exec><Command>C:\\Users\\a\\b.exe</Command></Exec>"
    com = "<ComHandler><ClassId>{c}</ClassId></ComHandler>"
    first = F.lit(_TASK.format(c='"C:\\Windows\\System32\\x.exe"', a="/q", m=com))
    second = F.replace(F.lit(_TASK.format(c="powershell.exe", a="-enc SIZE", m=more)), F.lit("SIZE"), F.col("p_size").cast("string"))
    none = F.regexp_replace(first, "(?s)<Actions>.*</Actions>", "")
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("windows\\System32\\Tasks\\Job\\t"), F.col("p_partkey").cast("string")).alias("path"), F.when(k == 0, first).when(k == 1, second).otherwise(none).alias("text"))
    found = artifacts.task_findings(files.union(files.withColumn("path", F.lit("Users\\t"))))
    return _attributes(found, "befehl", "aktion", "auffaellig", "auffaellig_grund", "weitere_befehle", "com_handler", "pfad_status", "autor").drop("source")


_ONION = "a" * 50 + "234567"
_TRACES = [("hidden_service_hostname", _ONION + ".onion"), ("hidden_service_key", "hs_ed25519_secret_key"), ("torrc_direktive", "HiddenServiceDir /x"), ("torrc_direktive", "SocksPort 9050"), ("onion_in_torrc", _ONION + ".onion"), ("torrc_gefunden", "torrc"), ("tor_programm", "tor.exe"), ("webserver_localhost", "Listen 127.0.0.1:80")]


@query(f"""SELECT p_partkey AS file_id, name, art FROM part JOIN {_values([(i, *t) for i, t in zip((0, 1, 2, 2, 2, 3, 4, 5), _TRACES, strict=True)])} v(i, art, name) ON v.i::INT = p_partkey % 8""")
def hidden_service_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an onion service by name, and others that only look like it."""
    named = [("Hostname", _ONION + ".onion\n"), ("hs_ed25519_secret_key", ""), ("torrc", f"# x\n HiddenServiceDir /x\r\nSocksPort 9050\n{_ONION}.onion"), ("TORRC", "# none"), ("Tor.exe", ""), ("nginx.conf", "a\n Listen 127.0.0.1:80\nlisten localhost"), ("nginx.conf", "listen 80"), ("hostname", "short.onion")]
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in named)), (F.col("p_partkey") % 8 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("srv\\"), pick(0)).alias("path"), pick(1).alias("text"))
    return _attributes(artifacts.hidden_service_findings(files), "art").drop("source")


@query(r"""SELECT p_partkey AS file_id, 'a' || p_size || '.lnk' AS name FROM part WHERE p_partkey % 4 = 0""")
def startup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("p_partkey") % 4, "Users\\a\\AppData\\Start Menu\\Programs\\Startup\\"
    rest = F.when(k == 0, F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit(".lnk"))).when(k == 1, F.lit("Desktop.ini")).when(k == 2, F.lit("sub\\a.lnk")).otherwise(F.lit(""))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit(at), rest).alias("path"))
    return artifacts.startup_findings(files).select("file_id", "name")


@query(r"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS kept FROM customer""")
def user_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of users, of the system, of application data, and of a folder that only begins alike."""
    at = F.element_at(F.array(*map(F.lit, ("Users\\a\\", "WINDOWS\\x\\", "Users\\a\\AppData\\", "windowsapps\\", "$Recycle.Bin\\"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", artifacts.is_user_content(F.concat(at, "c_name")).alias("kept"))


@query(r"""SELECT o_orderkey AS mft_record, CASE WHEN o_orderkey % 5 = 0 THEN 'verzeichnis' ELSE 'datei' END AS typ, 'f' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END ELSE o_custkey + 1 END AS groesse, CASE WHEN o_orderkey % 3 <> 0 THEN 'system|archiv' END AS attribute,
CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'h' || o_orderkey END AS sha256, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'kaputt' ELSE 'kein Datensatz' END END AS fehler, CASE WHEN o_orderkey % 4 = 0 THEN 'lesefehler' END AS inhalt_fehler FROM orders""")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries with record infos (some missing, some with an error) and contents (some unread)."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = (F.lit(0).alias("volume"), key.alias("mft_record"))
    entries = orders.select(*at, F.lit(5).cast("bigint").alias("parent"), F.concat(F.lit("a\\b\\f"), key.cast("string")).alias("path"), (key % 5 == 0).alias("is_directory"), F.col("o_custkey").alias("size"))
    infos = orders.where("o_orderkey % 3 <> 0 OR o_orderkey % 6 = 0").select(*at, (F.col("o_custkey") + 1).alias("data_size"), F.lit(1).alias("sequence"), F.lit(0x24).cast("bigint").alias("attribute_bits"), F.when(key % 6 == 0, "kaputt").alias("error"))
    contents = orders.where("o_orderkey % 2 = 0").select(*at, F.concat(F.lit("h"), key.cast("string")).alias("sha256"), F.lit("pdf").alias("kind"), F.when(key % 4 == 0, "lesefehler").alias("error"))
    return artifacts.catalog_rows(entries, infos, contents).select("mft_record", "typ", "name", "groesse", "attribute", "sha256", "fehler", "inhalt_fehler")


@query(r"""SELECT p_partkey AS image, 'programmausfuehrung' AS domain, CASE k WHEN 0 THEN 'a.exe' ELSE 'b' || p_size || '.exe' END AS name, CASE k WHEN 0 THEN 'amcache' ELSE 'shimcache' END AS quelle, CASE k WHEN 0 THEN repeat('ab', 20) END AS sha1, CASE k WHEN 1 THEN p_partkey::VARCHAR END AS eintrag FROM part, (SELECT unnest([0, 1]) AS k)""")
def executed_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    zero = F.lit(0).cast("bigint")
    amcache = parts.select(F.concat(F.lit("Root\\"), F.col("p_partkey").cast("string")).alias("key"), F.lit("c:\\x\\a.exe").alias("path"), F.lit("0000" + "ab" * 20).alias("sha1"), F.lit("2024").alias("linked"), zero.alias("key_filetime"))
    shimcache = parts.select(F.col("p_partkey").alias("position"), F.concat(F.lit("C:\\b"), F.col("p_size").cast("string"), F.lit(".exe")).alias("path"), zero.alias("modified"))
    found = _attributes(registry.executed_programs(amcache, shimcache), "quelle", "sha1", "eintrag")
    image = F.coalesce(F.col("eintrag").cast("bigint"), F.regexp_extract("source", r"(\d+)$", 1).try_cast("bigint"))
    return found.select(image.alias("image"), F.lit("programmausfuehrung").alias("domain"), "name", "quelle", "sha1", "eintrag")
