"""Analyzers over files: scheduled tasks, startup folders, hidden services, catalog rows and the path scope of user content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import textfn
from tracelake.operators.registry import attributes

# Places and names.
TASK_FOLDER = "Windows\\System32\\Tasks"
STARTUP = r"\start menu\programs\startup" + "\\"
NO_USER_CONTENT = (
    "windows\\", "program files\\", "program files (x86)\\", "programdata\\", "$recycle.bin\\", "system volume information\\", "msocache\\", "perflogs\\",
    "recovery\\", "$windows.~bt\\", "$windows.~ws\\",
)
SERVICE_KEYS = ("hs_ed25519_secret_key", "hs_ed25519_public_key")
SERVER_FILES = ("nginx.conf", "httpd.conf", "apache2.conf")
TOR_DIRECTIVES = ("hiddenservicedir", "hiddenserviceport", "socksport", "controlport")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, r"\\"), -1)


def by_name(files: DataFrame, *names: str, path: str = "path") -> DataFrame:
    """Files of a name, letter case aside."""
    return files.where(F.lower(file_name(path)).isin(*(n.lower() for n in names)))


def under(files: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Files in a folder and below, letter case aside."""
    return files.where(F.startswith(F.lower(path), F.lit(folder.lower().rstrip("\\") + "\\")))


def is_user_content(path: Column) -> Column:
    """Neither in a folder of the system or of programs, nor in application data."""
    low = F.lower(path)
    test = ~F.contains(low, F.lit("\\appdata\\"))
    for prefix in NO_USER_CONTENT:
        test = test & ~F.startswith(low, F.lit(prefix))
    return test


def _tag(xml: Column, name: str) -> Column:
    """The text of a tag's first occurrence, entities resolved; null if it has none."""
    found = F.trim(F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(char))
    return F.when(found != "", found)


def task_findings(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Scheduled tasks (key, path, text): commands in their order, COM handlers, and the rating of every command.

    Each action is a row while its command is rated, then a task's actions are gathered again.
    """
    tasks = under(files.where(F.contains("text", F.lit("<Task"))), TASK_FOLDER)
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)<Exec(?:\s[^>]*)?>(.*?)</Exec>"), 1)
    actions = tasks.select(key, F.posexplode(blocks).alias("place", "block")).select(key, "place", _tag(F.col("block"), "Command").alias("command"), _tag(F.col("block"), "Arguments").alias("arguments")).where("command IS NOT NULL")
    program = F.regexp_replace(F.trim("command"), r'^"+|"+$', "")
    whole = F.concat(F.lit('"'), program, F.lit('" '), F.coalesce("arguments", F.lit("")))
    rated = textfn.rate_commands(actions.withColumn("whole", whole), "whole")
    reasons = F.array_compact(F.array(F.when(F.col("path_status") == "auffaellig", F.concat(F.lit("pfad:"), F.coalesce("reason", F.lit("")))), F.when(F.col("lolbin") & F.col("suspicious_args").isNotNull(), F.concat(F.lit("systemwerkzeug_argumente:"), "suspicious_args"))))
    shown = F.concat("command", F.when(F.col("arguments").isNotNull(), F.concat(F.lit(" "), "arguments")).otherwise(""))
    step = F.struct("place", shown.alias("shown"), "path_status", reasons.alias("reasons"))
    gathered = rated.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"), F.max("lolbin").alias("tool"))
    full = tasks.join(gathered, key, "left")
    shown_all = F.transform("steps", lambda s: s["shown"])
    reasons_all = F.array_distinct(F.flatten(F.transform("steps", lambda s: s["reasons"])))
    com = F.regexp_extract_all("text", F.lit(r"(?s)<ComHandler(?:\s[^>]*)?>.*?<ClassId>\s*(.*?)\s*</ClassId>.*?</ComHandler>"), 1)
    has_exec, has_com = F.coalesce(F.size("steps") > 0, F.lit(False)), F.size(com) > 0
    kind = F.coalesce(F.nullif(F.concat_ws(",", F.when(has_exec, "exec"), F.when(has_com, "com_handler")), F.lit("")), F.lit("sonstige"))
    some = F.coalesce(F.size(reasons_all) > 0, F.lit(False))
    values = attributes(
        ort=F.lit("Aufgabe"), befehl=F.coalesce(F.try_element_at(shown_all, F.lit(1)), F.lit("")), aktion=kind, auffaellig=F.when(some, "ja").otherwise("nein"), registrierung_xml=_tag(F.col("text"), "Date"),
        weitere_befehle=F.when(F.size("steps") > 1, F.array_join(F.slice(shown_all, F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))), "\n")), com_handler=F.when(has_com, F.array_join(com, ",")),
        pfad_status=F.try_element_at(F.transform("steps", lambda s: s["path_status"]), F.lit(1)), systemwerkzeug=F.when(F.col("tool"), "ja"), auffaellig_grund=F.when(some, F.array_join(reasons_all, ",")), autor=_tag(F.col("text"), "Author"), benutzer=_tag(F.col("text"), "UserId"),
    )
    name = F.regexp_replace(F.substr("path", F.lit(len(TASK_FOLDER) + 1)), r"^\\+", "")
    return full.select(key, F.lit("persistence").alias("domain"), name.alias("name"), F.col("path").alias("source"), values.alias("attributes"))


def startup_findings(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Files right in a startup folder, but for its desktop.ini."""
    at = F.instr(F.lower("path"), F.lit(STARTUP))
    rest = F.when(at > 0, F.substr("path", at + len(STARTUP)))
    own = files.withColumn("rest", rest).where((F.col("rest") != "") & ~F.contains("rest", F.lit("\\")) & (F.lower("rest") != "desktop.ini"))
    return own.select(key, F.lit("persistence").alias("domain"), F.col("rest").alias("name"), F.col("path").alias("source"), attributes(ort=F.lit("Autostart-Ordner")).alias("attributes"))


def _onion(text: Column) -> Column:
    found = F.regexp_extract(text, r"([a-z2-7]{56}\.onion)", 1)
    return F.when(found != "", found)


def onion_traces(path: Column, text: Column) -> Column:
    """Traces of an onion service in a file, (kind, name): its name and keys, directives of torrc, the program, and servers that listen locally only."""
    low = F.lower(file_name(path))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    directive = lambda x: F.lower(x).rlike("^(?:" + "|".join(TOR_DIRECTIVES) + ")")
    directives = F.filter(lines, directive)
    listens = F.filter(lines, lambda x: F.lower(x).rlike(r"^listen.*(?:127\.0\.0\.1|localhost)"))
    one = lambda kind, name: F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    several = F.transform(directives, lambda x: F.struct(F.lit("torrc_direktive").alias("kind"), x.alias("name")))
    torrc = F.concat(several, F.array(one("torrc_gefunden", F.when(F.size(directives) == 0, F.lit("torrc"))), one("onion_in_torrc", _onion(text))))
    found = (
        F.when(low == "hostname", F.array(one("hidden_service_hostname", _onion(text))))
        .when(low.isin(*SERVICE_KEYS), F.array(one("hidden_service_key", low)))
        .when(low == "torrc", torrc)
        .when(low == "tor.exe", F.array(one("tor_programm", F.lit("tor.exe"))))
        .when(low.isin(*SERVER_FILES), F.array(one("webserver_localhost", F.try_element_at(listens, F.lit(1)))))
    )
    return F.filter(F.array_compact(found), lambda x: x["name"].isNotNull())


def hidden_service_findings(files: DataFrame, key: str = "file_id") -> DataFrame:
    """The onion service traces of files (key, path, text)."""
    rows = files.select(key, "path", F.inline(onion_traces(F.col("path"), F.col("text"))))
    return rows.select(key, F.lit("tor").alias("domain"), "name", F.col("path").alias("source"), attributes(art=F.col("kind")).alias("attributes"))


def catalog_rows(entries: DataFrame, infos: DataFrame, contents: DataFrame) -> DataFrame:
    """A catalog row for each index entry (volume, mft_record, parent, path, is_directory, size) with its record's info and its content's, where read.

    Without info, files keep the entry's size, and the row names the error.
    """
    at = ["volume", "mft_record"]
    full = entries.join(infos.select(*at, F.col("data_size"), "sequence", "attribute_bits", F.col("error").alias("info_error"), F.lit(True).alias("known")), at, "left").join(contents.select(*at, "sha256", "kind", F.col("error").alias("content_error")), at, "left")
    read = F.coalesce(F.col("known"), F.lit(False)) & F.col("info_error").isNull()
    return full.select(
        *at, F.col("parent").alias("parent_record"), F.when(F.col("is_directory"), "verzeichnis").otherwise("datei").alias("typ"), "path", file_name("path").alias("name"),
        F.when(read, F.col("data_size")).when(~F.col("is_directory"), F.col("size")).alias("groesse"), F.when(read, F.col("sequence")).alias("sequenz"),
        F.array_join(F.when(read, textfn.bit_names(F.col("attribute_bits"), textfn.FILE_ATTRIBUTES)), "|").alias("attribute"),
        F.when(F.col("content_error").isNull(), F.col("sha256")).alias("sha256"), F.when(F.col("content_error").isNull(), F.col("kind")).alias("dateityp"),
        F.when(~read, F.coalesce("info_error", F.lit("kein Datensatz"))).alias("fehler"), F.col("content_error").alias("inhalt_fehler"),
    )
