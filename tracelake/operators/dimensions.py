"""Facts with their dimension tables: network and energy usage by program and account, and web caches by container."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import bytesfn, timefn
from tracelake.operators.registry import attributes

#: fixed value: findings of one database at most; more are counted and said to be limited
MOST_FINDINGS = 500_000


def identifiers(id_map: DataFrame) -> DataFrame:
    """``id``, ``id_type`` and ``text`` of an identifier table (id, id_type, blob); the last entry of an id counts, an empty blob has no text."""
    text = F.when(F.octet_length("blob") > 0, bytesfn.identifier_text(F.col("blob")))
    return id_map.withColumn("text", text).groupBy("database", "id").agg(F.max_by(F.struct("id_type", "text"), "entry").alias("e")).select("database", "id", "e.id_type", "e.text")


def usage_findings(facts: DataFrame, id_map: DataFrame, providers: DataFrame) -> DataFrame:
    """Usage rows (database, table, row_id, app_id, user_id, ole_time) with program, account and provider.

    Two left joins with the identifier table of the same database, one with the provider names; Spark
    broadcasts them where they measure small. A row's name is its program, else its provider, else its table.
    """
    ids = identifiers(id_map)
    app = ids.select("database", F.col("id").alias("app_id"), F.col("id_type").alias("program_type"), F.col("text").alias("program"))
    user = ids.select("database", F.col("id").alias("user_id"), F.col("id_type").alias("account_type"), F.col("text").alias("account"))
    named = facts.withColumn("guid", F.upper("table")).join(providers.select(F.upper("guid").alias("guid"), "provider"), "guid", "left")
    full = named.join(app, ["database", "app_id"], "left").join(user, ["database", "user_id"], "left")
    empty = lambda kind, text: F.when(F.col(kind).isNotNull() & F.col(text).isNull(), F.lit("IdBlob leer"))
    millis = timefn.ole_millis(F.col("ole_time"))
    iso = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    values = attributes(
        art=F.lit("srum"), tabelle=F.col("table"), anbieter=F.col("provider"), AppId=F.col("app_id"), UserId=F.col("user_id"), programm_id_typ=F.col("program_type"), programm=F.col("program"), programm_hinweis=empty("program_type", "program"),
        konto_id_typ=F.col("account_type"), konto=F.col("account"), konto_hinweis=empty("account_type", "account"), zeitpunkt_utc=iso, zeitpunkt_ole=F.when(iso.isNotNull(), F.col("ole_time")),
    )
    return full.select("database", "row_id", F.lit("srum").alias("domain"), F.coalesce("program", "provider", "table").alias("name"), F.col("database").alias("source"), values.alias("attributes"))


def capped(findings: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = MOST_FINDINGS) -> DataFrame:
    """The first ``most`` findings of each group in a fixed order, ``found`` of all, and whether rows are missing."""
    place = Window.partitionBy(*keys)
    numbered = findings.withColumns({"_n": F.row_number().over(place.orderBy(*order)), "found": F.count(F.lit(1)).over(place)})
    return numbered.where(F.col("_n") <= most).withColumn("limited", F.col("found") > most).drop("_n")


def history_address(url: Column) -> tuple[Column, Column, Column]:
    """Period, account and address of a history entry, ``Visited: account@address`` or ``:YYYYMMDDYYYYMMDD: account@address``; nulls for other forms."""
    form = r"(?s)^(?:Visited: |:([0-9]{16}): )([^@]*)@(.*)$"
    hit = url.rlike(form)
    part = lambda k: F.when(hit, F.regexp_extract(url, form, k))
    digits = part(1)
    return F.when(digits != "", F.concat(F.left(digits, F.lit(8)), F.lit("-"), F.right(digits, F.lit(8)))), part(2), part(3)


def cache_findings(entries: DataFrame, containers: DataFrame) -> DataFrame:
    """Cache entries (database, table, row_id, url, file_name, folder, accessed, created) with their container (database, container_id, container, directory, secure).

    ``Container_<id>`` names the container. Its secure string is cut in names of eight characters, which ``folder``
    counts from 1; the cached file lies in the directory, the sub-folder, and under the entry's file name.
    """
    number = F.regexp_extract("table", r"^Container_(-?[0-9]+)$", 1).try_cast("bigint")
    full = entries.withColumn("container_id", number).join(containers, ["database", "container_id"], "left")
    folders = F.regexp_extract_all("secure", F.lit("(.{8})"), 1)
    sub = F.when(F.col("folder") >= 1, F.try_element_at(folders, F.col("folder")))
    base = F.rtrim(F.col("directory"), F.lit("\\"))
    path = F.when(F.col("file_name") != "", F.concat_ws("\\", base, F.when(F.col("folder").isNotNull(), sub), "file_name"))
    path = F.when(F.col("directory").isNotNull() & (F.col("folder").isNull() | sub.isNotNull()), path)
    period, account, address = (F.when(F.col("container").isNotNull(), c) for c in history_address(F.col("url")))
    inside = F.col("container_id").isNotNull()
    seconds = lambda c: F.when(inside & (F.col(c) > 0) & (F.col(c) != 2**63 - 1), timefn.filetime_seconds(F.col(c)))
    values = attributes(
        art=F.when(inside, "webcache_eintrag").otherwise("webcache_tabelle"), tabelle=F.col("table"), container=F.col("container"), container_verzeichnis=F.col("directory"), url=address, url_konto=account, zeitraum=period,
        cache_datei=path, letzter_zugriff_unix=seconds("accessed"), erstellt_unix=seconds("created"),
    )
    return full.select("database", "row_id", F.lit("browser").alias("domain"), F.coalesce(address, "url", "table").alias("name"), F.col("database").alias("source"), values.alias("attributes"))


def timeline_name(identifier: Column) -> Column:
    """The program of an app timeline's identifier ``!!name!…``."""
    name = F.regexp_extract(identifier, r"(?s)^!!([^!]*)", 1)
    return F.when(name != "", name)


def device_serial(device: Column) -> Column:
    """The third part of ``_??_USBSTOR#device#serial#{guid}``."""
    part = F.try_element_at(F.split(device, "#"), F.lit(3))
    return F.when(F.contains(F.upper(device), F.lit("USBSTOR#")) & (part != ""), part)


def braced_guid(name: Column) -> Column:
    """The first text in braces, lower-case, braces included."""
    found = F.lower(F.regexp_extract(name, r"(\{[^}]*\})", 1))
    return F.when(found != "", found)
