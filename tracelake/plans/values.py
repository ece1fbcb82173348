"""Scalar functions over addresses, paths, commands, bit masks and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import netfn, textfn, timefn
from tracelake.session import table

from .registry import query
from .timeline import micros

_MIXED = "CASE page_id % 3 WHEN 0 THEN upper(url) WHEN 1 THEN replace(url, '://', ':') ELSE url END"


def _mixed() -> Column:
    return F.when(F.col("page_id") % 3 == 0, F.upper("url")).when(F.col("page_id") % 3 == 1, F.replace(F.col("url"), F.lit("://"), F.lit(":"))).otherwise(F.col("url"))


@query(f"""SELECT page_id, 'url:' || CASE WHEN regexp_matches(u, '^[^:/?#]+://[^/?#]*') THEN lower(regexp_extract(u, '^([^:/?#]+)://([^/?#]*)(.*)$', 1)) || '://' || lower(regexp_extract(u, '^([^:/?#]+)://([^/?#]*)(.*)$', 2)) || regexp_extract(u, '^([^:/?#]+)://([^/?#]*)(.*)$', 3) ELSE u END AS key
FROM (SELECT page_id, {_MIXED} AS u FROM pages)""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", textfn.url_canonical(_mixed()).alias("key"))


@query("SELECT page_id, CASE WHEN page_id % 4 <> 1 THEN lower(regexp_extract(url, '://([^/]+)', 1)) END AS host FROM pages")
def host_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of addresses, of plain names with a final dot, and none of names with a bad label."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    text = F.when(F.col("page_id") % 4 == 0, F.concat(F.upper(host), F.lit("."))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("-"), host)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", textfn.host_normalize(text).alias("host"))


@query(r"""WITH g AS (SELECT p_partkey, p_partkey % 4 AS form, p_size AS a, p_partkey % 3 AS b FROM part)
SELECT p_partkey, CASE form WHEN 0 THEN '2001:db8:' || CASE WHEN b = 0 THEN ':' ELSE '0:' || lower(to_hex(b)) || ':' END || lower(to_hex(a)) || CASE WHEN b = 0 THEN '' ELSE '::' END
 WHEN 1 THEN '::ffff:10.0.' || b || '.' || a WHEN 2 THEN CASE WHEN b > 0 THEN 'fe80::' || lower(to_hex(a)) || ':0:0:' || b END ELSE '10.' || b || '.0.' || a END AS address FROM g""")
def ip_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses spelt at length, with capitals and leading zeros, with IPv4 behind, and with too many groups."""
    a, b = F.hex("p_size"), (F.col("p_partkey") % 3).cast("string")
    long = F.concat(F.lit("2001:0DB8:"), F.when(b == "0", F.concat(F.lit("0:0:0:0:0:"), F.lpad(a, 4, "0"))).otherwise(F.concat(F.lit("0:000"), b, F.lit(":"), a, F.lit(":0:0:0"))))
    mapped = F.concat(F.lit("0:0:0:0:0:FFFF:10.0."), b, F.lit("."), F.col("p_size").cast("string"))
    links = F.when(b == "0", F.concat(F.lit("fe80:0:0:0:0:0:"), a, F.lit(":0:0"))).otherwise(F.concat(F.lit("FE80:0:0:0:"), a, F.lit(":0:0:"), b))
    plain = F.concat(F.lit("10."), b, F.lit(".0."), F.col("p_size").cast("string"))
    form = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", netfn.ip_canonical(F.when(form == 0, long).when(form == 1, mapped).when(form == 2, links).otherwise(plain)).alias("address"))


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'C:\Program Files\' || replace(p_name, '/', '\') || '\%zz ä.txt' END AS path FROM part")
def file_url_to_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("%20"))
    url = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("http://x/")).otherwise(F.lit("file:///C:/")), F.lit("Program%20Files/"), name, F.lit("/%zz%20%C3%A4.txt"))
    return table(spark, sf_dir, "part").select("p_partkey", textfn.file_url_path(url).alias("path"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS user_name FROM customer")
def user_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("C:\\Users\\"), "c_name", F.lit("\\a.txt"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("users\\"), "c_mktsegment")).otherwise(F.concat(F.lit("D:\\superusers\\"), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", textfn.user_from_path(path).alias("user_name"))


@query(r"SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'c:' WHEN 1 THEN 'harddiskvolume2:' END AS volume, CASE WHEN s_suppkey % 3 < 2 THEN '\' || lower(s_name) || '\x' END AS rest FROM supplier")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("C:/"), "s_name", F.lit("/X"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("\\Device\\HarddiskVolume2\\"), "s_name", F.lit("\\X"))).otherwise(F.col("s_name"))
    volume, rest = textfn.path_parts(path)
    return table(spark, sf_dir, "supplier").select("s_suppkey", volume.alias("volume"), rest.alias("rest"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'C:\My Tools\' || p_size || '\run.exe' WHEN 1 THEN 'D:\bin\tool' || p_size || '.cmd' WHEN 2 THEN 'E:\a b\c.ps1' END AS program FROM part""")
def program_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    command = F.when(k == 0, F.concat(F.lit('"C:\\My Tools\\'), size, F.lit('\\run.exe" /q'))).when(k == 1, F.concat(F.lit("D:\\bin\\tool"), size, F.lit(".cmd -x"))).when(k == 2, F.lit("E:\\a b\\c.ps1 arg")).otherwise(F.concat(F.lit("notepad.exe "), size))
    return table(spark, sf_dir, "part").select("p_partkey", textfn.program_path(command).alias("program"))


# command, path status, reason, system tool, suspicious argument, unquoted space
_COMMANDS = (
    ('"C:\\Windows\\System32\\cmd.exe" /c dir', "gewoehnlich", None, True, None, False),
    ("C:\\Program Files\\a b\\x.exe -w hidden", "gewoehnlich", None, False, "versteckt", True),
    ("%comspec% /c http://a.example/x", "gewoehnlich", None, True, "url", False),
    ("%temp%\\a.exe", "auffaellig", "nutzerbeschreibbar", False, None, False),
    ("%unknown%\\a.exe", "unbestimmt", "unbekannte_variable", False, None, False),
    ("\\\\server\\share\\a.exe", "auffaellig", "unc_pfad", False, None, False),
    ("system32\\svchost.exe -k netsvcs", "gewoehnlich", None, False, None, False),
    ("powershell.exe -nop -enc QQBB -x", "unbestimmt", "ohne_verzeichnis", True, "kodiert", False),
    ("C:\\a\\..\\b.exe", "auffaellig", "pfad_traversal", False, None, False),
    ("D:\\tools\\x.exe", "auffaellig", "ausserhalb_standardorte", False, None, False),
)


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


@query("SELECT p_partkey, path_status, reason, lolbin, suspicious_args, unquoted_space FROM part JOIN (VALUES " + ", ".join(f"({i}, {', '.join(map(_quoted, c[1:]))})" for i, c in enumerate(_COMMANDS)) + ") v(i, path_status, reason, lolbin, suspicious_args, unquoted_space) ON i = p_partkey % 10")
def command_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = F.array(*(F.lit(c[0]) for c in _COMMANDS))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(commands, (F.col("p_partkey") % 10 + 1).cast("int")).alias("command"))
    return textfn.rate_commands(rows, "command").select("p_partkey", "path_status", "reason", "lolbin", "suspicious_args", "unquoted_space")


def _bits_sql(mask: str, flags: tuple) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {mask} & {bit} <> 0 THEN '{name}' END" for bit, name in flags) + ")"


@query(f"SELECT o_orderkey, {_bits_sql('(o_orderkey * 2654435761 % 4294967296)', textfn.USN_REASONS)} AS reasons, (o_orderkey * 2654435761 % 4294967296) & {0xFFFFFFFF ^ sum(b for b, _ in textfn.USN_REASONS)} AS unknown, {_bits_sql('(o_orderkey * 40503 % 65536)', textfn.FILE_ATTRIBUTES)} AS attributes FROM orders")
def bitmask_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason, attribute = F.col("o_orderkey") * F.lit(2654435761) % F.lit(4294967296), F.col("o_orderkey") * 40503 % 65536
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(textfn.bit_names(reason, textfn.USN_REASONS), "|").alias("reasons"), textfn.unknown_bits(reason, textfn.USN_REASONS).alias("unknown"), F.array_join(textfn.bit_names(attribute, textfn.FILE_ATTRIBUTES), "|").alias("attributes"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(((epoch_us(o_orderdate) % 1000000) * 10 + o_orderkey % 10)::VARCHAR, 7, '0') || 'Z' END AS iso FROM orders""")
def filetime_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of order dates with a last digit of their own; every tenth is unset."""
    ticks = F.when(F.col("o_orderkey") % 10 == 0, F.lit(0)).otherwise(micros("o_orderdate") * 10 + timefn.EPOCH_TICKS + F.col("o_orderkey") % 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", timefn.filetime_iso(ticks.cast("bigint")).alias("iso"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN (epoch_us(l_shipdate) * 10 + 116444736000000000 + l_linenumber)::VARCHAR END AS ticks FROM lineitem")
def iso_to_filetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO texts read strictly; those with a space for the T are none."""
    text = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_linenumber") == 2, " ").otherwise("T"), F.date_format("l_shipdate", "HH:mm:ss.SSSSSS"), F.col("l_linenumber").cast("string"), F.lit("Z"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", timefn.iso_filetime(text).cast("string").alias("ticks"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN epoch_ms(o_orderdate) + 43200000 END AS millis FROM orders")
def ole_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)") + 43200000) / 86400000.0 + 25569
    return table(spark, sf_dir, "orders").select("o_orderkey", timefn.ole_millis(F.when(F.col("o_orderkey") % 7 == 0, F.lit(0.5)).otherwise(days)).alias("millis"))
