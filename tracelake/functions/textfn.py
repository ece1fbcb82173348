"""Paths, addresses, commands and bit masks as Column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import netfn
from tracelake.functions.netfn import is_ipv4  # noqa: F401

# Bits of change reasons and file attributes, and their names.
USN_REASONS = (
    (0x00000001, "DATA_OVERWRITE"), (0x00000002, "DATA_EXTEND"), (0x00000004, "DATA_TRUNCATION"), (0x00000010, "NAMED_DATA_OVERWRITE"),
    (0x00000020, "NAMED_DATA_EXTEND"), (0x00000040, "NAMED_DATA_TRUNCATION"), (0x00000100, "FILE_CREATE"), (0x00000200, "FILE_DELETE"),
    (0x00000400, "EA_CHANGE"), (0x00000800, "SECURITY_CHANGE"), (0x00001000, "RENAME_OLD_NAME"), (0x00002000, "RENAME_NEW_NAME"),
    (0x00004000, "INDEXABLE_CHANGE"), (0x00008000, "BASIC_INFO_CHANGE"), (0x00010000, "HARD_LINK_CHANGE"), (0x00020000, "COMPRESSION_CHANGE"),
    (0x00040000, "ENCRYPTION_CHANGE"), (0x00080000, "OBJECT_ID_CHANGE"), (0x00100000, "REPARSE_POINT_CHANGE"), (0x00200000, "STREAM_CHANGE"),
    (0x00400000, "TRANSACTED_CHANGE"), (0x00800000, "INTEGRITY_CHANGE"), (0x01000000, "DESIRED_STORAGE_CLASS_CHANGE"), (0x80000000, "CLOSE"),
)
FILE_ATTRIBUTES = (
    (0x0001, "schreibgeschuetzt"), (0x0002, "versteckt"), (0x0004, "system"), (0x0020, "archiv"), (0x0100, "temporaer"), (0x0200, "sparse"),
    (0x0400, "reparse_point"), (0x0800, "komprimiert"), (0x1000, "offline"), (0x2000, "nicht_indiziert"), (0x4000, "verschluesselt"),
)
# File types by their first bytes (hex).
SIGNATURES = (
    ("89504E470D0A1A0A", "png"), ("53514C69746520666F726D6174203300", "sqlite3"), ("255044462D", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"),
    ("504B0708", "zip"), ("7F454C46", "elf"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("1F8B", "gzip"),
    ("377ABCAF271C", "7z"), ("526172211A07", "rar"), ("D0CF11E0A1B11AE1", "ole_cfb"), ("456C6646696C6500", "evtx"), ("72656766", "registry_hive"),
    ("4C0000000114020000000000C000000000000046", "windows_lnk"),
)
# Fixed values of the command rating.
PROGRAM_ENDINGS = (".exe", ".com", ".bat", ".cmd", ".dll", ".sys", ".ps1", ".vbs", ".js", ".scr", ".cpl", ".msc")
SYSTEM_TOOLS = ("powershell", "pwsh", "cmd", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin", "msbuild", "installutil")
ARGUMENT_MARKERS = (
    ("http://", "url"), ("https://", "url"), ("ftp://", "url"), ("\\\\", "unc_pfad"), ("javascript:", "skriptprotokoll"), ("vbscript:", "skriptprotokoll"),
    ("\\users\\", "nutzerbeschreibbar"), ("\\appdata\\", "nutzerbeschreibbar"), ("\\temp\\", "nutzerbeschreibbar"), ("\\programdata\\", "nutzerbeschreibbar"),
    ("\\downloads\\", "nutzerbeschreibbar"), ("%temp%", "nutzerbeschreibbar"), ("%tmp%", "nutzerbeschreibbar"), ("%appdata%", "nutzerbeschreibbar"),
    ("%localappdata%", "nutzerbeschreibbar"), ("%userprofile%", "nutzerbeschreibbar"), ("%public%", "nutzerbeschreibbar"), ("-encodedcommand", "kodiert"),
    (" -enc ", "kodiert"), (" -ec ", "kodiert"), ("frombase64string", "kodiert"), ("downloadstring", "download"), ("downloadfile", "download"), ("hidden", "versteckt"),
)
VARIABLES = (
    (("systemroot", "windir"), "\\windows"), (("programfiles", "programfiles(x86)", "programw6432"), "\\program files"),
    (("commonprogramfiles", "commonprogramfiles(x86)", "commonprogramw6432"), "\\program files\\common files"), (("programdata", "allusersprofile"), "\\programdata"), (("systemdrive",), ""),
)
USER_VARIABLES = ("localappdata", "appdata", "userprofile", "temp", "tmp", "public", "onedrive", "homepath")
USER_PREFIXES = ("\\users\\", "\\programdata\\", "\\windows\\temp\\", "\\windows\\tasks\\", "\\$recycle.bin\\", "\\perflogs\\")
USER_PARTS = ("\\appdata\\", "\\temp\\", "\\downloads\\")
SYSTEM_PREFIXES = ("\\windows\\", "\\program files\\", "\\program files (x86)\\")
DEFENDER = "\\programdata\\microsoft\\windows defender\\platform\\"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def rot13(c: Column) -> Column:
    turn = lambda s: s[13:] + s[:13]
    return F.translate(c, _UPPER + _LOWER, turn(_UPPER) + turn(_LOWER))


def bit_names(mask: Column, flags: tuple[tuple[int, str], ...]) -> Column:
    """Names of the set bits, in the table's order."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in flags)))


def unknown_bits(mask: Column, flags: tuple[tuple[int, str], ...]) -> Column:
    return mask.bitwiseAND(F.lit(0xFFFFFFFF ^ functools.reduce(operator.or_, (bit for bit, _ in flags))))


def reference_parts(reference: Column) -> tuple[Column, Column]:
    """Record and sequence of a 64-bit file reference."""
    return reference.bitwiseAND(F.lit(0x0000FFFFFFFFFFFF)), F.shiftrightunsigned(reference, 48)


def signature_type(content: Column) -> Column:
    """The type that the first bytes tell."""
    digits = F.hex(content)
    at = F.conv(F.concat(*(F.substring(digits, 0x3C * 2 + k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("bigint")
    out = F.when(F.octet_length(content) == 0, "leer")
    out = out.when(digits.startswith("4D5A") & (F.octet_length(content) >= 64) & (at * 2 + 8 <= F.length(digits)) & (F.substr(digits, (at * 2 + 1).cast("int"), F.lit(8)) == "50450000"), "pe")
    for magic, name in SIGNATURES:
        out = out.when(digits.startswith(magic), name)
    return out.otherwise("unbekannt")


def path_extension(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"\.([^.\\/]+)$", 1))


def path_parts(path: Column) -> tuple[Column, Column]:
    """Volume (``c:`` or ``harddiskvolume3:``) and the rest of an absolute path, both lowered; null if it is none."""
    low = F.lower(F.regexp_replace(path, "/", "\\\\"))
    drive = F.regexp_extract(low, r"^(?:\\\\\?\\|\\\?\?\\)?([a-z]:)(\\.*)$", 1)
    drive_rest = F.regexp_extract(low, r"^(?:\\\\\?\\|\\\?\?\\)?([a-z]:)(\\.*)$", 2)
    device = F.regexp_extract(low, r"^\\device\\(harddiskvolume[0-9]+)(\\.*)$", 1)
    device_rest = F.regexp_extract(low, r"^\\device\\(harddiskvolume[0-9]+)(\\.*)$", 2)
    return F.when(drive != "", drive).when(device != "", F.concat(device, F.lit(":"))), F.when(drive != "", drive_rest).when(device != "", device_rest)


def user_from_path(path: Column, anchored: bool = False) -> Column:
    """The folder below ``Users``; anchored: only at the path's or drive's beginning."""
    pattern = r"(?i)^(?:[a-z]:)?\\?Users\\([^\\]+)" if anchored else r"(?i)(?:^|\\)Users\\([^\\]+)"
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found)


def url_canonical(url: Column) -> Column:
    """``url:`` with scheme and host lowered; text without ``://`` stays."""
    pattern = r"^([^:/?#]+)://([^/?#]*)(.*)$"
    key = F.concat(F.lower(F.regexp_extract(url, pattern, 1)), F.lit("://"), F.lower(F.regexp_extract(url, pattern, 2)), F.regexp_extract(url, pattern, 3))
    return F.concat(F.lit("url:"), F.when(url.rlike(pattern), key).otherwise(url))


def domain_canonical(name: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.trim(name), r"\.+$", ""))
    return F.when((plain != "") & ~plain.rlike(r"\s"), plain)


def hash_canonical(algorithm: Column, digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9A-Fa-f]+$"), F.lower(F.concat(algorithm, F.lit(":"), digits)))


def user_canonical(sid: Column, domain: Column, name: Column) -> Column:
    """``sid:`` upper for a valid SID, else ``name:`` with domain (if it says something) and name, lowered."""
    with_domain = F.when(F.coalesce(domain, F.lit("")).isin("", "."), F.lower(name)).otherwise(F.lower(F.concat(domain, F.lit("\\"), name)))
    return F.when(sid.rlike(r"(?i)^S-1-[0-9]+(-[0-9]+)+$"), F.concat(F.lit("sid:"), F.upper(sid))).when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("name:"), with_domain))


def host_normalize(text: Column) -> Column:
    """The host of an address or plain name, lowered; null unless it is an IP literal (in its canonical form) or a name with sound labels."""
    plain = F.trim(text)
    of_url = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)", 1)
    host = F.lower(F.regexp_replace(F.when(plain.contains("://"), of_url).otherwise(F.regexp_replace(plain, r"[:/?#].*$", "")), r"\.+$", ""))
    v6 = netfn.ipv6_canonical(F.when(plain.contains("://"), F.regexp_extract(of_url, r"^\[(.*)\]$", 1)).otherwise(F.regexp_replace(plain, r"\.+$", "")))
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    sound = netfn.is_ipv4(host) | (host.rlike(rf"^{label}(?:\.{label})+$") & ~host.rlike(r"\.[0-9]+$") & (F.length(host) <= 253))
    return F.coalesce(F.when(F.instr(plain, ":") > 0, v6), F.when(sound, host))


def file_url_path(url: Column) -> Column:
    """``file:///X:/a%20b`` as ``X:\\a b``; invalid escapes stay; null for other addresses."""
    rest = F.regexp_extract(url, r"(?i)^file:///([a-z]:/.*)$", 1)
    parts = F.split(rest, "%", -1)
    decoded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.encode(F.element_at(parts, 1), "UTF-8"), lambda acc, p: F.concat(acc, F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.unhex(F.substring(p, 1, 2)), F.encode(F.substr(p, F.lit(3)), "UTF-8"))).otherwise(F.encode(F.concat(F.lit("%"), p), "UTF-8"))))
    text = F.coalesce(F.try_validate_utf8(decoded.cast("string")), rest)
    return F.when(rest != "", F.translate(text, "/", "\\"))


def program_path(command: Column) -> Column:
    """The program of a command: quoted, or up to a known ending, from a drive's root; else null."""
    quoted = F.regexp_extract(F.trim(command), r'^"([^"]+)"', 1)
    bare = F.regexp_extract(F.trim(command), r"(?i)^([a-z]:\\.*?(?:\.exe|\.com|\.bat|\.cmd|\.dll|\.sys|\.ps1|\.vbs|\.js|\.scr|\.cpl|\.msc))(?:\s|$)", 1)
    path = F.when(quoted != "", quoted).otherwise(bare)
    return F.when(path.rlike(r"(?i)^[a-z]:\\."), path)


def split_command(command: Column) -> tuple[Column, Column, Column]:
    """Program, arguments, and whether an unquoted program holds spaces."""
    text = F.trim(command)
    quoted = text.startswith('"')
    inner = F.substr(text, F.lit(2))
    close = F.locate('"', inner)
    endings = "|".join(e.replace(".", r"\.") for e in PROGRAM_ENDINGS)
    word = r"(?![/\-\"])\S+"
    found = F.regexp_extract(text, rf"(?i)^(\S*?(?:{endings})(?=\s|$)|\S+(?:\s+{word})*?\s+(?![/\-\"])\S*(?:{endings})(?=\s|$))", 1)
    first = F.regexp_extract(text, r"^(\S*)", 1)
    bare = F.when(found != "", found).otherwise(first)
    program = F.when(quoted, F.when(close > 0, F.substr(inner, F.lit(1), close - 1)).otherwise(inner)).otherwise(bare)
    args = F.when(quoted, F.when(close > 0, F.substr(inner, close + 1)).otherwise(F.lit(""))).otherwise(F.substr(text, F.length(bare) + 1))
    return program, args, ~quoted & (F.length(bare) > F.length(first))


def _any(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests)


def rate_commands(df: DataFrame, command: str) -> DataFrame:
    """Adds ``path_status``, ``reason``, ``lolbin``, ``suspicious_args`` and ``unquoted_space`` of a command column.

    In steps, so that no step's expressions are repeated in the next and each stays small enough to compile.
    """
    program, args, unquoted = split_command(F.col(command))
    df = df.withColumns({"_program": program, "_args": ascii_lower(args), "unquoted_space": unquoted})
    raw = ascii_lower(F.translate(F.trim("_program"), "/", "\\"))
    df = df.withColumn("_path", F.regexp_replace(F.regexp_replace(raw, r"^\\\?\?\\", ""), r"^\\\\\?\\", ""))
    path = F.col("_path")
    df = df.withColumns({"_name": F.element_at(F.split(path, r"\\"), -1), "_closed": path.rlike("^%[^%]*%"), "_variable": F.regexp_extract(path, "^%([^%]*)%", 1), "_tail": F.regexp_replace(path, "^%[^%]*%", "")})
    closed, variable = F.col("_closed"), F.col("_variable")
    mapped = F.lit(None).cast("string")
    for names, base in VARIABLES:
        mapped = F.when(variable.isin(*names), F.concat(F.lit(base), F.col("_tail"))).otherwise(mapped)
    absolute = (
        F.when(path.startswith("%"), F.when(closed, mapped))
        .when(path.startswith("\\systemroot"), F.concat(F.lit("\\windows"), F.substr(path, F.lit(12))))
        .when(F.substring(path, 2, 1) == ":", F.substr(path, F.lit(3)))
        .when(path.startswith("\\"), path)
        .when(path.startswith("system32\\") | path.startswith("syswow64\\"), F.concat(F.lit("\\windows\\"), path))
    )
    df = df.withColumn("_absolute", absolute)
    absolute = F.col("_absolute")
    user = _any([absolute.startswith(p) for p in USER_PREFIXES] + [absolute.contains(p) for p in USER_PARTS])
    whole = F.when(absolute.startswith(DEFENDER), "gewoehnlich").when(user, "auffaellig:nutzerbeschreibbar").when(_any([absolute.startswith(p) for p in SYSTEM_PREFIXES]), "gewoehnlich").otherwise("auffaellig:ausserhalb_standardorte")
    verdict = (
        F.when(path.startswith("\\\\"), "auffaellig:unc_pfad")
        .when(F.array_contains(F.split(path, r"\\"), ".."), "auffaellig:pfad_traversal")
        .when(path.startswith("%") & ~closed, "unbestimmt:unvollstaendige_variable")
        .when(closed & (variable == "comspec"), "gewoehnlich")
        .when(closed & variable.isin(*USER_VARIABLES), "auffaellig:nutzerbeschreibbar")
        .when(closed & absolute.isNull(), "unbestimmt:unbekannte_variable")
        .when(absolute.isNull() & path.contains("\\"), "unbestimmt:relativer_pfad")
        .when(absolute.isNull(), "unbestimmt:ohne_verzeichnis")
        .otherwise(whole)
    )
    tool = F.when(closed & (variable == "comspec"), F.lit("cmd")).otherwise(F.regexp_replace("_name", r"\.exe$", ""))
    marker = F.lit(None).cast("string")
    for text, reason in reversed(ARGUMENT_MARKERS):
        marker = F.when(F.col("_args").contains(text), reason).otherwise(marker)
    df = df.withColumns({"_verdict": F.split(verdict, ":"), "lolbin": tool.isin(*SYSTEM_TOOLS), "suspicious_args": marker})
    return df.withColumns({"path_status": F.element_at("_verdict", 1), "reason": F.try_element_at("_verdict", F.lit(2))}).drop("_program", "_args", "_path", "_name", "_closed", "_variable", "_tail", "_absolute", "_verdict")


def present(c: Column) -> Column:
    """Text that says something: not empty, ``-`` or the null SID."""
    return F.when(~c.isin("", "-", "S-1-0-0"), c)
