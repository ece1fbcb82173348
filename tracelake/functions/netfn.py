"""Addresses as Column expressions: IPv4 and IPv6 literals, their canonical form, and where they stand in texts and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.binding import once

#: fixed values: token characters, the longest token, and the hits of one content
TOKEN, MOST_TOKEN, MOST_HITS = "A-Za-z0-9.:_%-", 128, 500

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: eight groups, or some around one double colon
_IPV6 = rf"^(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?)$"


def is_ipv4(text: Column) -> Column:
    """Four decimal numbers to 255 without leading zeros."""
    return text.rlike(f"^{_IPV4}$")


def _number(digits: Column, base: int) -> Column:
    return F.conv(digits, base, 10).cast("int")


def _hex_groups(text: Column) -> Column:
    """An IPv6 literal whose last 32 bits may be written as IPv4, in hexadecimal groups only."""
    octet = lambda k: _number(F.regexp_extract(text, r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", k), 10)
    pair = lambda k: F.lower(F.hex(octet(k) * 256 + octet(k + 1)))
    written = F.concat(F.regexp_extract(text, "^(.*:)", 1), pair(1), F.lit(":"), pair(3))
    return F.when(text.rlike(rf":{_IPV4}$"), written).when(~text.contains("."), text)


def _eight(groups: Column) -> Column:
    """All eight groups of a sound literal, lowered and without leading zeros, joined by colons."""
    part = lambda k: F.filter(F.split(F.get(F.split(groups, "::"), F.lit(k)), ":"), lambda g: g != "")
    left, right = part(0), F.coalesce(part(1), F.array().cast("array<string>"))
    every = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    return F.array_join(F.transform(every, lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")), ":")


def _shortened(eight: Column) -> Column:
    """The first of the longest runs of two or more zero groups becomes a double colon; an IPv4-mapped address ends in IPv4."""
    run = lambda n: f"^((?:[0-9a-f]+:)*?)(?:0:){{{n - 1}}}0(?::(.*)|$)$"
    cut = eight
    for n in range(2, 9):
        cut = F.when(eight.rlike(run(n)), F.regexp_replace(F.regexp_replace(eight, run(n), "$1:$2"), "^:(?!:)", "::")).otherwise(cut)
    group = lambda k: _number(F.element_at(F.split(eight, ":"), k), 16)
    dotted = F.concat_ws(".", *(x.cast("string") for k in (7, 8) for x in (F.floor(group(k) / 256), group(k) % 256)))
    return F.when(eight.rlike("^(?:0:){5}ffff:"), F.concat(F.lit("::ffff:"), dotted)).otherwise(cut)


def ipv6_canonical(text: Column) -> Column:
    """Lower case, no leading zeros, the longest run of zero groups shortened; null for other texts (with a zone, too)."""

    def sound(groups: Column) -> Column:
        # a double colon stands for at least one group
        few = (F.size(F.filter(F.split(groups, ":"), lambda g: g != "")) <= 7) | ~groups.contains("::")
        return F.when(groups.rlike(_IPV6) & few, once(_eight(groups), _shortened))

    return once(_hex_groups(text), sound)


def ip_canonical(text: Column) -> Column:
    """An IPv4 or IPv6 literal in its canonical form; null for other texts."""
    return F.when(is_ipv4(text), text).when(text.contains(":"), ipv6_canonical(text))


_HIT = "struct<found:bigint,address:string,original:string,kind:string,encoding:string,start:bigint,bytes:bigint>"


def _hits(content: Column, encoding: str, width: int) -> Column:
    """The addresses in one reading of a content: structs of when it is found, address, original, kind, encoding, start and bytes.

    One pass of the regular expression yields, from the last match on, the text before the next token that can be an
    address, and that token at its end; offsets are the running sum. Only sound addresses are kept, so that the fold carries
    no more than the most that are returned.
    """
    nul = "\\x00" if width == 2 else ""
    unit = lambda chars, n="": f"(?:[{chars}]{nul}){n}" if width == 2 else f"[{chars}]{n}"
    # what stands before a token's first unit, looked at only behind a first group or octet
    outside = f"(?:^|^.|[^{TOKEN}].|.[^\\x00])" if width == 2 else f"(?:^|[^{TOKEN}])"
    group, octet = f"{unit('0-9A-Fa-f', '{0,4}')}:{nul}", f"{unit('0-9', '{1,3}')}\\.{nul}"
    begins = "|".join(f"{x.replace('}', '}+', 1)}(?<={outside}{x})" for x in (group, octet))
    # a last byte without its pair leaves a UTF-16 token open, so that it is none
    end = f"(?!{unit(TOKEN)})" + ("(?!(?s:.)\\z)" if width == 2 else "")
    matches = F.regexp_extract_all(content, F.lit(f"(?s)\\G.*?(?:{begins}){unit('0-9A-Fa-f.:', '++')}{end}"), 0)
    # a longer token's first units don't matter: it is none
    at_end = f"({unit('0-9A-Fa-f.:', '+')})\\z"

    def parted(m: Column) -> Column:
        token = F.regexp_extract(F.right(m, F.lit(width * (MOST_TOKEN + 1))), at_end, 1)
        return once(token, lambda t: F.struct((F.length(m) - F.length(t)).alias("gap"), F.length(t).alias("size"), (F.replace(t, F.lit("\0"), F.lit("")) if width == 2 else t).alias("token")))

    parts = F.transform(matches, parted)

    def with_address(p: Column) -> Column:
        plain = F.regexp_replace(F.when(F.length(p["token"]) <= MOST_TOKEN, p["token"]), r"\.+$", "")
        port = lambda t: F.regexp_extract(t, f"^{_IPV4}:([0-9]{{1,5}})$", 1)
        original = once(plain, lambda t: F.when(t.rlike(f"^{_IPV4}:[0-9]{{1,5}}$") & (F.when(port(t) != "", port(t)).cast("int") <= 65535), F.substring_index(t, ":", 1)).otherwise(t))
        return once(original, lambda t: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), t.alias("original"), ip_canonical(t).alias("address")))

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        made = F.struct((start + p["size"] + width - 1).alias("found"), p["address"].alias("address"), p["original"].alias("original"), F.when(p["address"].contains(":"), "IPv6").otherwise("IPv4").alias("kind"), F.lit(encoding).alias("encoding"), start.alias("start"), (F.length(p["original"]) * width).cast("bigint").alias("bytes"))
        keep = p["address"].isNotNull() & (F.size(state["hits"]) <= MOST_HITS)
        return F.struct((start + p["size"]).alias("at"), F.when(keep, F.concat(state["hits"], F.array(made).cast(f"array<{_HIT}>"))).otherwise(state["hits"]).alias("hits"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_HIT}>").alias("hits"))
    return F.aggregate(F.transform(parts, with_address), first, add, lambda s: s["hits"])


def addresses(content: Column, binary: bool, most: int = MOST_HITS) -> Column:
    """The first ``most`` (up to 500) addresses of a text, or of bytes in ASCII and both phases of UTF-16LE, by start; with ``limited``, whether there were more.

    Hits come in the order in which a reader of single bytes would find them, which is where the limit cuts.
    """
    if not 0 < most <= MOST_HITS:
        raise ValueError(f"a limit is between 1 and {MOST_HITS}")
    dotted, paired = r"[0-9]\.[0-9]|:[0-9A-Fa-f]*:", r"[0-9]\x00\.\x00[0-9]|:\x00(?:[0-9A-Fa-f]\x00)*:"
    # most contents hold nothing of the form, which a plain search tells sooner
    reading = lambda text, form, *how: F.when(text.rlike(form), _hits(text, *how)).otherwise(F.array().cast(f"array<{_HIT}>"))
    if binary:
        found = once(F.decode(content, "ISO-8859-1"), lambda latin: F.array_sort(F.concat(reading(latin, dotted, "ascii", 1), reading(latin, paired, "utf16le", 2))))
    else:
        found = reading(content, dotted, "text", 1)
    fields = ("start", "encoding", "address", "original", "kind", "bytes")
    return once(found, lambda hits: F.array_sort(F.transform(F.slice(hits, 1, most), lambda h: F.struct(*(h[n].alias(n) for n in fields), (F.size(hits) > most).alias("limited")))))
