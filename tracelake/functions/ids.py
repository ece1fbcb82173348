"""Deterministic identities as Column expressions: UUIDs (version 5) over length-prefixed parts, and finding ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.binding import once

#: fixed value: the namespace of derived ids
NAMESPACE_HEX = "5f3c2a917d4e4b0a9c618e2d04b7a3f5"


def _bytes(part: Column | str) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return F.encode(part, "UTF-8")


def length_prefixed(part: Column) -> Column:
    """The part's bytes behind their number as 8 bytes, lowest first."""
    # the low four bytes say it all for parts under 2 GB
    digits = F.lpad(F.hex(F.octet_length(part)), 8, "0")
    turned = F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1)), F.lit("00000000"))
    return F.concat(F.unhex(turned), part)


def uuid_bytes(text: Column) -> Column:
    """A UUID's 16 bytes."""
    return F.unhex(F.regexp_replace(text, "-", ""))


def derived_uuid(kind: str, *parts: Column) -> Column:
    """UUID version 5 of kind and parts; strings count as UTF-8, binary parts as they are."""
    head = F.concat(F.unhex(F.lit(NAMESPACE_HEX)), length_prefixed(_bytes(kind)))

    def written(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

    # each part and the hash are used several times
    return once(F.sha1(F.concat(head, *(once(p, length_prefixed) for p in parts))), written)


def text_part(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def finding_id(domain: Column, name: Column, source: Column, offset: Column, attributes: Column) -> Column:
    """First 16 hex digits of SHA-256 over the length-prefixed fields; the offset is 8 bytes, lowest first, or none; attributes by key."""
    wide = F.lpad(F.hex(offset), 16, "0")
    little = F.concat(*(F.substring(wide, k, 2) for k in range(15, 0, -2)))
    where = F.coalesce(F.unhex(little), F.lit(b""))
    pairs = F.array_sort(F.map_entries(attributes))
    flat = F.aggregate(pairs, F.lit(b""), lambda acc, e: F.concat(acc, length_prefixed(F.encode(e["key"], "UTF-8")), length_prefixed(F.encode(e["value"], "UTF-8"))))
    fixed = F.concat(*(length_prefixed(F.encode(c, "UTF-8")) for c in (domain, name, source)), length_prefixed(where))
    return F.substring(F.sha2(F.concat(fixed, F.coalesce(flat, F.lit(b""))), 256), 1, 16)
