"""Numbers, identifiers and texts inside binary values, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unsigned(data: Column, at: int | Column, size: int) -> Column:
    """The little-endian unsigned number of ``size`` (at most 8) bytes at an offset, as DECIMAL(20,0); null if the bytes end before."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(data)
    turned = F.concat(*(F.substr(digits, (at + k) * 2 + 1, F.lit(2)) for k in reversed(range(size))))
    return F.when(F.octet_length(data) >= at + size, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def sid_text(data: Column) -> Column:
    """``S-1-…`` of a binary SID; null for bytes that are none."""
    digits = F.hex(data)
    count = F.conv(F.substring(digits, 3, 2), 16, 10).cast("int")
    authority = F.conv(F.substring(digits, 5, 12), 16, 10)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: unsigned(data, i * 4 + 8, 4).cast("string"))
    sound = (F.octet_length(data) >= 8) & (F.substring(digits, 1, 2) == "01") & (count <= 15) & (F.octet_length(data) == count * 4 + 8)
    return F.when(sound, F.concat_ws("-", F.lit("S"), F.lit("1"), authority, F.when(count > 0, F.array_join(parts, "-"))))


@F.pandas_udf(T.StringType())
def utf16_units(data: pd.Series) -> pd.Series:
    """All UTF-16LE units but zeros, broken ones replaced; an odd last byte does not count."""
    return data.map(lambda d: None if d is None else bytes(d[: len(d) // 2 * 2]).decode("utf-16-le", "replace").replace("\0", ""))


@F.pandas_udf(T.StringType())
def utf16_prefix(data: pd.Series) -> pd.Series:
    """UTF-16LE text up to the first zero unit, broken units replaced."""
    return data.map(lambda d: None if d is None else bytes(d[: len(d) // 2 * 2]).decode("utf-16-le", "replace").partition("\0")[0])


@F.pandas_udf(T.StringType())
def utf16_text(data: pd.Series) -> pd.Series:
    """Sound UTF-16LE text without zeros at its end; null for an odd length or broken units."""

    def text(d: bytes | None) -> str | None:
        try:
            return None if d is None or len(d) % 2 else bytes(d).decode("utf-16-le").rstrip("\0")
        except UnicodeDecodeError:
            return None

    return data.map(text)


def identifier_text(data: Column) -> Column:
    """What an identifier's bytes say: a SID, else UTF-16LE text, else lower-case hex digits."""
    return F.coalesce(sid_text(data), utf16_text(data), F.lower(F.hex(data)))
