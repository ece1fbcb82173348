"""Times of evidence formats as Column expressions; 100 ns ticks stay exact as BIGINT or DECIMAL(20,0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: ticks between 1601 and 1970, ticks a day
EPOCH_TICKS = 116444736000000000
DAY_TICKS = 864000000000


def unsigned(ticks: Column) -> Column:
    """A BIGINT that stands for an unsigned 64-bit number, as DECIMAL(20,0)."""
    wide = ticks.cast("decimal(20,0)")
    return F.when(ticks < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def filetime_iso(ticks: Column, zero_is_null: bool = True) -> Column:
    """ISO text with 7 digits of fraction; 0 is unset unless told otherwise."""
    wide = unsigned(ticks)
    days = F.floor(wide / DAY_TICKS).cast("int")
    rest = (wide - days.cast("decimal(20,0)") * DAY_TICKS).cast("bigint")
    day = F.date_add(F.lit("1601-01-01").cast("date"), days)
    seconds = F.floor(rest / 10000000).cast("bigint")
    clock = F.format_string("%02d:%02d:%02d.%07d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)), F.pmod(rest, F.lit(10000000)))
    text = F.concat(F.regexp_replace(day.cast("string"), r"^\+", ""), F.lit("T"), clock, F.lit("Z"))
    return F.when(ticks != 0, text) if zero_is_null else text


def iso_filetime(text: Column) -> Column:
    """Ticks of strict ISO text ``YYYY-MM-DDThh:mm:ss[.f{1,7}]Z``; null for anything else."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,7}))?Z$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)))
    h, m, s = (part(k).try_cast("bigint") for k in (4, 5, 6))
    fraction = F.rpad(F.coalesce(part(7), F.lit("")), 7, "0").try_cast("bigint")
    ticks = (F.unix_date(day).cast("bigint") + 134774) * DAY_TICKS + ((h * 60 + m) * 60 + s) * 10000000 + fraction
    return F.when(text.rlike(pattern) & day.isNotNull() & (F.year(day) >= 1601) & (h < 24) & (m < 60) & (s < 60), ticks)


def filetime_timestamp(ticks: Column) -> Column:
    """TIMESTAMP at microseconds, rounded down."""
    return F.timestamp_micros(F.floor((unsigned(ticks) - EPOCH_TICKS) / 10).cast("bigint"))


def ole_millis(days: Column) -> Column:
    """Unix milliseconds of an OLE date; null outside 1 to 200000 days."""
    ok = days.isNotNull() & ~F.isnan(days) & (days >= 1) & (days < 200000)
    return F.when(ok, F.round((days - 25569) * 86400000).cast("bigint"))


def whole_seconds(micros: Column) -> Column:
    """Seconds of microseconds, rounded down; exact beyond 2^53, too, where a division of doubles can round up."""
    return F.floor(micros.cast("decimal(20,0)") / 1000000).cast("bigint")


def chromium_unix(micros: Column) -> Column:
    """Unix seconds of microseconds since 1601; null for unset and for times before 1970."""
    seconds = whole_seconds(micros) - 11644473600
    return F.when((micros > 0) & (seconds >= 0), seconds)


def firefox_unix(micros: Column) -> Column:
    return F.when(micros > 0, whole_seconds(micros))


def preferred_ticks(attributes: Column, stem: str) -> Column:
    """Ticks of the attribute ``stem_filetime``, if it is set, else of ``stem_unix``."""
    ticks = F.try_element_at(attributes, F.lit(f"{stem}_filetime")).try_cast("bigint")
    unix = F.try_element_at(attributes, F.lit(f"{stem}_unix")).try_cast("bigint")
    return F.coalesce(F.nullif(ticks, F.lit(0)), unix * 10000000 + EPOCH_TICKS)


def preferred_time(attributes: Column, stem: str) -> Column:
    """The attribute ``stem_filetime`` as ISO text, else ``stem_unix`` as ISO text."""
    return filetime_iso(preferred_ticks(attributes, stem))


def filetime_seconds(ticks: Column) -> Column:
    """Unix seconds of ticks, rounded down; null before 1970, where a FILETIME is unset or no time."""
    wide = ticks.cast("decimal(20,0)")
    return F.when(wide >= EPOCH_TICKS, F.floor((wide - EPOCH_TICKS) / 10000000).cast("bigint"))
