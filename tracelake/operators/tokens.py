"""Page tokens: the key of a page's last row as text, read back strictly.

A token is made by a Column expression from the row itself, and read on the driver before the next page is
planned; whatever is no token of its form is an input error, never an empty page.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ROWS, MOST_ROWS, MOST_FILTER_BYTES = 500, 1000, 1024  # fixed values


class TokenError(ValueError):
    """A page token that is none."""


def page_rows(asked: int | None) -> int:
    """The rows of a page: ``DEFAULT_ROWS`` unless asked for others, from 1 to ``MOST_ROWS``."""
    return max(1, min(MOST_ROWS, DEFAULT_ROWS if asked is None else asked))


def checked_filters(*texts: str | None) -> None:
    if any(t is not None and len(t.encode()) > MOST_FILTER_BYTES for t in texts):
        raise ValueError(f"filter over {MOST_FILTER_BYTES} bytes")


def moment_token(time: Column, row_id: Column) -> Column:
    """``time|id`` with the time to the microsecond in UTC."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("|"), row_id.cast("string"))


def read_moment(token: str, number: bool = False) -> tuple[datetime.datetime, str | int]:
    """Time (UTC, without zone) and id: a UUID, or an integer where ``number`` says so."""
    text, bar, row_id = token.partition("|")
    try:
        if not bar or len(text) < 20 or text[10] not in "Tt":
            raise ValueError
        time = datetime.datetime.fromisoformat(text)
        if time.tzinfo is None:
            raise ValueError
        return time.astimezone(datetime.UTC).replace(tzinfo=None), _integer(row_id) if number else str(uuid.UUID(row_id))
    except ValueError:
        raise TokenError("no page token") from None


def _integer(text: str) -> int:
    if not text.removeprefix("-").isascii() or not text.removeprefix("-").isdigit():
        raise ValueError
    return int(text)


def name_token(name: Column, row_id: Column) -> Column:
    """``name|id``; the name may hold bars."""
    return F.concat(name, F.lit("|"), row_id.cast("string"))


def read_name(token: str, number: bool = False) -> tuple[str, str | int]:
    name, bar, row_id = token.rpartition("|")
    try:
        if not bar:
            raise ValueError
        return name, _integer(row_id) if number else str(uuid.UUID(row_id))
    except ValueError:
        raise TokenError("no page token") from None


def entry_token(is_directory: Column, record: Column, name: Column) -> Column:
    """``d|record|name``: d is 0 for directories, which come first, and 1 for files."""
    return F.concat_ws("|", F.when(is_directory, "0").otherwise("1"), record.cast("string"), name)


def read_entry(token: str) -> tuple[bool, int, str]:
    """Whether it is a file, the record, and the name, which may hold bars."""
    parts = token.split("|", 2)
    try:
        if len(parts) != 3 or parts[0] not in ("0", "1"):
            raise ValueError
        return parts[0] == "1", _integer(parts[1]), parts[2]
    except ValueError:
        raise TokenError("no page token") from None


def record_token(record: Column, parent: Column, name: Column) -> Column:
    """``[record,parent,"name"]`` as JSON."""
    quoted = F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r'(?s)^\{"n":(.*)\}$', 1)
    return F.concat(F.lit("["), record.cast("string"), F.lit(","), parent.cast("string"), F.lit(","), quoted, F.lit("]"))


def read_record(token: str) -> tuple[int, int, str]:
    try:
        record, parent, name = json.loads(token)
        if type(record) is not int or type(parent) is not int or not isinstance(name, str):
            raise ValueError
        return record, parent, name
    except (ValueError, TypeError):
        raise TokenError("no page token") from None
