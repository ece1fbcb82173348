"""Predicates and pages: optional filters, half-open ranges, literal search, keyset pagination."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 1000


def where_given(df: DataFrame, **tests: Column | None) -> DataFrame:
    """Only the tests that are set; an unset one leaves nothing in the plan."""
    for test in tests.values():
        if test is not None:
            df = df.where(test)
    return df


def in_range(column: Column, since: object = None, until: object = None) -> Column | None:
    """``since <= column < until``, either end open if None; pushed down to the scan."""
    tests = [t for t in (None if since is None else column >= F.lit(since), None if until is None else column < F.lit(until)) if t is not None]
    return functools.reduce(operator.and_, tests) if tests else None


def one_of(column: Column, values: Sequence) -> Column | None:
    """An empty list means all."""
    return column.isin(*values) if values else None


def contains_literal(column: Column, text: str, most_bytes: int = 512) -> Column | None:
    """Case does not count; no character is a wildcard. An overlong text is an input error."""
    if len(text.encode()) > most_bytes:
        raise ValueError(f"search text over {most_bytes} bytes")
    return F.contains(F.lower(column), F.lower(F.lit(text))) if text else None


def after_key(columns: Sequence[str], key: Sequence | None, descending: bool = False) -> Column | None:
    """Rows behind a key in the order of the columns; the first column is also tested alone, which the reader can push down."""
    if key is None:
        return None
    left, right = F.struct(*columns), F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, key, strict=True)))
    first = F.col(columns[0])
    return (first <= F.lit(key[0])) & (left < right) if descending else (first >= F.lit(key[0])) & (left > right)


def page(df: DataFrame, columns: Sequence[str], key: Sequence | None = None, rows: int = 100, descending: bool = False) -> DataFrame:
    """Up to ``rows`` rows behind the key; ``more`` tells whether there are others. Rows are held to 1 to 1000."""
    rows = max(1, min(MOST_ROWS, rows))
    rest = where_given(df, key=after_key(columns, key, descending))
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in columns]
    # one row more than asked for tells whether the page is the last; the window runs over these alone
    taken = rest.orderBy(*order).limit(rows + 1)
    number = F.row_number().over(Window.orderBy(*order))
    return taken.withColumns({"_n": number, "more": F.count(F.lit(1)).over(Window.partitionBy()) > rows}).where(F.col("_n") <= rows).drop("_n")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def last_page_wins(df: DataFrame, key: str, page_number: str, values: Sequence[str]) -> DataFrame:
    """Of rows in several pages the last page's values stay, at the place of the first."""
    return df.groupBy(key).agg(*(F.max_by(v, page_number).alias(v) for v in values), F.min(page_number).alias("first_page"))
