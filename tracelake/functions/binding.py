"""A value that is evaluated once, however often an expression names it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value, as the lambda of an array of one: the value's expression stands in the plan once, so that neither work nor generated code is repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
