"""Query name -> the equivalent DuckDB SQL, with all queries registered."""

from . import analysis, casebase, catalog, evidence, governance, imports, keyword, mapped, mapping, review, running, search, streams, timeline, values  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
