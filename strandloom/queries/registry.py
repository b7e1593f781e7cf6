"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.queries.derived import SHARED, needed, with_clause
from strandloom.session import scratch  # noqa: F401  for the query modules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHECKS: dict[str, str] = {}  # helper views that only the checking SQL uses


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` is its checking SQL over shared and helper views."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            own = re.match(r"\s*WITH (?:RECURSIVE )?", sql)
            text = with_clause(sql, {**SHARED, **CHECKS}, recursive)
            if own:  # the SQL brings its own views: one WITH list for all
                lead = with_clause("", {}, recursive)
                names = needed(sql, {**SHARED, **CHECKS})
                library = {**SHARED, **CHECKS}
                views = "".join(f"{n} AS ({library[n]}),\n" for n in names)
                text = lead + ("WITH RECURSIVE " if recursive else "WITH ") + views + sql[own.end():]
            ORACLES[name] = re.sub(r"@(\w+)@", r"\1", text)
        return fn

    return register

