"""Registry of runnable queries and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.views import Inputs, duck_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def expand(sql: str) -> str:
    """Replace ``@U`` style marks by the view's sub-query."""
    return re.sub(r"@([A-Z])\b", lambda m: duck_view(m.group(1)), sql)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``, with its SQL twin if it has one."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = expand(sql).strip()
        return fn

    return wrap
