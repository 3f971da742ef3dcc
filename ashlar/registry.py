"""Registry of queries: name, Spark builder, DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Shared derived tables of the SQL twins, by name; a twin that names one gets it as a CTE.
VIEWS: dict[str, str] = {}


def oracle_view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _with_views(sql: str) -> str:
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    if sql.lstrip()[:5].upper() == "WITH ":
        return f"WITH {ctes}, {sql.lstrip()[5:]}"
    return f"WITH {ctes} {sql}"


def query(name: str, oracle: str | None = None):
    """Registers ``f(spark, sf_dir)`` under ``name``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = _with_views(oracle)
        return f

    return add
