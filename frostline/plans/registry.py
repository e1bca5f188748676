"""Registry of the runnable queries and their SQL checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Tables, duckdb_tables

Build = Callable[[Tables], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The checks as written, without the derived tables, for queries that share one.
CHECKS: dict[str, str] = {}


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL check returns them."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def rounded(expr: str, digits: int) -> str:
    """DuckDB text for rounding the exact binary value, ties to even."""
    return f"(cast(format('{{:.{digits}f}}', {expr}) as double) + 0.0)"


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"(?<![\w.']){name}(?![\w'])", sql) is not None


def with_tables(sql: str) -> str:
    """Prefix the derived tables a check uses, each defined once, in dependency order."""
    tables = duckdb_tables()
    wanted: set[str] = {n for n in tables if _mentions(sql, n)}
    while True:
        more = {n for n in tables for w in wanted if _mentions(tables[w], n)} - wanted
        if not more:
            break
        wanted |= more
    if not wanted:
        return sql.strip()
    ctes = ",\n".join(f"{n} as (\n{tables[n]}\n)" for n in tables if n in wanted)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def query(name: str, check: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``; ``check`` is its DuckDB SQL."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain_times(build(Tables(spark, folder)))
        if check is not None:
            CHECKS[name] = check
            ORACLES[name] = with_tables(check)
        return build

    return register
