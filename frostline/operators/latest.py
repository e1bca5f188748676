"""Latest row per key, counts, filters and bounded lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key that holds much of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert view of a change list: the last version of each key."""
    return latest_by(df, keys, order)


def recent(df: DataFrame, order: Sequence[Column], n: int = 100) -> DataFrame:
    """The newest ``n`` rows over all keys; each task sends only its own ``n``."""
    return df.orderBy(*order).limit(n)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
               for name, df in tables.items()]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


def sample(df: DataFrame, n: int = 3) -> DataFrame:
    """A few rows to look at; stops as soon as it has them."""
    return df.limit(n)


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring match on any of the columns; blank text keeps all rows."""
    if not text.strip():
        return df
    wanted = F.lit(text.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c)).contains(wanted)
    return df.filter(hit)


def lookup(df: DataFrame, asset_id: str, ts=None) -> DataFrame:
    """Rows of one asset, or of one exact reading; the filter reaches the file scan."""
    found = df.filter(F.col("asset_id") == asset_id)
    return found if ts is None else found.filter(F.col("ts") == F.lit(ts).cast("timestamp"))


def at_reading(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both frames for the same asset and timestamp."""
    return left.join(right, ["asset_id", "ts"])


def changed(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Drop rows whose value equals the value of the row before it for the same key."""
    seen = running(df, key, order, {}, {"_previous": value})
    return seen.filter(F.col("_previous").isNull() | (F.col(value) != F.col("_previous"))).select(*df.columns)
