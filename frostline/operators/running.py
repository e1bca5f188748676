"""Running totals and positions per key that survive very large keys.

A window over ``asset_id`` alone puts all rows of one asset in one task. Here
rows are dealt by sampled ranges of key and order, so a key with very many rows, or very many of
one day, is spread over several tasks. One aggregate gives the totals of every key and range
(pre-aggregated before its shuffle), a window over those few totals gives what
each range starts from, and the row-level window runs inside a key's range only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise, partitions

# Bits of the place of a row in its task, in what ``monotonically_increasing_id`` gives.
PLACE_BITS = 33
# Numbers of a stretch.
STRETCH = 16_384


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows with ``_chunk``, the number of their sampled range; written once, so that a row keeps its range.

    Ranges follow the order, equal rows share one, and nulls come first.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_chunk", F.spark_partition_id())
    return materialise(dealt, "ranged")


def running(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    sums: Mapping[str, Column],
    previous: Mapping[str, str] | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Add running sums (current row included) and values of the row before.

    ``sums`` should be integers, so the totals do not depend on how rows were
    grouped. ``previous`` maps a new column to the column it looks back at.
    Rows without a key have no place in any sequence and are left out; rows
    without a time come first. ``chunk`` gives ranges of your own, in order.
    """
    previous = dict(previous or {})
    known = df.filter(F.col(key).isNotNull())
    marked = ranged(known, key, *order) if chunk is None else known.withColumn("_chunk", chunk)
    last = F.struct(*order)
    totals = marked.groupBy(key, "_chunk").agg(
        *[F.sum(expr).alias(f"_total_{name}") for name, expr in sums.items()],
        *[F.max_by(F.struct(col), last).alias(f"_last_{name}") for name, col in previous.items()],
    )
    over_chunks = W.partitionBy(key).orderBy("_chunk")
    earlier = over_chunks.rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        key,
        "_chunk",
        *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums],
        *[F.lag(f"_last_{n}").over(over_chunks).alias(f"_before_{n}") for n in previous],
    )
    in_chunk = W.partitionBy(key, "_chunk").orderBy(*order)
    so_far = in_chunk.rowsBetween(W.unboundedPreceding, 0)
    out = marked.join(starts, [key, "_chunk"]).withColumns(
        {
            **{n: F.sum(expr).over(so_far) + F.col(f"_start_{n}") for n, expr in sums.items()},
            **{n: F.coalesce(F.lag(F.struct(col)).over(in_chunk), F.col(f"_before_{n}"))[col] for n, col in previous.items()},
        }
    )
    return out.select(*df.columns, *sums, *previous)


def numbered_rows(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Number all rows from 1 in order, whatever their key, without sorting them in one task.

    Each sampled range is sorted in its task and written with its places, which ``monotonically_increasing_id`` counts below
    bit 33, so the rows move once; the ranges' sizes, as many numbers as the session has partitions, are summed up by the driver.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    chunk = F.shiftright("_at", PLACE_BITS).cast("int")
    sizes = {r["_chunk"]: r["n"] for r in rows.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("n")).collect()}
    return rows.withColumn(name, F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + 1 + _starts(sizes, chunk)).select(*df.columns, name)


def numbered_within(df: DataFrame, number: str, places: Sequence[str], name: str = "number") -> DataFrame:
    """Number all rows from 1 by a whole ``number`` from 1 that they have already, then by ``places``.

    For rows made of numbered ones, of some none and of some several. Stretches of ``STRETCH`` numbers are the ranges, so nothing is sampled or
    written; rows move once, and only where the new number is read.
    """
    chunk = F.floor((F.col(number) - 1) / STRETCH).cast("int")
    sizes = {r["_chunk"]: r["n"] for r in df.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("n")).collect()}
    inside = F.row_number().over(W.partitionBy("_chunk").orderBy(number, *places))
    return df.withColumn("_chunk", chunk).withColumn(name, inside + _starts(sizes, F.col("_chunk"))).drop("_chunk")


def _starts(sizes: Mapping[int, int], chunk: Column) -> Column:
    """Rows before the chunk of a row."""
    before, starts = 0, []
    for i in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes.get(i, 0)
    return F.element_at(F.expr(f"array({', '.join(f'{n}L' for n in starts)})"), chunk + 1)


def positions(df: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows of each key from 1 in order."""
    return running(df, key, order, {name: F.lit(1)})
