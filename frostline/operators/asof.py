"""As-of matching with age limits, spread by key and time bucket.

A match never looks back further than ``max_age`` nor waits longer than
``wait``. With buckets at least that wide, all a bucket needs from its
neighbours is their last (or first) row. All sides go as one tagged flow through one exchange by key and bucket; the last and first rows
of the buckets come from an aggregate over what that exchange has already brought together, are sent one bucket on, and are joined back
without moving the flow again. One key spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RIGHT, LEFT = 0, 1
# Rows of one key that one task takes without cutting them by time.
WHOLE = 100_000


def tagged(df: DataFrame, kind: int, key: str, ts: str = "ts", order: str | None = None) -> DataFrame:
    """Rows of one side of a flow: key, time, tie order, kind and the whole row under the kind's name; rows without key or time are left out."""
    return df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(order or ts).alias("_order"), F.lit(kind).alias("_kind"), F.struct(*df.columns).alias(f"row{kind}")
    )


def flow_of(*sides: DataFrame) -> DataFrame:
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side, allowMissingColumns=True)
    return out


def _age(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000


def with_neighbours(flow: DataFrame, width_s: int, back: Sequence[int] = (), following: bool = False, once: int | None = None, cut: DataFrame | None = None) -> DataFrame:
    """The flow with ``back{kind}``, the newest row of each kind at or before a row, and ``next``, the row after it.

    Rows are in order of time, kind and tie order. Neighbours further away than ``width_s`` seconds may be missing. Of rows of the
    kind ``once`` with one key and time the first alone counts. Both are structs with ``at``, the row's time; ``next`` has its kind too.
    ``cut`` has the keys (``_key``) that are cut into buckets, see ``large_keys``; without it all are.
    """
    bucket = F.floor(F.unix_micros("_ts") / (width_s * 1_000_000))
    if cut is not None:
        # A key that stays whole has no bucket, so it meets no edges.
        flow = flow.join(F.broadcast(cut.select("_key", F.lit(True).alias("_cut"))), "_key", "left")
        bucket = F.when(F.col("_cut"), bucket)
    dealt = flow.withColumn("_bucket", bucket).drop("_cut").repartition("_key", "_bucket")
    rows = sorted(c for c in flow.columns if c.startswith("row"))
    whole = F.struct(F.col("_ts").alias("at"), F.col("_kind").alias("kind"), *rows)
    place = F.struct("_ts", "_kind", "_order")
    edges = [F.max_by(F.when(F.col("_kind") == k, F.struct(F.col("_ts").alias("at"), f"row{k}")), F.when(F.col("_kind") == k, place)).alias(f"_last{k}") for k in back]
    if following:
        edges.append(F.min_by(whole, place).alias("_first"))
    if edges:
        found = dealt.filter(F.col("_bucket").isNotNull()).groupBy("_key", "_bucket").agg(*edges)
        sent = [F.struct((F.col("_bucket") + 1).alias("_bucket"), *[f"_last{k}" for k in back], *([F.lit(None).cast(found.schema["_first"].dataType).alias("_first")] if following else []))]
        if following:
            sent.append(F.struct((F.col("_bucket") - 1).alias("_bucket"), *[F.lit(None).cast(found.schema[f"_last{k}"].dataType).alias(f"_last{k}") for k in back], "_first"))
        moved = found.select("_key", F.explode(F.array(*sent)).alias("s")).select("_key", "s.*")
        names = [*[f"_last{k}" for k in back], *(["_first"] if following else [])]
        dealt = dealt.join(moved.groupBy("_key", "_bucket").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names]), ["_key", "_bucket"], "left")
    ordered = W.partitionBy("_key", "_bucket").orderBy("_ts", "_kind", "_order")
    if once is not None:
        before = F.lag(F.struct("_kind", "_ts")).over(ordered)
        dealt = dealt.withColumn("_before", before).filter(~F.coalesce((F.col("_kind") == once) & (F.col("_before._kind") == once) & (F.col("_before._ts") == F.col("_ts")), F.lit(False)))
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    new = {
        f"back{k}": F.coalesce(F.last(F.when(F.col("_kind") == k, F.struct(F.col("_ts").alias("at"), f"row{k}")), ignorenulls=True).over(so_far), F.col(f"_last{k}"))
        for k in back
    }
    if following:
        new["next"] = F.coalesce(F.lead(whole).over(ordered), F.col("_first"))
    return dealt.withColumns(new)


def large_keys(key: str, *sides: DataFrame) -> DataFrame:
    """Keys (``_key``) with more than ``WHOLE`` rows in all sides: fewer than there are times ``WHOLE`` rows, so they can be broadcast."""
    keys = [side.select(F.col(key).alias("_key")) for side in sides]
    rows = keys[0]
    for more in keys[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE).select("_key")


def met(max_age_s: int, wait_s: int | None, right: int = RIGHT) -> tuple[Column, Column]:
    """(matched, waited): the row of kind ``right`` that a row of a flow with neighbours meets, and whether it waited for it."""
    back, after = F.col(f"back{right}"), F.col("next") if wait_s is not None else None
    fresh = F.coalesce(_age(F.col("_ts"), back["at"]) <= max_age_s, F.lit(False))
    matched = F.when(fresh, back[f"row{right}"])
    if after is None:
        return matched, F.lit(False)
    late = F.coalesce(~fresh & (after["kind"] == right) & (_age(after["at"], F.col("_ts")) <= wait_s), F.lit(False))
    return matched.when(late, after[f"row{right}"]), late


def match_latest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str = "ts",
    right_ts: str = "ts",
    left_order: str | None = None,
    right_order: str | None = None,
    max_age_s: int = 1800,
    wait_s: int | None = None,
    once: bool = False,
) -> DataFrame:
    """Each left row with the right row it would meet: columns ``left``, ``right``, ``waited``.

    The newest right row at or before the left row wins if it is at most
    ``max_age_s`` old. Otherwise, with ``wait_s``, the left row waits: the next
    row of its key must be a right row within ``wait_s`` seconds, a newer left
    row replaces it. ``right`` is null where nothing fits. With ``once``, of left rows with one key and time the first alone counts.
    """
    flow = flow_of(tagged(left, LEFT, key, left_ts, left_order), tagged(right, RIGHT, key, right_ts, right_order))
    rows = with_neighbours(flow, max(max_age_s, wait_s or 0, 1), [RIGHT], wait_s is not None, LEFT if once else None, large_keys(key, left, right))
    matched, waited = met(max_age_s, wait_s)
    return rows.filter(F.col("_kind") == LEFT).select(F.col(f"row{LEFT}").alias("left"), matched.alias("right"), waited.alias("waited"))


def distinct_readings(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key for messages that arrive twice, the first kept.

    ``min_by`` keeps one candidate per key in each task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)
