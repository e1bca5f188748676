"""Training input from CSV and training reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import number, text_or, truth
from ..operators.features import CATEGORIES, NUMERICS, UNKNOWN

REQUIRED = ("asset_id", "timestamp", "risk_proxy")
NESTED = "cumulative_exposure."


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Readings from CSV: required columns checked, missing optional ones filled, bad timestamps dropped.

    Values are read as text and converted by the same rules as messages;
    exposure columns may be plain or prefixed with ``cumulative_exposure.``.
    """
    raw = spark.read.option("header", "true").csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"CSV is missing required columns: {missing}")

    def source(name: str):
        for spelling in (name, NESTED + name):
            if spelling in raw.columns:
                return F.col(f"`{spelling}`")
        return F.lit(None).cast("string")

    flags = ("door_open", "refrigeration_failed")
    others = [c for c in raw.columns if c not in (*REQUIRED, *CATEGORIES, *NUMERICS) and not c.startswith(NESTED)]
    return raw.select(
        "asset_id",
        F.try_to_timestamp(F.col("timestamp")).alias("ts"),
        *[text_or(source(c), UNKNOWN).alias(c) for c in CATEGORIES],
        *[(truth(source(c)).cast("int") if c in flags else number(source(c))).alias(c) for c in NUMERICS],
        number(F.col("risk_proxy")).alias("risk_proxy"),
        *others,
    ).filter(F.col("ts").isNotNull())


def by_asset_and_time(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows sorted by asset and time; range partitions split a large asset by time."""
    if partitions:
        return df.repartitionByRange(partitions, "asset_id", "ts").sortWithinPartitions("asset_id", "ts")
    return df.repartitionByRange("asset_id", "ts").sortWithinPartitions("asset_id", "ts")


def write_training_csv(df: DataFrame, path: str) -> None:
    out = df.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).drop("ts")
    out.write.option("header", "true").csv(path)


def write_history(spark: SparkSession, history: list[dict], path: str) -> None:
    """One row per training round, as CSV with a header."""
    schema = "epoch int, train_loss double, val_loss double, val_rmse double, lr double"
    rows = [tuple(h[c.split()[0]] for c in schema.split(", ")) for h in history]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    """Model metadata as one JSON document."""
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
