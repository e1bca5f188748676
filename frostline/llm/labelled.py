"""Labelled rows for fitting: folds by identifier, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the identifier as text; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def training_sample(labels: DataFrame, label: str, key: str, folds: int, held: int, most: int) -> DataFrame:
    """(key, label) of at most ``most`` labelled rows outside the held-out fold, an even sample by hash.

    Null labels and keys are left out; of differing labels of one key the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key, folds) != held))
    one = known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64(key, F.lit(label)), key).limit(most)


def sampled_texts(documents: DataFrame, sample: DataFrame, text: str, key: str) -> DataFrame:
    """(text, _label) of the sampled documents; the sample's bound lets it be sent to every task."""
    return documents.select(key, text).join(F.broadcast(sample), key).select(F.col(text).alias("_text"), "_label")
