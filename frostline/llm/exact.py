"""Exact duplicates: a content sort that brings equal texts together.

Method: normalised texts are range-partitioned by sampled splitters (their first bytes, then their
digest) and sorted externally (Spark's range exchange and sort); equal texts are then neighbours,
and a window compares neighbours in full and keeps the smallest identifier.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.session import materialise, partitions

#: Characters of a text in a splitter.
HEAD = 32
#: Parts a frequent text's rows are dealt to.
SALTS = 64


def normalised(text: Column) -> Column:
    """Runs of the six ASCII white space characters become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def frequent(keys: DataFrame, parts: int) -> DataFrame:
    """Digests of texts that hold more than 1 / (4 parts) of all rows: fewer than 4 parts of them."""
    counts = keys.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    least = max(1, keys.count() // (4 * parts))
    return counts.where(F.col("_n") > least).select("_digest", F.lit(True).alias("_frequent"))


def exact_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Class of equal normalised texts for every row.

    Returns the key, keep_id (smallest key with that text), group_size, kept (one row of the
    class) and text_sha256 of the normalised text, a row for each input row.

    Null, empty and missing text is the empty text. Of rows with the same key and text, one is
    kept. Null keys are a class's keep_id only where it has no other key. Other columns are ignored;
    an empty table gives an empty result.

    A text that holds many rows is dealt to parts first: each part is sorted and reduced by itself, and
    only the parts' first rows meet.
    """
    parts = parts or partitions(documents.sparkSession)
    rows = documents.select(F.col(key).alias("_key"), normalised(F.col(text)).alias("_text"))
    # Splitters are sampled to the driver: the text's start and its digest stand for it there, and equal texts have equal ones.
    rows = rows.withColumns({"_digest": F.sha2("_text", 256), "_head": F.substring("_text", 1, HEAD)})
    digests = materialise(rows.select("_digest"), "digests")
    dealt = rows.join(F.broadcast(frequent(digests, parts)), "_digest", "left").withColumn(
        "_part", F.when(F.col("_frequent"), F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).otherwise(-1)
    )
    same = Window.partitionBy("_head", "_digest", "_text", "_part")
    first = same.orderBy(F.col("_key").asc_nulls_last())
    sorted_ = (
        dealt.repartitionByRange(parts, "_head", "_digest", "_part")
        .select(
            "_key", "_digest", "_part", "_text",
            F.row_number().over(first).alias("_place"),
            F.first("_key").over(first).alias("_first"),
            F.count(F.lit(1)).over(same).alias("_size"),
        )
        # A frequent text stays with the first row of its part, to be compared with the others' in full.
        .withColumn("_text", F.when((F.col("_part") >= 0) & (F.col("_place") == 1), F.col("_text")))
    )
    sorted_ = materialise(sorted_, "sorted")
    heads = sorted_.where("_text is not null")
    classes = (
        heads.groupBy("_text").agg(F.min("_first").alias("_keep"), F.sum("_size").alias("_total"), F.collect_list(F.struct("_digest", "_part")).alias("_parts"))
        .select("_keep", "_total", F.explode("_parts").alias("_p"))
        .select("_keep", "_total", "_p._digest", "_p._part")
    )
    found = sorted_.join(F.broadcast(classes), ["_digest", "_part"], "left")
    keep = F.when(F.col("_part") < 0, F.col("_first")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_key").alias(key),
        keep.alias("keep_id"),
        F.coalesce("_total", "_size").cast("long").alias("group_size"),
        ((F.col("_place") == 1) & F.col("_key").eqNullSafe(keep)).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def without_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents whose text is the first of its class; all columns.

    Rows that repeat a kept row's key and text stay once; rows with a null key stay if their text
    has no row with a key.
    """
    # Null is a key like others; the digest alone may be a very frequent one.
    keyed = F.struct(F.col(key).isNull(), F.coalesce(F.col(key), F.lit(0)))
    kept = exact_duplicates(documents, text, key).where("kept").select(keyed.alias("_k"), F.col("text_sha256").alias("_sha"))
    marked = documents.withColumns({"_k": keyed, "_sha": F.sha2(normalised(F.col(text)), 256)})
    return marked.join(kept, ["_k", "_sha"], "left_semi").dropDuplicates(["_k", "_sha"]).select(documents.columns)
