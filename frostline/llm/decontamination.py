"""Benchmark decontamination: spaced seeds that tolerate substituted words.

Method: fixed masks select some of the tokens in a short span, and the selected tokens are hashed, so that a
substituted word at another position does not matter. Hashes of the benchmark are
joined with those of the documents, and around each hit the tokens are compared on its diagonal.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each mask selects five tokens. However two of thirteen tokens are substituted, one of the masks fits between them;
#: the same holds for one of seven to nine and two of eleven or twelve.
MASKS = ("11111", "111011", "101111")
#: Words of an overlap, and the share of them that must be equal.
OVERLAP, SHARE = 13, 0.8
#: Places of a text that are taken together.
SEGMENT = 256
#: Most benchmark seeds that are sent to every task at once; more are taken in blocks.
MOST_SEEDS = 500_000


def token_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits, lower-cased."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_seeds(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """The rows with ``at``, ``span`` and ``seed``: each place of ``_tokens`` from low to before high, and each mask that fits there.

    Places are exploded first: a seed is then a plain expression over a row, which Spark compiles; a
    lambda over the array would be interpreted.
    """

    def seed(number: int, mask: str) -> Column:
        hashed = F.xxhash64(F.lit(number), *(F.get("_tokens", F.col("at") + i) for i, c in enumerate(mask) if c == "1"))
        return F.when(F.col("at") + len(mask) <= F.size("_tokens"), hashed)

    places = rows.where(low < high).select(*rows.columns, F.explode(F.sequence(low, high - 1)).alias("at"))
    found = places.select("*", F.posexplode(F.array(*(seed(i, m) for i, m in enumerate(MASKS)))).alias("_mask", "seed")).where("seed is not null")
    spans = F.array(*(F.lit(len(m)) for m in MASKS))
    return found.withColumn("span", F.get(spans, F.col("_mask"))).drop("_mask")


def segments(rows: DataFrame) -> DataFrame:
    """The rows with ``_tokens`` in pieces: ``_begin`` to ``_end`` are the piece's own places, the others their surroundings.

    ``_base`` is the first token's place in the text. What goes with each place is then a piece, however long the text.
    """
    before, after = OVERLAP - min(len(m) for m in MASKS), OVERLAP

    def piece(start: Column) -> Column:
        base = F.greatest(F.lit(0), start - before)
        return F.struct(
            base.alias("_base"), (start - base).alias("_begin"), (F.least(F.size("_tokens"), start + SEGMENT) - base).alias("_end"),
            F.slice("_tokens", base + 1, start + SEGMENT + after - base).alias("_tokens"),
        )

    rest = [c for c in rows.columns if c != "_tokens"]
    some = rows.where(F.size("_tokens") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(SEGMENT)), piece)
    return some.select(*rest, F.explode(pieces).alias("_p")).select(*rest, "_p.*")


def benchmark_seeds(benchmark: DataFrame, text: str, key: str) -> DataFrame:
    """(item, item_at, span, seed, item_tokens): each item's seeds with the tokens around them.

    ``item_tokens`` are those of the overlaps that contain the seed; ``item_at`` is the place of the first of them.
    """
    items = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), token_hashes(F.col(text)).alias("_tokens"))
    found = with_seeds(items.where(F.size("_tokens") >= 5), F.lit(0), F.size("_tokens"))
    window = F.least(F.lit(OVERLAP), F.size("_tokens"))
    low = F.greatest(F.lit(0), F.col("at") + F.col("span") - window)
    high = F.least(F.size("_tokens"), F.col("at") + window)
    return found.select(
        "item", "seed", low.alias("item_at"), (F.col("at") - low).alias("before"), window.alias("window"),
        F.slice("_tokens", low + 1, high - low).alias("item_tokens"),
    )


def _hits(documents: DataFrame, index: DataFrame, text: str, key: str) -> DataFrame:
    """(key, item, matched, window, first_word): best overlap of each document, item and diagonal."""
    tokens = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), token_hashes(F.col(text)).alias("_tokens"))
    hits = with_seeds(segments(tokens), F.col("_begin"), F.col("_end")).drop("span").join(index, "seed")
    first = F.col("at") - F.col("before")
    equal = F.transform(
        F.sequence(F.lit(0), F.size("item_tokens") - 1),
        lambda i: F.when(F.get("_tokens", F.when(first + i >= 0, first + i).otherwise(F.size("_tokens"))) == F.get("item_tokens", i), 1).otherwise(0),
    )
    near = hits.select("_key", "item", "window", (F.col("_base") + first).alias("first"), F.explode(F.array(equal)).alias("equal"))
    totals = F.transform(
        F.sequence(F.lit(0), F.size("equal") - F.col("window")),
        lambda i: F.struct(F.aggregate(F.slice("equal", i + 1, F.col("window")), F.lit(0), lambda a, b: a + b).alias("n"), (-i).alias("i")),
    )
    # Exploding a one-element array keeps Spark from computing it anew in every place that names it.
    good = F.filter(F.array(F.array_max(totals)), lambda b: b["n"] >= F.ceil(F.col("window") * SHARE))
    best = near.select("*", F.explode(good).alias("best"))
    place = F.greatest(F.lit(0), F.col("first") - F.col("best.i"))
    return best.groupBy(F.col("_key").alias(key), "item").agg(
        F.max("best.n").alias("matched"), F.max("window").alias("overlap"),
        F.min(place).alias("first_word"), F.max(place + F.col("window")).alias("end_word"),
    )


def contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
) -> DataFrame:
    """(key, item_id, matched, overlap, first_word, end_word): documents that hold a stretch of a benchmark item.

    A stretch is ``OVERLAP`` consecutive words of the item (all of a shorter one) of which a document has at least ``SHARE``
    at the same distances, hit by a seed. ``matched`` is the most equal words in one stretch, first_word and end_word bound all stretches.

    Null and empty texts and items of fewer than five words match nothing; a substituted word in an item of
    five or six words, or two in one of ten, may hide it from all masks.
    Rows without a key are left out; rows of one key count together. Repeated items and other columns do not matter; empty tables give an empty result.

    The benchmark goes to every task in blocks of at most ``MOST_SEEDS`` seeds, each a pass over the documents;
    these are never shuffled, so a passage that very many of them share is no hot key.
    """
    index = benchmark_seeds(benchmark, item_text, item_key)
    blocks = max(1, -(-index.count() // MOST_SEEDS))
    parts = [
        _hits(documents, F.broadcast(index.where(F.pmod(F.xxhash64("item", "item_at", "before"), F.lit(blocks)) == i) if blocks > 1 else index), text, key)
        for i in range(blocks)
    ]
    found = reduce(DataFrame.union, parts)
    if blocks > 1:
        found = found.groupBy(key, "item").agg(
            F.max("matched").alias("matched"), F.max("overlap").alias("overlap"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")
        )
    return found.withColumnRenamed("item", item_key)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without those that hold a stretch of a benchmark item; all columns, rows with a null key stay."""
    bad = contaminated(documents, benchmark, text, key).select(F.col(key).alias("_bad")).distinct()
    return documents.join(bad, F.col(key) == F.col("_bad"), "left_anti")
