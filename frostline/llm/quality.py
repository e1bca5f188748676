"""Quality classifier: supervised subword embeddings.

Method: words, word pairs and character n-grams are hashed into a table of
learned vectors; a document is the mean of its features' vectors, and a softmax
layer gives the classes. Both are fitted by stochastic gradient descent in numpy
on a bounded sample of labelled rows; all documents are scored in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, labelled

#: Most labelled rows that are learned from; they are an even sample by hash.
MAX_TRAINING_ROWS = 4_000
BITS, WIDTH, EPOCHS, RATE = 17, 12, 6, 1.0
NGRAMS = (2, 3, 4)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the bytes from each position on, up to ``size`` of them."""
    packed = np.zeros(len(data), np.uint32)
    for i in range(size):
        packed[: len(data) - i] |= data[i:].astype(np.uint32) << np.uint32(8 * i)
    packed *= np.uint32(2654435761)
    packed ^= packed >> np.uint32(15)
    packed *= np.uint32(2246822519 + 2 * size)
    return packed >> np.uint32(32 - BITS)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of pairs with the word before, and each text's first word.

    A word that repeats the one before is one feature of its own, whatever the word.
    """
    words, first = arrays.word_hashes(data, offsets, fold=False)
    pairs = arrays.mix(words + np.uint64(1))
    if len(words) > 1:
        pairs[1:] = arrays.mix(words[1:] * np.uint64(3) + words[:-1])
        pairs[1:][words[1:] == words[:-1]] = np.uint64(0xABCDEF0123456789)
    starts = first[:-1][first[:-1] < len(words)]
    pairs[starts] = arrays.mix(words[starts] + np.uint64(1))
    shift = np.uint64(64 - BITS)
    return (words >> shift).astype(np.uint32), (pairs >> shift).astype(np.uint32), first


def feature_groups(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets, each kind with each text's first; n-grams do not cross texts."""
    words, pairs, first = _words(data, offsets)
    yield words, first
    yield pairs, first
    for size in NGRAMS:
        grams = _grams(data, size)
        # Those that reach over the end of a text go to one bucket.
        ends = (offsets[1:, None] - np.arange(1, size)[None, :]).ravel()
        starts = np.repeat(offsets[:-1], size - 1)
        grams[ends[ends >= starts]] = size
        yield grams, offsets


@dataclass(frozen=True)
class Model:
    """A feature's share of the logit, by bucket, and the logit without features."""

    table: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for buckets, first in feature_groups(data, offsets):
            total += arrays.sums(self.table[buckets], first)
            count += np.diff(first)
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))


def _features(texts: DataFrame) -> DataFrame:
    """(_label, buckets, counts) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column("_text")):
                groups = list(feature_groups(data, offsets))
                buckets, counts = [], []
                for i in range(b - a):
                    found, n = np.unique(np.concatenate([g[f[i] : f[i + 1]] for g, f in groups]), return_counts=True)
                    buckets.append(found.astype("<u4").tobytes())
                    counts.append(n.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_label").slice(a, b - a), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())],
                    names=["_label", "buckets", "counts"],
                )

    return texts.mapInArrow(run, "_label int, buckets binary, counts binary")


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Vectors and softmax layer from (label, buckets, counts), by stochastic gradient descent."""
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (2, WIDTH)), np.zeros(2)
    known = [(y, b, (n / n.sum()).astype(np.float32)) for y, b, n in rows if len(b)]
    ones = sum(y for y, _, _ in known)
    bias[:] = np.log([max(1, len(known) - ones), max(1, ones)])
    steps, step = max(1, epochs * len(known)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(known)):
            y, buckets, share = known[i]
            now = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[buckets]
            logits = layer @ mean + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[y] -= 1
            back = (layer.T @ wrong).astype(np.float32)
            layer -= now * np.outer(wrong, mean)
            bias -= 0.05 * now * wrong
            # A share is small; the rate of a document's vectors does not fall with its length.
            vectors[buckets] -= (now * 20) * np.outer(np.sqrt(share) * share.max() ** 0.5, back)
    return Model((vectors @ (layer[1] - layer[0]).astype(np.float32)).astype(np.float32), float(bias[1] - bias[0]))


def train(
    documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
    folds: int = 4, held: int = 2, max_rows: int = MAX_TRAINING_ROWS,
) -> Model:
    """A model from at most ``max_rows`` labelled documents outside the held-out fold."""
    sample = labelled.training_sample(labels, label, key, folds, held, max_rows)
    found = _features(labelled.sampled_texts(documents, sample, text, key)).toArrow()
    rows = [
        (y, np.frombuffer(b, "<u4"), np.frombuffer(n, "<u4"))
        for y, b, n in zip(*(found.column(k).to_pylist() for k in ("_label", "buckets", "counts")), strict=True)
    ]
    rows.sort(key=lambda r: (r[1].tobytes(), r[0]))
    return fit(rows)


def scored(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(key, score, predicted) of every whole text; an empty or null text gets the score without features."""
    send = documents.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(send.value.scores(data, offsets), pa.float64())], names=["_key", "score"]
                )

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, score double")
    return rows.select(F.col("_key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Scores depend on the text alone. Null and empty texts get the share of good documents; repeated rows
    and null ids keep a row each; without labelled rows every score is one half; other columns are ignored.
    """
    result = scored(documents, train(documents, labels, folds=folds, held=held))
    return result.select("doc_id", (labelled.fold("doc_id", folds) == held).alias("held_out"), "score", "predicted")
