"""Toxicity: restore disguised words, then score the restored text.

Method: noisy-channel deobfuscation. A disguised word (letters written as digits
or signs, spaced out, repeated) is a lattice of readings; Viterbi search picks the most
likely one under a character trigram model counted over all documents. Words
of the restored text are scored by a logistic model fitted on labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, labelled

#: Most labelled rows that are learned from; they are an even sample by hash.
MAX_TRAINING_ROWS = 8_000
#: Most words with a weight of their own.
MAX_WORDS = 1_000

#: Readings of a sign, by the channel's cost of each.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiouy", "#": "aeiouy",
}
READ_COST, SAME_COST, DOUBLE_COST, SPACE_COST = 0.5, 4.0, 0.7, 1.0

_LEAD = np.zeros(256, bool)
_LEAD[[ord(c) for c in READINGS]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_MARK = _ASCII | _LEAD
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in " .-_*"]] = True
_TOKEN = _MARK | arrays.LETTERS

# Classes of the character model: 0 for what is no letter, 1 to 26, 27 for letters beyond ASCII.
CLASSES = 28
_CLASS = np.zeros(256, np.int32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter-class trigrams over all documents; as many as the classes allow, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in arrays.chunks(batch.column(0)):
                # Two spaces stand before each text and after the last.
                padded = np.zeros(len(data) + 2 * len(offsets), np.int32)
                places = np.ones(len(padded), bool)
                places[-2:] = False
                heads = offsets[:-1] + 2 * np.arange(len(offsets) - 1)
                places[heads] = places[heads + 1] = False
                padded[places] = _CLASS[data]
                codes = (padded[:-2] * CLASSES + padded[1:-1]) * CLASSES + padded[2:]
                counts += np.bincount(codes, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["code", "n"])

    rows = documents.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(CLASSES**3)
    for row in rows:
        total[row.code] = row.n
    return total.reshape(CLASSES, CLASSES, CLASSES)


def character_model(counts: np.ndarray) -> np.ndarray:
    """Natural logarithms of the third letter's probability after two, smoothed by shorter contexts."""
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + CLASSES)
    pair = counts.sum(0)
    two = (pair + 5 * one) / (pair.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * two[None]) / (counts.sum(2, keepdims=True) + 5))


def _slots(word: str) -> Iterator[list[tuple[str, float]]]:
    """The lattice of a disguised word: the readings of each run of equal characters, with costs."""
    at = 0
    while at < len(word):
        c, n = word[at], 1
        while at + n < len(word) and word[at + n] == c:
            n += 1
        at += n
        if c in " .-_":
            yield [("", 0.0), (" ", SPACE_COST)]
        elif c in READINGS:
            found = [(r * k, READ_COST + DOUBLE_COST * (k - 1)) for r in READINGS[c] for k in range(1, min(n, 2) + 1)]
            yield [*found, (c * n, SAME_COST)]
        else:
            yield [(c * k, 0.0 if k == min(n, 2) else DOUBLE_COST if n < 3 else 0.0) for k in range(1, min(n, 2) + 1)]


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word, found by Viterbi search over its lattice."""
    best = {(0, 0): (0.0, "")}
    for slot in _slots(word.lower()):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in best.items():
            for reading, price in slot:
                x, y, total = a, b, cost + price
                for c in reading:
                    z = _letter(c)
                    total -= model[x, y, z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = total, text + reading
        best = after
    return min((cost - model[a, b, 0], text) for (a, b), (cost, text) in best.items())[1]


def disguised(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in words that may be disguised: signs among letters, three equal letters, letters spaced out."""
    n = len(data)
    if n < 7:
        padded = np.concatenate([data, np.zeros(7 - n, np.uint8)])
        return disguised(padded, offsets) if n else np.zeros(0, np.int64)
    letter, mark, token, dollar = _ASCII[data], _MARK[data], _TOKEN[data], data == ord("$")
    lower = data | np.uint8(32)
    single = mark.copy()
    single[1:] &= ~token[:-1]
    single[:-1] &= ~token[1:]
    signs = [
        (1, (_LEAD[data[:-1]] & letter[1:]) | (letter[:-1] & _DIGIT[data[1:]])),
        (1, letter[:-3] & dollar[1:-2] & ~(dollar[2:-1] & dollar[3:])),
        (2, letter[:-2] & (lower[:-2] == lower[1:-1]) & (lower[1:-1] == lower[2:])),
        (6, single[:-6] & single[2:-4] & single[4:-2] & single[6:]),
    ]
    places = []
    for reach, found in signs:
        place = np.flatnonzero(found)
        # A place in one text and its neighbours in the next are no word.
        places.append(place[place + reach < offsets[np.searchsorted(offsets, place, side="right")]])
    return np.unique(np.concatenate(places))


def _span(text: bytes, at: int) -> tuple[int, int]:
    """Start and end of the disguised word around a place; letters spaced out are one word."""
    a, b = at, at + 1
    while a > 0 and _TOKEN[text[a - 1]]:
        a -= 1
    while b < len(text) and _TOKEN[text[b]]:
        b += 1
    if b - a == 1:
        while b + 1 < len(text) and _SEPARATOR[text[b]] and _MARK[text[b + 1]] and (b + 2 == len(text) or not _TOKEN[text[b + 2]]):
            b += 2
        while a > 1 and _SEPARATOR[text[a - 1]] and _MARK[text[a - 2]] and (a == 2 or not _TOKEN[text[a - 3]]):
            a -= 2
    # Signs at the ends are punctuation, but for one before a letter and up to two dollars after one.
    end = b
    while b > a and _LEAD[text[b - 1]] and not _DIGIT[text[b - 1]]:
        b -= 1
    if end - b <= 2 and text[b:end] == b"$" * (end - b):
        b = end
    while a + 1 < b and _LEAD[text[a]] and not _ASCII[text[a + 1]] and not _DIGIT[text[a]]:
        a += 1
    return a, b


class Restorer:
    """Restores texts; equal words are decoded once per task."""

    def __init__(self, model: np.ndarray):
        self._decode = lru_cache(maxsize=200_000)(lambda word: restore(word.decode("utf-8", "replace"), model).encode())

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts with disguised words replaced."""
        places = disguised(data, offsets)
        if not len(places):
            return data, offsets
        first = np.searchsorted(places, offsets)
        pieces, sizes = [], np.diff(offsets)
        for i in range(len(offsets) - 1):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            if first[i] < first[i + 1]:
                out, done = [], 0
                for at in (places[first[i] : first[i + 1]] - offsets[i]).tolist():
                    if at < done:
                        continue
                    a, b = _span(text, at)
                    a = max(a, done)
                    if b > a:
                        out += [text[done:a], self._decode(text[a:b])]
                        done = b
                text = b"".join([*out, text[done:]])
                sizes[i] = len(text)
            pieces.append(text)
        return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


@dataclass(frozen=True)
class Model:
    """Weights of words by hash, sorted, the logit without words, and the character model."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    letters: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of restored texts; a word counts once in a text."""
        found, first = arrays.word_hashes(data, offsets, of=arrays.LETTERS)
        logit = np.full(len(offsets) - 1, self.bias)
        if len(self.words) and len(found):
            at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == found)
            text = np.searchsorted(first, hit, side="right") - 1
            seen = np.unique(text * np.int64(len(self.words)) + at[hit])
            np.add.at(logit, seen // len(self.words), self.weights[seen % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _restored_words(texts: DataFrame, letters: np.ndarray) -> DataFrame:
    """(_label, words): distinct word hashes of each restored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column("_text")):
                words, first = arrays.word_hashes(*restorer.texts(data, offsets), of=arrays.LETTERS)
                rows = [np.unique(words[first[i] : first[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("_label").slice(a, b - a), pa.array(rows, pa.binary())], names=["_label", "words"])

    return texts.mapInArrow(run, "_label int, words binary")


def fit(rows: list[tuple[int, np.ndarray]], letters: np.ndarray, most: int = MAX_WORDS) -> Model:
    """Logistic weights of the words that mark toxic texts most, by gradient descent."""
    labels = np.array([y for y, _ in rows], float)
    ones, n = labels.sum(), len(rows)
    if not 0 < ones < n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not n else (-4.0 if not ones else 4.0), letters)
    words, inverse = np.unique(np.concatenate([w for _, w in rows]), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(w) for _, w in rows])
    in_all = np.bincount(inverse, minlength=len(words)).astype(float)
    in_toxic = np.bincount(inverse, labels[owner], len(words))
    share = ones / n
    # Standard scores of the toxic share; chance alone reaches four among so many words only rarely.
    z = (in_toxic - in_all * share) / np.sqrt(in_all * share * (1 - share))
    strong = (z > 6) & (in_all >= 5) & (in_toxic > 0.5 * in_all)
    kept = np.sort(np.argsort(-np.where(strong, z, -np.inf), kind="stable")[: min(most, int(strong.sum()))])
    place = np.full(len(words), -1)
    place[kept] = np.arange(len(kept))
    use = place[inverse] >= 0
    row, col = owner[use], place[inverse][use]
    weights, bias = np.zeros(len(kept)), math.log(ones / (n - ones))
    rate, decay = 4.0, 1e-3
    for step in range(400):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights[col], n))))
        error = p - labels
        now = rate / (1 + step / 100)
        bias -= now * error.mean()
        weights -= now * (np.bincount(col, error[row], len(kept)) / np.maximum(1, in_all[kept]) + decay * weights)
    return Model(words[kept], weights, bias, letters)


def train(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id",
    folds: int = 5, held: int = 0, max_rows: int = MAX_TRAINING_ROWS,
) -> Model:
    """Character model of all documents, and weights from at most ``max_rows`` labelled ones outside the held-out fold."""
    letters = character_model(trigram_counts(documents, text))
    sample = labelled.training_sample(labels, label, key, folds, held, max_rows)
    found = _restored_words(labelled.sampled_texts(documents, sample, text, key), letters).toArrow()
    rows = [(y, np.frombuffer(w, np.uint64)) for y, w in zip(found.column("_label").to_pylist(), found.column("words").to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[1].tobytes(), r[0]))
    return fit(rows, letters)


def scored(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """All columns, score and predicted; every whole text is restored and scored."""
    send = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS weights
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(send.value.letters)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(1)):
                scores = send.value.scores(*restorer.texts(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], names=["_key", "score"])

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, score double")
    return rows.select(F.col("_key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold; all columns and their order, without a shuffle."""
    send = documents.sparkSession.sparkContext.broadcast(train(documents, labels, text=text))
    column = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(send.value.letters)
        for batch in batches:
            for a, b, data, offsets in arrays.chunks(batch.column(column)):
                yield batch.slice(a, b - a).filter(pa.array(send.value.scores(*restorer.texts(data, offsets)) < threshold))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Scores depend on the text alone. Null and empty texts get the score without words; repeated
    rows and null ids keep a row each; without labelled rows every score is one half; other columns are ignored.
    """
    result = scored(documents, train(documents, labels, folds=folds, held=held))
    return result.select("doc_id", (labelled.fold("doc_id", folds) == held).alias("held_out"), "score", "predicted")
