"""Ranked lexical search: the best documents for each of a set of queries.

Method: presence-mask grouping. A document's mask for an item says which of the item's terms it has, one bit each, set term by term
from the postings. Documents with equal masks are one group, and the most that any of them can score is the sum of the largest
contributions of the mask's terms. Groups are evaluated by descending maximum until the next one cannot reach the
best scores found, so most documents are never scored, and none that could be among the best is left out.

Documents are read once, into postings of the items' terms alone; each task then takes all items against its documents
and gives its best for each item, so neither texts nor pairs of items and documents are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.session import materialise

#: Bytes of a term: letters and digits of ASCII, upper case folded before, and all of UTF-8 beyond it.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents listed for an item.
BEST = 20
#: Terms of items that are searched in one pass over the documents; more items are taken in further passes.
AT_ONCE = 200_000
#: Parts in which an item's best documents are first brought together.
SALTS = 32
_LAST = np.iinfo(np.int64).max


def term_counts(text: str | None) -> Counter[bytes]:
    """How often each term occurs in a whole text; null has none."""
    # bytes.lower() changes A-Z alone.
    return Counter(m[0] for m in TERM.finditer((text or "").encode().lower()))


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item, term, k): the items' terms with their number; rows of one item count together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = term_counts(value)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64()),
                ], names=["item", "term", "k"])

    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("t")).mapInArrow(run, "item long, term binary, k long")
    return rows.groupBy("item", "term").agg(F.sum("k").alias("k"))


def postings(documents: DataFrame, terms: list[bytes], text: str, key: str) -> DataFrame:
    """(key, n, ids, tfs) of the documents that have a term: all their terms' number, and those of ``terms`` they have, by place there."""
    sent = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            keys, sizes, ids, tfs, ends = [], [], [], [], [0]
            for i, value in enumerate(batch.column(1)):
                found = term_counts(value.as_py())
                if not found:
                    continue
                keys.append(i)
                sizes.append(found.total())
                here = known.keys() & found.keys()
                ids += [known[t] for t in here]
                tfs += [found[t] for t in here]
                ends.append(len(ids))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keys, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.int64())),
            ], names=["_key", "n", "ids", "tfs"])

    rows = documents.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "_key long, n long, ids array<int>, tfs array<long>")


def frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term, counted in each task before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "df"])

    out = np.zeros(terms, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[r["id"]] = r["df"]
    return out


class Best:
    """The best documents of one item so far."""

    def __init__(self, most: int) -> None:
        self.most, self.score, self.key, self.null = most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """The score that a document must have to come in; equal ones may, by their key."""
        return max(1, int(self.score[-1])) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        score, key, null = (np.concatenate(x) for x in ((self.score, score), (self.key, key), (self.null, null)))
        order = np.lexsort((key, null, -score))
        order = order[score[order] > 0][: self.most]
        self.score, self.key, self.null = score[order], key[order], null[order]


def masks(rows: list[np.ndarray], documents: int) -> np.ndarray:
    """A row of 64-bit words for each document, in which bit t says that it is among rows[t]."""
    out = np.zeros((documents, max(1, -(-len(rows) // 64))), np.uint64)
    for t, at in enumerate(rows):
        out[at, t // 64] |= np.uint64(1 << (t % 64))
    return out


def grouped(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct, order, start): the distinct masks, the documents ordered by mask, and where each mask's begin."""
    order = np.lexsort(mask.T[::-1])
    ordered = mask[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    start = np.flatnonzero(new)
    return ordered[start], order, start


def search(best: Best, weight: np.ndarray, wanted: np.ndarray, block: Block) -> int:
    """Bring a block's documents into an item's best; gives the number that were scored.

    ``wanted`` are the item's terms, ``weight`` has what each term of all items counts in this one.
    """
    rows, most = [], []
    for t in wanted.tolist():
        at = slice(block.begin[t], block.begin[t + 1])
        if at.stop > at.start:
            rows.append(block.by_term[at])
            most.append(weight[t] * block.largest[t])
    if not rows:
        return 0
    mask = masks(rows, block.documents)
    some = np.flatnonzero(mask.any(axis=1))
    distinct, order, start = grouped(mask[some])
    end = np.append(start[1:], len(order))
    has = (distinct[:, np.arange(len(rows)) // 64] >> (np.arange(len(rows)) % 64).astype(np.uint64)) & np.uint64(1)
    bound = has.astype(np.int64) @ np.array(most, np.int64)
    by_bound = np.argsort(-bound, kind="stable")
    done, scored, some_more = 0, 0, best.most
    while done < len(by_bound) and bound[by_bound[done]] >= best.least():
        # The next groups, of twice as many documents each time, but none below what is needed.
        sizes = np.cumsum((end - start)[by_bound[done:]])
        until = done + int(np.searchsorted(sizes, some_more)) + 1
        take = by_bound[done:until]
        take = take[bound[take] >= best.least()]
        documents = some[np.concatenate([order[start[g] : end[g]] for g in take.tolist()])]
        best.add(block.scores(documents, weight), block.key[documents], block.null[documents])
        scored += len(documents)
        done, some_more = until, some_more * 2
    return scored


class Block:
    """Postings of some documents, by document and by term, with what each contributes for a weight of one."""

    def __init__(self, batch: pa.RecordBatch, terms: int, n_documents: int, n_terms: int) -> None:
        key = batch.column("_key")
        self.null = key.is_null().to_numpy(zero_copy_only=False)
        self.key = key.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.documents = batch.num_rows
        sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        length = 100 - 25 + (25 * n * n_documents) // n_terms
        owner = np.repeat(np.arange(self.documents), sizes)
        self.share = (1_000_000_000 * tf) // (1000 * tf + 12 * length[owner])
        order = np.argsort(self.ids, kind="stable")
        self.by_term = owner[order]
        self.begin = np.searchsorted(self.ids[order], np.arange(terms + 1))
        self.largest = np.zeros(terms, np.int64)
        np.maximum.at(self.largest, self.ids, self.share)

    def scores(self, documents: np.ndarray, weight: np.ndarray) -> np.ndarray:
        size = self.first[documents + 1] - self.first[documents]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.first[documents] - (end - size), size)
        # Every document here has a posting, so no sum is of none.
        return np.add.reduceat(weight[self.ids[at]] * self.share[at], end - size)


def _best_of(rows: DataFrame, items: list[tuple], weights: np.ndarray, n_documents: int, n_terms: int, most: int) -> DataFrame:
    """(item, key, score): each task's best documents for each item (item, terms, numbers)."""
    terms = len(weights)
    sent = rows.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = sent.value
        found = [Best(most) for _ in asked]
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(batch, terms, n_documents, n_terms)
            mine = np.zeros(terms, np.int64)
            for best, (_, ids, numbers) in zip(found, asked, strict=True):
                wanted = ids[weight[ids] > 0]
                mine[ids] = weight[ids] * numbers
                search(best, mine, wanted, block)
                mine[ids] = 0
        for best, (item, _, _) in zip(found, asked, strict=True):
            if len(best.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(best.score), pa.int64()), pa.array(best.key, pa.int64(), mask=best.null), pa.array(best.score, pa.int64()),
                ], names=["item", "_key", "score"])

    return rows.mapInArrow(run, "item long, _key long, score long")


def _first(rows: DataFrame, by: list, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("_key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def ranked(
    documents: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    most: int = BEST, at_once: int = AT_ONCE,
) -> DataFrame:
    """(item_key, rank, key, score): the ``most`` best documents of each item, best first, equal scores by key.

    Terms are runs of ASCII letters and digits and of all code points from U+0080 on, A-Z lower-cased. With N documents that have
    a term, L terms in all, and df documents holding a term, the term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); it adds
    w * (10^9 tf div (1000 tf + 12 (75 + (25 n N) div L))) to a document of n terms that has it tf times, as often as the item has it.
    Only documents with a score above 0 are listed.

    Null and empty texts have no terms; items without any get no rows, and rows of one item (or of none, null) count as one query. Each row of
    ``documents`` is a document, repeated ones too; one without a key comes last among equal scores. Other columns are
    ignored; empty tables give an empty result.

    Items go to the tasks as a table of their terms, ``at_once`` of them at most on average; with more, by hash of the item, in further passes.
    """
    spark = documents.sparkSession
    asked = materialise(item_terms(items, item_text, item_key), "items")
    passes = max(1, -(-asked.count() // at_once))
    out = None
    for number in range(passes):
        mine: dict[int | None, list[tuple[bytes, int]]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect():
            mine.setdefault(r["item"], []).append((bytes(r["term"]), r["k"]))
        terms = sorted({t for rows in mine.values() for t, _ in rows})
        place = {t: i for i, t in enumerate(terms)}
        rows = materialise(postings(documents, terms, text, key), "postings")
        n_documents, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = frequencies(rows, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        queries = [(i, np.array([place[t] for t, _ in ts], np.int64), np.array([k for _, k in ts], np.int64)) for i, ts in mine.items()]
        some = _best_of(rows.where(F.size("ids") > 0), queries, weights, n_documents, max(1, n_terms or 0), most)
        out = some if out is None else out.union(some)
    salted = _first(out.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS))), ["item", "_salt"], most).drop("rank", "_salt")
    return _first(salted, ["item"], most).select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("_key").alias(key), "score")
