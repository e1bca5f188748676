import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from frostline.llm import lexical

ITEMS = "item_id long, text string, score string, term string, _key string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def expected(documents, items, most=20):
    docs = [(key, Counter(terms(text))) for key, text in documents]
    docs = [(key, c, c.total()) for key, c in docs if c]
    count, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in queries.items():
        scores = []
        for key, c, n in docs:
            m = 100 - 25 + (25 * n * count) // total
            score = sum(
                k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in query.items() if c[t]
            )
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scores)[:most], 1)]
    return Counter(out)


def rows_of(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], ITEMS)


def test_against_all_documents(spark, documents, corpus):
    rng = random.Random(3)
    texts = [t for _, t in corpus if t]
    items = []
    for i in range(30):
        words = rng.choice(texts).split(" ")
        items.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 200])))))
    items += [(90, None), (91, ""), (92, "no such term"), (93, "THE the tHe"), (93, "one two"), (None, "one the"), (94, "Ünïcödé 日本語")]
    got = rows_of(lexical.ranked(documents, items_of(spark, items)))
    want = expected(corpus, items)
    assert got == want and len(want) > 100


@pytest.mark.parametrize("at_once", [200_000, 3])
def test_ties_copies_and_common_words(spark, at_once):
    """Groups of equal texts, and a word that stands in all documents and all items."""
    rng = random.Random(4)
    rows = [(i, f"the {rng.choice('abcdefgh')} {rng.choice('abcdefgh')} the") for i in range(900)] + [(1000 + i, "the a b c d e f g h") for i in range(30)]
    items = [(i, f"the {a} {b}") for i, (a, b) in enumerate(zip("abcdefgh", "hgfedcba", strict=True))] + [(20, "a b c d e f g h the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = rows_of(lexical.ranked(df, spark.createDataFrame(items, "item_id long, text string"), at_once=at_once))
    assert got == expected(rows, items)
    assert rows_of(lexical.ranked(df, spark.createDataFrame(items, "item_id long, text string"), most=3)) == expected(rows, items, 3)


def test_masks_of_more_than_64_terms():
    rng = np.random.default_rng(1)
    has = rng.random((200, 150)) < 0.3
    has[100:] = has[:100]
    mask = lexical.masks([np.flatnonzero(has[:, t]) for t in range(150)], 200)
    assert mask.shape == (200, 3)
    distinct, order, start = lexical.grouped(mask)
    assert len(distinct) == len(np.unique(has, axis=0)) and sorted(order) == list(range(200))
    for a, b in zip(start, np.append(start[1:], 200), strict=True):
        assert (has[order[a:b]] == has[order[a]]).all()


def test_most_documents_are_never_scored():
    """Only the groups that can reach the best are evaluated."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = 5_000
    ids = [sorted({0, *rng.choice(np.arange(1, 8), rng.integers(0, 3)).tolist()}) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([20] * n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([[1] * len(i) for i in ids], pa.list_(pa.int64()))],
        names=["_key", "n", "ids", "tfs"],
    )
    weight = np.array([1, 3000, 3000, 3000, 500, 500, 500, 500], np.int64)
    block, best = lexical.Block(batch, 8, n, 20 * n), lexical.Best(20)
    scored = lexical.search(best, weight, np.arange(8), block)
    every = block.scores(np.arange(n), weight)
    order = np.lexsort((np.arange(n), -every))[:20]
    assert best.key.tolist() == order.tolist() and best.score.tolist() == every[order].tolist() and scored < n / 2


def test_nothing(spark, nothing, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.ranked(nothing, items_of(spark, [(1, "a")])).collect() == [] and lexical.ranked(documents, none).collect() == []
    assert lexical.ranked(nothing, none).collect() == []
