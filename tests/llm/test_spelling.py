import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from frostline.llm import spelling


def counted(rows, altered=False):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if altered and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def rows_of(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_words(rng, n, letters, low, high):
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
        words.add(w)
        if len(words) < n:
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return sorted(words)


@pytest.mark.parametrize(("letters", "low", "high", "most"), [("ab", 5, 9, 16_000), ("ab", 5, 9, 3), ("abcé", 5, 8, 8), ("aÿ", 5, 12, 2), ("abcdefgh", 5, 7, 4)])
def test_against_all_pairs(spark, letters, low, high, most):
    """Few letters give words with very many near ones, doubled letters and lists that are dealt out."""
    rng = random.Random(len(letters) + most)
    rows = []
    for i, w in enumerate(random_words(rng, 150, letters, low, high)):
        rows.append((i, " ".join([w] * rng.choice([2, 3, 3, 4, 6, 8, 13, 30]))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(counted(rows))
    assert rows_of(spelling.spelling_variants(df, most=most)) == want and len(want) > 80


def test_corpus_with_odd_rows(documents, corpus):
    got = rows_of(spelling.spelling_variants(documents, altered=spelling.one_in_97))
    assert got == expected(counted(corpus, altered=True))


def test_deleted_code_points_make_words(spark):
    rows = [(i, "ordinary Ordinary ÉCOLEécole") for i in range(4_000)]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), altered=spelling.one_in_97))
    assert got == expected(counted(rows, altered=True)) and any(form == "ordinary" for _, form, *_ in got)


def test_very_long_words_and_texts(spark):
    long = "ab" * 10_000
    changed = long[:14_000] + "x" + long[14_001:]
    rows = [(1, " ".join([long] * 4 + [long + "c"] * 3 + [changed] * 9)), (2, "short words " * 50_000)]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {
        (long, changed, changed, 4, 2, 9), (long + "c", None, long + "c", 3, 1, None), (changed, None, changed, 9, 1, None),
        ("short", None, "short", 50_000, 0, None), ("words", None, "words", 50_000, 0, None),
    }


def test_chain_of_forms_ends_at_the_last(spark):
    """Each word is half as frequent as the next, one letter away: the chain is longer than a few doublings."""
    words = ["a" * i + "b" * (12 - i) for i in range(12)]
    rows = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words)]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: (words[i + 1] if i < 11 else None, words[11]) for i, w in enumerate(words)}


def test_rows_of_a_prefix_are_computed_once():
    """Ranges whose prefix needs two edits are not entered."""
    words = sorted({f"aa{x}{y}zz" for x in "bcdefghij" for y in "bcdefghij"} | {"aabbzy"})
    encoded = [w.encode() for w in words]
    offset = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
    none = np.zeros(len(words), np.int64)
    a, b = spelling.scan(np.frombuffer(b"".join(encoded), np.uint8), offset, none, none + 2, none + 6)
    assert {(words[x], words[y]) for x, y in zip(a, b, strict=True)} == {(x, y) for x in words for y in words if one_edit(x, y)}


def test_nothing(nothing):
    assert spelling.spelling_variants(nothing).collect() == []
