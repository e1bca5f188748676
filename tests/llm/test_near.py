import itertools
import re

import numpy as np

from frostline.llm import near
from frostline.llm.components import connected_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, p), (b, q) in itertools.combinations(rows, 2):
        both = len(p & q)
        if p and q and 100 * both >= 85 * (len(p) + len(q) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_components_against_all_pairs(documents, corpus):
    sets = [(i, shingles(t)) for i, t in corpus if i is not None]
    want = components(sets)
    rows = near.near_duplicates(documents).collect()
    assert len(rows) == len(corpus)
    sizes = {}
    for i, s in sets:
        sizes.setdefault(i, set()).add(len(s))
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.n_shingles in sizes[r.doc_id]


def test_chain_of_small_edits_is_one_component(spark):
    """Neighbours of the chain link, its ends do not."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words[i * 6] = f"edited{i}"
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components([(i, shingles(t)) for i, t in rows])
    assert {r.doc_id: r.component_id for r in got} == want and set(want.values()) == {0}


def test_documents_without_near_copies(documents):
    kept = near.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {100} == {i for i in ids if i is not None and 100 <= i < 112} and ids.count(None) == 2


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    sets = [np.unique(a[:3000]), np.unique(a[400:3400])]
    low = near.signatures(near.minima(sets))
    equal = near._EQUAL[low[0] ^ low[1]].sum()
    assert abs(near.estimate(equal) - 2600 / 3400) < 0.12
    assert near.equal_minima_needed(85) < near.MINIMA * 0.85


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 120), (120, 110), (110, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in (100, 110, 120)}, **{200 + i: 200 for i in range(300)}}


def test_nothing(nothing):
    assert near.near_duplicates(nothing).collect() == [] and near.without_near_duplicates(nothing).collect() == []
