import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from frostline.llm import arrays, merging, passages, suffixes


def brute(rows, length=50):
    first, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_strings_against_brute_force(documents, corpus):
    seen = {}
    for i, t in corpus:
        if i is not None and i != 600:
            seen[i] = t
    others = [(600, t) for i, t in corpus if i == 600]
    rows = suffixes.remove_repeats(documents).collect()
    assert len(rows) == len(corpus)
    want = brute([*seen.items(), *others])
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
        elif r.doc_id != 600:
            assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_edges_of_repeats(spark):
    """Shared stretches of 49, 50 and more bytes, at starts and ends, overlapping, in two bytes a letter, within one document."""
    rng = random.Random(3)
    text = lambda n, a="abcdefgh": "".join(rng.choice(a) for _ in range(n))
    one, two, umlauts = text(200), text(120), text(80, "äöüßé")
    rows = [(1, one), (2, one[:49] + text(30)), (3, one[:50] + text(30)), (4, text(20) + one[100:]), (5, one[20:90] + one[60:140] + "!"),
            (6, two + two), (7, two + text(10) + one[:70] + umlauts), (8, umlauts[3:]), (9, "ab" * 100), (10, "ab" * 90), (11, one), (12, one[::-1])]
    rows += [(20 + i, "".join(text(8, "xy") for _ in range(12)) + one[i : i + 60]) for i in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_a_chunk_of_copies_alone(spark):
    """All strings of each chunk are shared there, or none is left to send."""
    text = "".join(chr(97 + i % 23) for i in range(400))
    rows = [(i, text + str(i % 2) * 60) for i in range(8)]
    for parts in (1, 4):
        got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        assert got == brute(rows)


def test_a_frequent_anchor_is_sent_once_per_chunk():
    """A passage of many texts and copies of one text send each k-gram to its bucket once; the texts that share it are all named."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, copy = text(150), text(300)
    texts = [*(text(60) + passage + text(60) for _ in range(40)), *[copy] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(texts)], names=["id", "text"])
    sent, named = [], set()
    for rows in suffixes._anchor_rows(iter([batch]), 50, 6):
        for r in rows.to_pylist():
            if r["bucket"] < 0:
                named |= set(np.frombuffer(r["ids"], np.int64).tolist())
            else:
                sent += [(r["bucket"], int(k)) for k in np.frombuffer(r["keys"], "<u4")]
                assert max(np.frombuffer(r["ids"], np.int64)) <= 40
    assert len(sent) == len(set(sent)) and named == set(range(40))


@pytest.mark.parametrize("width,count", [(4, 1), (6, 3), (50, 9), (3, 16)])
def test_merge_of_front_coded_runs(width, count):
    rng = np.random.default_rng(width)
    runs, every = [], []
    for _ in range(count):
        rows = rng.integers(97, 100, (int(rng.integers(0, 60)), width)).astype(np.uint8)
        rows = rows[merging.sorted_order(rows)]
        decoded, shared = merging.decode(*merging.front_code(rows), width)
        assert (decoded == rows).all()
        runs.append(([r.tobytes() for r in rows], shared.tolist()))
        every += runs[-1][0]
    run, place, shared = merging.merge(runs, width)
    merged = [runs[i][0][j] for i, j in zip(run, place, strict=True)]
    assert merged == sorted(every)
    for before, now, common in zip(merged, merged[1:], shared[1:], strict=False):
        assert before[:common] == now[:common] and (common == width or before[common] != now[common])


def test_passages(documents, corpus):
    rows = passages.repeated_passages(documents).collect()
    gone = {}
    for r in rows:
        gone.setdefault(r.doc_id, []).append(r)
    # The shared passage and the near copies go but in the first document; copies of short texts stay.
    assert {301, 302, 303} <= set(gone) and 300 not in gone and 100 not in gone and set(range(101, 112)) <= set(gone)
    texts = dict(corpus)
    passage = texts[300].split()[20:80]
    for i in (301, 302, 303):
        assert gone[i][0].keep_ids == [300]
        words = texts[i].split()[gone[i][0].first_word : gone[i][0].end_word]
        assert len(words) >= passages.PARAGRAPH and " ".join(words) in " ".join(passage)
    alone = {i for i, t in corpus if i is not None and i < 40 and i not in (3, 4, 5, 6)}
    assert not alone & set(gone) and not {400, 401, 402, 403, 404, 405, 406} & set(gone)


def test_every_long_passage_has_a_whole_paragraph(spark):
    """Passages of 51 equal words are found at any place of texts that share nothing else."""
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(10**6)}"
    rows = []
    for i in range(60):
        passage = [word() for _ in range(51)]
        for k in range(2):
            rows.append((2 * i + k, " ".join([*(word() for _ in range(rng.randrange(40))), *passage, *(word() for _ in range(rng.randrange(40)))])))
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {2 * i + 1 for i in range(60)}


def test_passages_that_repeat_within_a_document_too(spark):
    """A document's second copy of another's passage goes as well, wherever the rows are read."""
    passage = " ".join(f"v{i}" for i in range(60))
    rows = [(1, passage), (2, f"{passage} a b c {passage}"), (3, f"x {passage} y z {passage} w")]
    for parts in (1, 3):
        gone = {}
        for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect():
            gone[r.doc_id] = gone.get(r.doc_id, 0) + r.end_word - r.first_word
        assert set(gone) == {2, 3} and all(n >= 2 * passages.PARAGRAPH for n in gone.values())


def test_edited_passages_are_verified(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    few, many = list(words), list(words)
    few[60] = "changed"
    for i in range(0, 120, 3):
        many[i] = f"other{i}"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(few)), (3, " ".join(many))], "doc_id long, text string")
    assert {r.doc_id for r in passages.repeated_passages(df).collect()} == {2}


def _behind_heads():
    """Two near copies and, for each band that both are in, an unlike earlier paragraph of the same key."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(10**6)}"

    def keys(texts):
        data, offsets = arrays.text_bytes(pa.array(texts))
        return passages.paragraphs(*arrays.word_hashes(data, offsets))[2][:, 1:]

    while True:
        words = [word() for _ in range(passages.PARAGRAPH)]
        copy = [*words[:-1], "changed"]
        one, two = keys([" ".join(words), " ".join(copy)])
        heads = {}
        for _ in range(20):
            at = rng.randrange(10)
            texts = [" ".join([*(word() for _ in range(at)), *words[at : at + 19], *(word() for _ in range(9 - at))]) for _ in range(50)]
            for text, key in zip(texts, keys(texts), strict=True):
                heads |= {band: text for band in np.flatnonzero((key == one) & (key == two)).tolist()}
        if set(heads) == set(np.flatnonzero(one == two).tolist()):
            return sorted(set(heads.values())), " ".join(words), " ".join(copy)


@pytest.mark.parametrize("block,loose", [(2_048, 16), (2, 1)])
def test_near_copies_behind_an_unlike_paragraph(spark, monkeypatch, block, loose):
    """Each band that two near copies share starts with a paragraph that is not alike to them; in one chunk and in several."""
    monkeypatch.setattr(passages, "BLOCK", block)
    monkeypatch.setattr(passages, "LOOSE", loose)
    heads, one, two = _behind_heads()
    rows = [*enumerate(heads), (100, one), (101, two)]
    for parts in (1, 4):
        found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect()
        assert {(r.doc_id, tuple(r.keep_ids)) for r in found} == {(101, (100,))}


def test_chains_behind_one_near_copy(spark, monkeypatch):
    """What links are left after each has met its first partner is found across components."""
    monkeypatch.setattr(passages, "BLOCK", 4)
    monkeypatch.setattr(passages, "LOOSE", 2)
    rng = random.Random(8)
    words = [f"v{rng.randrange(10**6)}" for _ in range(passages.PARAGRAPH)]
    rows = []
    for i in rng.sample(range(24), 24):
        rows.append((i, " ".join(words)))
        words[-1 - len(rows) % passages.PARAGRAPH] = f"new{i}"
    every = np.array([[hash(w) & (2**62 - 1) for w in t.split()] for _, t in sorted(rows)], np.uint64)
    want = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            near = passages.alike(np.repeat(every[[i]], len(rows), 0), every)
            want[i] = min(w for w, n in zip(want, near, strict=True) if n)
    for parts in (1, 4):
        found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect()
        assert {r.doc_id: r.keep_ids for r in found} == {i: [w] for i, w in enumerate(want) if w != i}


def test_similarities_of_pairs():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 6, (300, passages.PARAGRAPH)).astype(np.uint64)
    b = a.copy()
    for i in range(300):
        at = rng.integers(0, passages.PARAGRAPH, rng.integers(0, 8))
        b[i, at] = rng.integers(0, 9, len(at))
        if i % 4 == 0:
            b[i] = np.concatenate([b[i][1:], [99]])
    sets = lambda w: {tuple(w[i : i + passages.SHINGLE]) for i in range(len(w) - passages.SHINGLE + 1)}

    def edits(x, y):
        before = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            now = [i]
            for j, q in enumerate(y, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (p != q)))
            before = now
        return before[-1]

    similar, edited = passages.jaccard(a, b), passages.edit_distances(a, b, 5)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = sets(x), sets(y)
        assert abs(similar[i] - len(p & q) / len(p | q)) < 1e-12
        want = edits(x, y)
        assert edited[i] == want if want <= 5 else edited[i] > 5


def test_nothing(nothing):
    assert suffixes.remove_repeats(nothing).collect() == [] and passages.repeated_passages(nothing).collect() == []
