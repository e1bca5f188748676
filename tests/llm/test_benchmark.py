import math
import random
import re

from frostline.llm import decontamination

ITEM = "item_id long, text string, doc_id string, seed string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(documents, items):
    """All places of all items, without seeds."""
    out = set()
    for i, t in documents:
        d = words(t)
        for k, s in items:
            b = words(s)
            size = min(13, len(b))
            if len(b) < 5:
                continue
            need = math.ceil(0.8 * size)
            for o in range(len(b) - size + 1):
                for p in range(-size + need, len(d) - need + 1):
                    if sum(0 <= p + j < len(d) and d[p + j] == b[o + j] for j in range(size)) >= need:
                        out.add((i, k))
    return out


def test_overlaps_against_all_places(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([4, 5, 6, 7, 9, 13, 20, 40, 59])] + [(50, None), (51, ""), (None, "a b c d e f g"), (8, "w1 w2")]
    docs = []
    for i in range(120):
        passage = words(items[rng.randrange(9)][1])
        for _ in range(rng.randrange(4)):
            passage[rng.randrange(len(passage))] = word()
        if i % 5 == 0:
            passage = []
        docs.append((i, ", ".join([*(word() for _ in range(rng.randrange(30))), *passage, *(word() for _ in range(rng.randrange(30)))]).upper()))
    docs += [(900, None), (901, ""), (902, "..."), (None, items[8][1]), (903, items[8][1] + " " + items[7][1]), (903, items[7][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, spark.createDataFrame([(k, t, "a", "b") for k, t in items], ITEM)).collect()}
    want = brute([d for d in docs if d[0] is not None], [x for x in items if x[0] is not None])
    assert found <= want
    # Masks fit between any two substitutions in thirteen words; very short items may be missed.
    assert {k for _, k in want - found} <= {1, 2}
    kept = decontamination.without_contaminated(df, spark.createDataFrame([(k, t, "a", "b") for k, t in items], ITEM))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in found}


def test_passages_across_the_borders_of_segments(spark):
    """Passages of several lengths, edited, at every place around the borders of a long text's pieces."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([9, 13, 20, 59])]
    docs = []
    for i in range(60):
        own = [word() for _ in range(3 * decontamination.SEGMENT)]
        passage = words(items[i % 4][1])
        for _ in range(i % 3 if len(passage) > 9 else i % 2):
            passage[rng.randrange(len(passage))] = word()
        at = decontamination.SEGMENT * rng.choice([1, 2]) - rng.randrange(-3, len(passage) + 3)
        docs.append((i, " ".join(own[:at] + passage + own[at:])))
    docs.append((100, " ".join(word() for _ in range(60_000)) + " " + items[3][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = decontamination.contaminated(df, spark.createDataFrame([(k, t, "a", "b") for k, t in items], ITEM)).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found == brute(docs[:-1], items) | {(100, 3)} and len(found) >= 60
    last = next(r for r in rows if r.doc_id == 100)
    assert (last.first_word, last.end_word, last.matched) == (60_000, 60_059, 13)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(25))) for k in range(10)]
    docs = spark.createDataFrame([(k, "before " + t + " after") for k, t in items], "doc_id long, text string")
    test = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.contaminated(docs, test).collect()))
    monkeypatch.setattr(decontamination, "MOST_SEEDS", 100)
    assert sorted(map(tuple, decontamination.contaminated(docs, test).collect())) == whole and len(whole) == 10


def test_nothing(spark, nothing):
    test = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontamination.contaminated(nothing, test).collect() == []
    assert decontamination.contaminated(test.withColumnRenamed("item_id", "doc_id"), test.where("false")).collect() == []
