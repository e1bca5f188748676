import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.llm import arrays, labelled, quality, toxicity

FOLDER = "/root/testdata/sf0.01"
BAD = ["idiot", "moron", "pathetic", "worthless"]


def chunk(*texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def text_of(data, offsets):
    return [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@pytest.fixture(scope="module")
def letters(spark):
    texts = ["you are an idiot and a moron my friend", "what a pathetic and worthless clown you are today", "this book is good and will keep", "too soon to see the loss"] * 30
    return toxicity.character_model(toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string")))


def test_trigrams_are_counted_over_all_texts(spark):
    counts = toxicity.trigram_counts(spark.createDataFrame([("ab",), ("",), (None,), ("abé",)], "text string").repartition(3))
    assert counts.sum() == 4 + 2 + 2 + 6 and counts[0, 0, 1] == 2 and counts[0, 1, 2] == 2 and counts[1, 2, 27] == 1 and counts[2, 27, 27] == 1


def test_disguised_words_are_restored(letters):
    restored = toxicity.Restorer(letters).texts
    seen = {"you 1d10t": "you idiot", "a m0r0n!": "a moron!", "p@thet1c.": "pathetic.", "w0rthle$$": "worthless", "i d i o t": "idiot", "m.o.r.o.n": "moron",
            "idiooooot here": "idiot here", "iiidiot": "idiot", "what 4 p4th3t1c thing": "what 4 pathetic thing"}
    for text, want in seen.items():
        assert text_of(*restored(*chunk(text)))[0] == want, text
    plain = ["you are good", "", "book keep soon", "1234 5678", "THIS IS!! A%%% b*** c&&& --- ..", "1 2 3 4 5 6", "é ü a"]
    assert text_of(*restored(*chunk(*plain)))[:4] == plain[:4]
    assert text_of(*restored(*chunk(*plain, "m0ron")))[-1] == "moron"
    assert text_of(*restored(*chunk("mo", "0r", "aa", "ab"))) == ["mo", "0r".replace("0r", "or"), "aa", "ab"]


def test_viterbi_is_the_best_path(letters):
    """All readings of small lattices."""
    import itertools

    def cost(text):
        a = b = 0
        total = 0.0
        for c in [*text, None]:
            z = 0 if c is None else toxicity._letter(c)
            total -= letters[a, b, z]
            a, b = b, z
        return total

    for word in ("1d10t", "m0r0n", "p@th", "aaa1", "i.d.i", "$$o"):
        slots = list(toxicity._slots(word))
        best = min(cost("".join(r for r, _ in way)) + sum(c for _, c in way) for way in itertools.product(*slots))
        got = toxicity.restore(word, letters)
        assert min(cost("".join(r for r, _ in way)) + sum(c for _, c in way) for way in itertools.product(*slots) if "".join(r for r, _ in way) == got) == pytest.approx(best)


def held(key, folds):
    return zlib.crc32(str(key).encode() if key is not None else b"") % folds


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def area(frame, label):
    a, b = frame.score[frame[label] == 1].to_numpy(), frame.score[frame[label] == 0].to_numpy()
    return (a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()


def test_toxicity_on_held_out_rows(spark):
    documents, labels = tables(spark)
    # Some labels are wrong on purpose: texts without any of the words that mark the others.
    rows = toxicity.toxicity(documents, labels).toPandas()
    assert len(rows) == documents.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [held(k, 5) == 0 for k in rows.doc_id]).all() and (rows.predicted == (rows.score >= 0.5)).all()
    known = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (known.predicted == known.toxic).mean() > 0.93 and area(known, "toxic") > 0.8


def test_quality_on_held_out_rows(spark):
    documents, labels = tables(spark)
    rows = quality.quality(documents, labels).toPandas()
    assert len(rows) == documents.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [held(k, 4) == 2 for k in rows.doc_id]).all() and (rows.predicted == (rows.score >= 0.7)).all()
    known = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (known.predicted == known.quality).mean() > 0.95 and area(known, "quality") > 0.97


def test_disguise_does_not_change_a_verdict(spark):
    rng = random.Random(1)
    good = [f"{a}{b}" for a in "bcdfgl" for b in ("alom", "ender", "isto", "unet", "ora")]
    rows = [(i, " ".join([*(rng.choice(good) for _ in range(30)), *([rng.choice(BAD)] if i % 3 == 0 else [])])) for i in range(600)]
    hidden = {"idiot": "1d10t", "moron": "m o r o n", "pathetic": "p4thet1c", "worthless": "worthlesssss"}
    more = [(1000 + i, " ".join([*(rng.choice(good) for _ in range(30)), hidden[BAD[i % 4]]])) for i in range(40)]
    documents = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(documents, labels).collect()}
    assert all(found[1000 + i] == 1 for i in range(40)) and all(found[i] == int(i % 3 == 0) for i in range(600))


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_odd_texts_and_no_labels(spark, documents, corpus, nothing, score):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(documents, labels).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r, in zip([r for r in rows if r.doc_id in (400, 401)], strict=False)}) == 1
    assert {r.score for r in score(documents, labels.where("false")).collect()} == {0.5}
    assert score(nothing, labels).collect() == []


def test_training_sample_is_bounded_and_leaves_the_fold_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(7, 0), (7, 1)], "doc_id long, toxic int")
    rows = labelled.training_sample(labels, "toxic", "doc_id", 5, 0, 100).collect()
    assert len(rows) == 100 and all(held(r.doc_id, 5) != 0 for r in rows)
    every = labelled.training_sample(labels, "toxic", "doc_id", 5, 0, 10_000)
    assert every.count() == sum(held(i, 5) != 0 for i in range(500)) and every.where(F.col("doc_id") == 7).first()._label == 1


def test_scores_do_not_depend_on_how_texts_are_cut():
    rng = random.Random(2)
    texts = ["", "a", "two words", *(" ".join(f"w{rng.randrange(50)}!" for _ in range(rng.randrange(60))) for _ in range(30))]
    model = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    whole = model.scores(*chunk(*texts))
    assert np.allclose(whole, [model.scores(*chunk(t))[0] for t in texts])
    assert arrays.word_hashes(*chunk("a b", "a"))[1].tolist() == [0, 2, 3]


def test_without_toxic_keeps_columns_and_order(spark):
    documents, labels = tables(spark)
    kept = toxicity.without_toxic(documents, labels)
    assert kept.columns == documents.columns and 0 < documents.count() - kept.count() < 0.2 * documents.count()
