import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    """Invented words; long enough that no two texts share a stretch by chance."""
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty, blank and very long texts, repeated rows and odd characters."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(3, 160)) for _ in range(40)]
    passage = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    near = prose(rng, 150).split(" ")
    for i in range(12):
        words = list(near)
        words[rng.randrange(150)] = f"edit{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, base[3]) for i in range(5)] + [(210, base[4].replace(" ", "\n\t ", 3)), (211, base[3].upper())]
    rows += [(300 + i, f"{prose(rng, 20)} {passage} {prose(rng, 15)}") for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "one two"), (405, "Ünïcödé 日本語 ​ \x00 \x1c end."), (406, "a")]
    rows += [(500, prose(rng, 30_000)), (501, "x" * 300_000), (502, "the " * 5_000), (403, "one two"), (None, base[3]), (None, None)]
    rows += [(600, base[5]), (600, base[6] + " more words")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with the columns of documents and some that an operator might use itself."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in corpus]
    df = spark.createDataFrame(rows, DOCUMENT).repartition(3)
    clash = "id _key _text _digest _part text2 score bucket keys spans band bands n component node signature digest sha first kept _tokens item equal".split()
    for name in clash:
        df = df.selectExpr("*", f"'clash' as `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)
