import hashlib
import itertools
import math
import random
import re
import time

import pytest

from frostline.llm import private

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    """The contract's patterns, as they are written."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(0, *m.span()) for m in re.finditer(EMAIL, text)]
    found += [(1, *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m[0])) <= 19 and private.luhn(digits(m[0]))]
    return found + [(3, *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def documents_(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents_):
    """Trained on the documents with even ids."""
    return private.trained(private.sampled(documents_.where("doc_id % 2 = 0"), "text", "doc_id"))


def test_patterns_against_regular_expressions():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", ".", "..", "-", " ", "1", "12", "255", "256", "4532015112830366", "+", "(", ")", "+1 ", "é", "x@y.z", "1.2.3.4", "5425 2334 3010 9903", "\n", "0001"]
    for _ in range(4_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert private.patterns(text) == plain(text), text


def test_luhn():
    assert private.luhn("4532015112830366") and not private.luhn("4532015112830367") and private.luhn("0")


def test_long_runs_are_read_once():
    begin = time.time()
    for text in ("x" * 500_000, "x" * 500_000 + "@", "1" * 500_000, "1." * 250_000, "1 " * 100_000, "+1" + "(" * 500_000, "a@" * 200_000, "+1" * 200_000, "dot " * 100_000, " at " * 100_000):
        private.patterns(text), private.segments(text)
    assert time.time() - begin < 60


def choices(found):
    """All sets of segments that do not overlap."""
    for size in range(len(found) + 1):
        for some in itertools.combinations(range(len(found)), size):
            spans = sorted((found[i].start, found[i].end) for i in some)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(spans)):
                yield sorted(some, key=lambda i: found[i].start)


def score(model, found, some):
    """Kinds follow each other where at most one code point at a time lies between places of segments."""
    places = sorted({p for s in found for p in (s.start, s.end)})
    total, last, end = 0.0, 0, None
    for i in some:
        s = found[i]
        if end is None:
            state = 0
        else:
            steps = [p for p in places if end <= p <= s.start]
            state = last if all(b - a <= 1 for a, b in itertools.pairwise(steps)) else 0
        total += model.score(s) + model.after[state][s.kind + 1]
        last, end = s.kind + 1, s.end
    return total


def test_dynamic_programme_against_all_choices():
    rng = random.Random(2)
    for _ in range(200):
        found = sorted({private.Segment(a, a + rng.randrange(1, 5), rng.randrange(4), (f"f{rng.randrange(6)}", f"g{rng.randrange(6)}")) for a in rng.sample(range(14), rng.randrange(1, 8))})
        model = private.Model({f"{c}{i}": rng.gauss(0, 2) for c in "fg" for i in range(6)}, [[rng.gauss(0, 1) for _ in range(5)] for _ in range(5)])
        every = [(score(model, found, some), some) for some in choices(found)]
        best, chosen = private.decode(model, found)
        assert abs(best - max(s for s, _ in every)) < 1e-9 and abs(score(model, found, chosen) - best) < 1e-9
        total, shares, pairs = private.expected(model, found)
        weight = sum(math.exp(s) for s, _ in every)
        assert abs(total - math.log(weight)) < 1e-9
        for i in range(len(found)):
            assert abs(shares[i] - sum(math.exp(s) for s, some in every if i in some) / weight) < 1e-9
        assert abs(sum(pairs.values()) - sum(shares)) < 1e-9


def test_stretches_are_independent(model):
    texts = ["call (017) 555-7713 or 1990-1995", "4929348385146306 4532015112830366 4532-0151-1283-0366", "a.b at mail dot example dot com, 10[.]20[.]30[.]40"]
    for text in texts:
        found = private.segments(text)
        parts = sum(private.decode(model, one)[0] for one in private.stretches(found))
        assert abs(parts - private.decode(model, found)[0]) < 1e-9


def test_held_out_finds(model, documents_):
    """On documents it has not seen: the patterns' finds, and the same rewritten, as the field alone finds them."""
    sample = private.sampled(documents_.where("doc_id % 2 = 1"), "text", "doc_id")
    hit = wanted_ = given = 0
    for text, wanted in private.training_texts(sample, seed=99):
        got = {(found[i].kind, found[i].start, found[i].end) for found in private.stretches(private.segments(text)) for i in private.decode(model, found)[1]}
        hit, wanted_, given = hit + len(got & wanted), wanted_ + len(wanted), given + len(got)
    print("precision", hit / given, "recall", hit / wanted_, wanted_)
    assert hit / given > 0.93 and hit / wanted_ > 0.93


@pytest.mark.parametrize(("text", "want"), [
    ("write to john dot smith at mail dot example dot com today", ["email"]),
    ("mail john.smith [at] mail [dot] example.com now", ["email"]),
    ("call (017) 555-7713 soon", ["phone"]),
    ("numbers 4532015112830366 5425233430109903 here", ["card", "card"]),
    ("from 10[.]20[.]30[.]40 host", ["ip"]),
    ("phone +1 (132) 555-1352 4532015112830366 end", ["phone", "card"]),
    ('token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" on 2024-05-17 12:30, 1990-1995, pages 10 20 30 40, Version 2.0. CC BY-NC 4.0.', []),
    ("meet at noon. A dot here, 4929348385146307 is no card number", []),
])
def test_what_the_patterns_miss(model, text, want):
    base, added = private.spans(text, model)
    assert base == [] and [private.KINDS[k] for k, *_ in sorted(added, key=lambda s: s[1])] == want


def test_every_row_and_whole_texts(spark, documents, corpus):
    extra = [(900, "xy " * 40_000 + " 4532015112830366 " + "y " * 60_000 + "q@r.st"), (901, "éé a@b.c 10.0.0.1, +1 (132) 555-1352"), (None, "me@here.org"), (901, "éé a@b.c 10.0.0.1, +1 (132) 555-1352")]
    rows = corpus + extra
    df = documents.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = private.personal_data(df).collect()
    want = []
    for i, t in rows:
        # The patterns as written go over a run of letters again and again.
        base = plain(t or "") if set(t or "") != {"x"} else []
        listed = private.joined(base)
        want.append((-1 if i is None else i, *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        order = [(private.KINDS.index(k), int(a)) for k, a, _ in spans]
        assert order == sorted(order) and set(r.added.split(",")) - {""} <= set(r.spans.split(","))
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + len([s for s in r.added.split(",") if s])


def test_added_spans_overlap_nothing(spark, documents_):
    texts = {r.doc_id: r.text for r in documents_.collect()}
    for r in private.personal_data(documents_).collect():
        base = plain(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(private.joined(base).encode()).hexdigest()
        listed = set(r.spans.split(",")) - {""}
        added = set(r.added.split(",")) - {""}
        assert listed - added == set(private.joined(base).split(",")) - {""}
        places = sorted([(a, b) for _, a, b in base] + [(int(s.split(":")[1]), int(s.split(":")[2])) for s in added])
        for s in added:
            a, b = (int(x) for x in s.split(":")[1:])
            assert sum(x < b and a < y for x, y in places) == 1


def test_redaction(spark):
    rows = [(1, "a@b.co and 10.0.0.1 or me@here.org."), (2, None), (3, "nothing")]
    got = {r.doc_id: r.text for r in private.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "<email> and <ip> or <email>.", 2: None, 3: "nothing"}


def test_nothing(nothing):
    assert private.personal_data(nothing).collect() == [] and private.redacted(nothing).collect() == []
