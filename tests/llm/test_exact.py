import collections
import hashlib
import re

from frostline.llm import exact


def expected(corpus):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in corpus]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def test_classes_of_equal_texts(documents, corpus):
    rows = exact.exact_duplicates(documents).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == expected(corpus)
    kept = collections.Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_a_text_with_most_rows_is_dealt_to_parts(spark):
    df = spark.createDataFrame([(i, "same  text" if i % 3 else f"own {i}") for i in range(900)], "doc_id long, text string")
    rows = exact.exact_duplicates(df).collect()
    assert [r.doc_id for r in rows if r.kept and r.group_size > 1] == [1]
    assert {r.group_size for r in rows if r.doc_id % 3} == {600} and sum(r.kept for r in rows) == 301


def test_documents_without_copies(documents, corpus):
    kept = exact.without_duplicates(documents)
    assert kept.columns == documents.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.select("text").collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus})


def test_nothing(nothing):
    assert exact.exact_duplicates(nothing).collect() == [] and exact.without_duplicates(nothing).collect() == []
