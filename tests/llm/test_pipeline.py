"""The pipeline as a whole on odd rows: nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import random

import corpus_pipeline



def run_over(spark, tmp_path, documents, labels, items):
    for name, df in (("documents", documents), ("labels", labels), ("benchmark", items)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_odd_rows(spark, tmp_path, documents, corpus):
    rng = random.Random(3)
    labels = [(i, i % 2, int(rng.random() < 0.2)) for i, _ in corpus if i is not None] + [(None, 1, 1), (5, None, None), (99_999, 1, 0)]
    passage = next(t for i, t in corpus if i == 300).split(" ")
    items = [(1, " ".join(passage[22:60])), (2, None), (None, ""), (3, "one two")]
    packed = run_over(
        spark, tmp_path, documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    kept = {r.doc_id for r in packed}
    ids = {i for i, _ in corpus if i is not None}
    assert kept - {None} <= ids and not kept & {200, 201, 202, 203, 204, 210}
    # Near copies and the holders of the benchmark's passage are gone but for what the stages before took.
    assert len(kept & set(range(100, 112))) <= 1 and not kept & {300, 301, 302, 303}
    assert {500, 501, 502} & kept
    # Every sequence is filled without gaps, and no document that stayed lost a token.
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    end = {}
    for sequence, offset, length in places:
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert max(end.values()) <= 4096
    for i in kept - {None}:
        pieces = sorted((r.start, r.length, r.doc_tokens) for r in packed if r.doc_id == i)
        assert sum(n for _, n, _ in pieces) >= pieces[0][2]


def test_empty_tables(spark, tmp_path, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run_over(spark, tmp_path, nothing, none, spark.createDataFrame([], "item_id long, text string")).collect() == []
