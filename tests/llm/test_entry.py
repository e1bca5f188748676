import sys
from pathlib import Path

import pytest

import checks
import corpus_pipeline
import __spark_entry__ as entry
from frostline.llm import decontamination, exact, near, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = checks.connect(FOLDER)
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert checks.table(df.columns, [tuple(r) for r in df.collect()]) == checks.table(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_without_sql_runs_over_the_whole_table(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    table = "pages" if name.startswith("op5") else "documents"
    rows = df.count()
    # Rows of these are pieces, pairs, stretches and words.
    if not name.startswith(("op2_", "op4_", "op7_", "op11_")):
        assert rows == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert rows > 0


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("labels", "benchmark"))
    scored = toxicity.toxicity(docs, labels)
    kept = docs.join(scored.where("predicted = 0"), "doc_id", "left_semi").select(docs.columns)
    for classes in (exact.exact_duplicates, near.near_duplicates):
        kept = spark.createDataFrame(kept.join(classes(kept).where("kept"), "doc_id", "left_semi").collect(), docs.schema)
    bad = {r.doc_id for r in decontamination.contaminated(kept, items).collect()}
    want = {r.doc_id for r in kept.collect()} - bad
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "decontamination", "packing"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == want and 0 < len(want) < docs.count()


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent
    for path in [*(root / "frostline").rglob("*.py"), *(root / "tests").glob("*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
    assert "frostline.llm" in sys.modules
