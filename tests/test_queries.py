"""Every registered query against its SQL check on the smallest data."""

import pytest

import checks
from frostline.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return checks.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = checks.compare(spark, duck, name, FOLDER)
    assert result["ok"] is not False, result.get("why")
    assert result["rows"] > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_a_check_are_few():
    assert set(QUERIES) - set(ORACLES) == {"prompt_table"}
