"""Windows are scored from whole columns, messages are decoded once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frostline.operators import features
from frostline.sources import messages

NESTED = pa.list_(pa.list_(pa.float64()))


def test_sequences_of_a_column_are_one_array():
    rng = np.random.default_rng(1)
    want = rng.random((7, 5, 3)).astype(np.float32)
    column = pa.array(want.astype(float).tolist(), NESTED)
    assert (features.stacked(column) == want).all()
    assert (features.stacked(column.slice(2, 3)) == want[2:5]).all()
    missing = features.stacked(pa.array([[[1.0, None]]], NESTED))
    assert missing.shape == (1, 1, 2) and np.isnan(missing[0, 0, 1])


@pytest.mark.parametrize("odd", [[[[1.0], [2.0]], [[1.0]], [[1.0], [2.0], [3.0]]], [[[1.0, 2.0], [3.0]], [[4.0], [5.0, 6.0]]], [[[1.0]], None]])
def test_sequences_of_other_shapes_are_refused(odd):
    with pytest.raises(ValueError, match="one length"):
        features.stacked(pa.array(odd, NESTED))


def test_each_row_gets_its_own_score(spark):
    rows = spark.range(0, 25_000, 1, 3).select("id", F.array(F.array(F.col("id") + 0.0), F.array(F.lit(1.0))).alias("sequence"))
    score = features.batch_scorer(lambda batch: batch[:, :, 0].sum(axis=1))
    assert rows.where(score("sequence") != F.col("id") + 1).count() == 0


def test_a_message_is_decoded_once(spark):
    values = ['{"asset_id":"A","ts":"2024-01-01T00:00:00Z","predicted_risk_proxy":0.5}', "[1]", None, " {}", '{"asset_id":"all"}']
    table = spark.createDataFrame([("coldchain/predictions/B", v) for v in values], "topic string, value string")
    got = messages.normalise_prediction(messages.identified(messages.route(messages.decode(table))))
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") == 1
    assert sorted(r["asset_id"] for r in got.collect()) == ["A", "B", "B"]
    assert messages.quarantine(messages.decode(table)).count() == 2
