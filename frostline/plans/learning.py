"""Time split, features, sequences, model and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import failure_hours, round_to
from ..operators import features
from ..session import materialise, work_path
from ..sources import tables as stored
from ..sources import training
from .cases import published
from .condition import EXPOSED
from .registry import query, rounded
from .tables import Tables

# Readings per sequence; the test assets have 45 to 99 readings each.
LENGTH = 30

READINGS = f"""{EXPOSED},
readings as (
 select asset_id, event_id, ts, cargo_type, scenario, temperature, humidity, vibration, cast(door_open as double) as door_open, gps_lat, gps_lon,
  cast(refrigeration_failed as double) as refrigeration_failed, risk_proxy, {rounded('total_minutes', 2)} as total_minutes,
  {rounded('temp_degree_minutes', 2)} as temp_degree_minutes, {rounded('humidity_percent_minutes', 2)} as humidity_percent_minutes,
  door_open_minutes, vibration_warn_minutes, vibration_critical_minutes, {rounded('out_of_range_minutes_in_hour', 2)} as out_of_range_minutes_in_hour
 from exposed),
cutoff as (select quantile_cont(epoch_us(ts), 0.9) as micros from telemetry),
training as (select * from readings where epoch_us(ts) <= (select micros from cutoff))
"""


def training_rows(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.filter(features.is_training(features.cutoff_micros(t.telemetry)))


@query(
    "time_split",
    """with cutoff as (select quantile_cont(epoch_us(ts), 0.9) as micros from telemetry)
    select cast(micros as bigint) as cutoff_micros, count(*) filter (where epoch_us(ts) <= micros) as train_rows,
     count(*) filter (where epoch_us(ts) > micros) as validation_rows from telemetry, cutoff group by micros""",
)
def time_split(t: Tables) -> DataFrame:
    cutoff = features.cutoff_micros(t.telemetry)
    train = features.is_training(cutoff)
    return t.telemetry.agg(
        F.rint(F.max(F.lit(cutoff))).cast("bigint").alias("cutoff_micros"), F.count_if(train).alias("train_rows"), F.count_if(~train).alias("validation_rows")
    )


@query(
    "scaler_stats",
    f"with {READINGS}" + " union all ".join(
        f" select '{c}' as feature, {rounded(f'avg({c})', 6)} as mean, {rounded(f'stddev_pop({c})', 6)} as std from training" for c in features.NUMERICS
    ),
)
def scaler_stats(t: Tables) -> DataFrame:
    stats = features.scaling_stats(training_rows(t, published(t)))
    return stats.select("feature", round_to("mean", 6).alias("mean"), round_to("std", 6).alias("std"))


@query(
    "category_vocabulary",
    f"with {READINGS} select distinct 'cargo_type' as feature, cargo_type as value from training union all select distinct 'scenario', scenario from training",
)
def category_vocabulary(t: Tables) -> DataFrame:
    return features.vocabulary(training_rows(t, t.telemetry))


CARGO_ORDER = sorted(
    ["vaccines", "meat", "dairy", "pharmaceuticals", "frozen_food", "produce", "seafood", "ice_cream", "blood_plasma", "flowers"]
)
SCENARIO_ORDER = ["micro_excursions", "normal", "refrigeration_failure"]


def _feature_sql() -> str:
    scaled = [
        f"{rounded(f'(r.{c} - s.mean_{c}) / case when s.std_{c} = 0 then 1 else s.std_{c} end', 5)} as x_{i}"
        for i, c in enumerate(features.NUMERICS)
    ]
    hot = [f"cast(cargo_type = '{v}' as double) as x_{14 + i}" for i, v in enumerate(CARGO_ORDER)]
    hot += [f"cast(scenario = '{v}' as double) as x_{24 + i}" for i, v in enumerate(SCENARIO_ORDER)]
    stats = ", ".join(f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in features.NUMERICS)
    return f"with {READINGS}, stats as (select {stats} from training) select event_id, {', '.join(scaled + hot)} from readings r, stats s"


@query("feature_vectors", _feature_sql())
def feature_vectors(t: Tables) -> DataFrame:
    rows = published(t)
    scaling = features.fit(training_rows(t, rows))
    columns = features.feature_columns(scaling)
    return rows.select("event_id", *[round_to(c, 5).alias(f"x_{i}") for i, c in enumerate(columns)])


def _window_sql(frame: str, keep: str) -> str:
    return f"""with cutoff as (select quantile_cont(epoch_us(ts), 0.9) as micros from telemetry),
    framed as (
     select asset_id, event_id, ts, risk_proxy, row_number() over (partition by asset_id order by ts, event_id) as position,
      count(*) over w as steps, first(event_id) over w as first_event, last(event_id) over w as last_event,
      cast(sum(cast(round(temperature * 10) as bigint)) over w as bigint) as temperature_tenths
     from telemetry window w as (partition by asset_id order by ts, event_id rows between {frame}))
    select asset_id, event_id, steps, first_event, last_event, temperature_tenths, risk_proxy as label,
     case when epoch_us(ts) <= micros then 'train' else 'validation' end as part from framed, cutoff where {keep}"""


def sequence_rows(t: Tables, include_current: bool) -> DataFrame:
    step = F.struct("event_id", F.round(F.col("temperature") * 10).cast("bigint").alias("tenths"))
    made = features.sequences(t.telemetry, step, LENGTH, include_current)
    train = features.is_training(features.cutoff_micros(t.telemetry))
    return made.select(
        "asset_id", "event_id", F.size("sequence").cast("bigint").alias("steps"),
        F.element_at("sequence", 1)["event_id"].alias("first_event"), F.element_at("sequence", -1)["event_id"].alias("last_event"),
        F.aggregate("sequence", F.lit(0).cast("bigint"), lambda a, s: a + s["tenths"]).alias("temperature_tenths"),
        F.col("risk_proxy").alias("label"), F.when(train, "train").otherwise("validation").alias("part"),
    )


@query("train_sequences", _window_sql(f"{LENGTH} preceding and 1 preceding", f"position > {LENGTH}"))
def train_sequences(t: Tables) -> DataFrame:
    return sequence_rows(t, include_current=False)


@query("score_windows", _window_sql(f"{LENGTH - 1} preceding and current row", f"position >= {LENGTH}"))
def score_windows(t: Tables) -> DataFrame:
    return sequence_rows(t, include_current=True)


@query(
    "sequence_counts",
    f"""with cutoff as (select quantile_cont(epoch_us(ts), 0.9) as micros from telemetry),
    placed as (select *, row_number() over (partition by asset_id order by ts, event_id) as position from telemetry)
    select count(*) filter (where epoch_us(ts) <= micros) as train_sequences, count(*) filter (where epoch_us(ts) > micros) as validation_sequences
    from placed, cutoff where position > {LENGTH}""",
)
def sequence_counts(t: Tables) -> DataFrame:
    from ..operators.running import positions

    train = features.is_training(features.cutoff_micros(t.telemetry))
    placed = positions(t.telemetry.select("asset_id", "ts", "event_id"), "asset_id", ["ts", "event_id"])
    return placed.filter(F.col("position") > LENGTH).agg(
        F.count_if(train).alias("train_sequences"), F.count_if(~train).alias("validation_sequences")
    )


@query(
    "packed_series",
    """select asset_id, cast(0 as bigint) as block_no, count(*) as steps, array_to_string(list(event_id order by ts, event_id), ',') as events
    from telemetry group by asset_id""",
)
def packed_series(t: Tables) -> DataFrame:
    rows = features.packed(t.telemetry.select("asset_id", "ts", "event_id"), ["event_id"])
    return rows.select(
        "asset_id", "block_no", F.size("rows").cast("bigint").alias("steps"),
        F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("events"),
    )


def blended(batch):
    """A stand-in model: recent level and long-run level of the risk signal."""
    return 0.7 * batch[:, :, 0].astype("float64").mean(axis=1) + 0.3 * batch[:, -1, 0].astype("float64")


@query(
    "score_sequences",
    f"""with framed as (
     select asset_id, event_id, row_number() over (partition by asset_id order by ts, event_id) as position,
      avg(cast(cast(risk_proxy as float) as double)) over (partition by asset_id order by ts, event_id rows between {LENGTH - 1} preceding and current row) as level,
      cast(cast(risk_proxy as float) as double) as now, risk_proxy from telemetry),
    scored as (select *, 0.7 * level + 0.3 * now as risk from framed where position >= {LENGTH})
    select asset_id, event_id, {rounded('risk', 5)} as predicted_risk_proxy, risk_proxy as actual_risk_proxy,
     {rounded(f'least(72.0, greatest(6.0, 72.0 - least(1.0, greatest(0.0, {rounded("risk", 5)})) * 66.0))', 1)} as time_to_failure_hours from scored""",
)
def score_sequences(t: Tables) -> DataFrame:
    """Sequences scored in batches by a supplied model."""
    made = features.sequences(t.telemetry, F.array("risk_proxy", "humidity"), LENGTH, include_current=True)
    score = features.batch_scorer(blended)
    scored = made.withColumn("predicted_risk_proxy", round_to(score("sequence"), 5))
    return scored.select(
        "asset_id", "event_id", "predicted_risk_proxy", F.col("risk_proxy").alias("actual_risk_proxy"),
        failure_hours("predicted_risk_proxy").alias("time_to_failure_hours"),
    )


@query(
    "eval_metrics",
    f"""with errors as (select p.predicted_risk_proxy - t.risk_proxy as e from prediction p join telemetry t on p.asset_id = t.asset_id and p.prediction_id = t.event_id),
    losses as (select case when abs(e) < 0.1 then 5 * e * e else abs(e) - 0.05 end as l, e * e as s from errors)
    select {rounded('avg(l)', 8)} as smooth_l1, {rounded('sqrt(avg(l))', 8)} as root_smooth_l1, {rounded('avg(s)', 8)} as mse,
     {rounded('sqrt(avg(s))', 8)} as rmse, count(*) as rows from losses""",
)
def eval_metrics(t: Tables) -> DataFrame:
    pairs = t.prediction.select("asset_id", F.col("prediction_id").alias("event_id"), "predicted_risk_proxy").join(
        t.telemetry.select("asset_id", "event_id", "risk_proxy"), ["asset_id", "event_id"]
    )
    names = ["smooth_l1", "root_smooth_l1", "mse", "rmse"]
    return pairs.agg(*features.evaluation("predicted_risk_proxy", "risk_proxy")).select(
        *[round_to(n, 8).alias(n) for n in names], "rows"
    )


def _model_sql(penalty: float = 0.01) -> str:
    """The model fitted in SQL: sums of products, elimination row by row, fitted values."""
    whole = [f"round_even((r.{c} - s.mean_{c}) / case when s.std_{c} = 0 then 1 else s.std_{c} end * {features.UNITS}, 0)" for c in features.NUMERICS]
    hot = [f"{features.UNITS} * cast(cargo_type = '{v}' as integer)" for v in CARGO_ORDER] + [f"{features.UNITS} * cast(scenario = '{v}' as integer)" for v in SCENARIO_ORDER]
    width = len(whole) + len(hot)
    stats = ", ".join(f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in features.NUMERICS)
    unit, n = 1.0 / features.UNITS, 2 * width + 1
    sums, last = (", ".join(f"{f}(x[{i}]) over w" for i in range(1, width + 1)) for f in ("sum", "last"))
    step = "list_transform(m, lambda r, i: case when i = k then list_transform(r, lambda v: v / m[k][k]) else list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) end)"
    scaled = f"list_transform(v, lambda u, i: u * case when i = 1 then cast(1 as double) when i between {width + 2} and {n} then cast({unit / LENGTH!r} as double) else cast({unit!r} as double) end)"
    return f"""with recursive {READINGS}, stats as (select {stats} from training),
    whole as (select asset_id, event_id, ts, risk_proxy, list_transform([{", ".join([*whole, *hot])}], lambda u: cast(u as bigint)) as x from readings r, stats s),
    framed as (select *, row_number() over (partition by asset_id order by ts, event_id) as position, [{last}] as last, [{sums}] as sums from whole window w as (partition by asset_id order by ts, event_id rows between {LENGTH} preceding and 1 preceding)),
    rowed as (select asset_id, event_id, risk_proxy, epoch_us(ts) <= micros as train,
     list_concat([cast(1 as hugeint)], list_transform(last, lambda u: cast(u as hugeint)), list_transform(sums, lambda u: cast(u as hugeint)), [cast(round_even(risk_proxy * {features.UNITS}, 0) as hugeint)]) as v
     from framed, cutoff where position > {LENGTH}),
    cells as (select event_id, unnest(v) as u, generate_subscripts(v, 1) as i from rowed where train),
    unit as (select generate_subscripts(u, 1) as i, unnest(u) as s from (select {scaled.replace("v,", f"list_transform(range({n + 1}), lambda z: cast(1 as double)),", 1)} as u)),
    gram as (select a.i, b.i as j, cast(sum(a.u * b.u) as double) as total from cells a join cells b on a.event_id = b.event_id where a.i <= {n} group by all),
    sized as (select g.i, g.j, g.total * p.s * q.s + case when g.i = g.j and g.i > 1 then {penalty} * (select total from gram where i = 1 and j = 1) else 0 end as a
     from gram g join unit p on g.i = p.i join unit q on g.j = q.i),
    solved as (select 1 as k, (select list(a order by i) from (select i, list(a order by j) as a from sized group by i)) as m union all select k + 1, {step} from solved where k <= {n}),
    weights as (select list_transform(m, lambda r: r[{n + 1}]) as w from solved where k = {n + 1}),
    fitted as (select *, {rounded(f"least(1.0, greatest(0.0, list_dot_product(list_slice({scaled}, 1, {n}), w)))", 6)} as predicted_risk from rowed, weights)
    select asset_id, event_id, risk_proxy, predicted_risk, {rounded('least(72.0, greatest(6.0, 72.0 - predicted_risk * 66.0))', 1)} as time_to_failure_hours,
     case when train then 'train' else 'validation' end as part from fitted"""


@query("risk_model", _model_sql())
def risk_model(t: Tables) -> DataFrame:
    """Risk regressor on window features, trained on the earlier rows and applied to all."""
    rows = materialise(published(t), "readings")
    train = features.is_training(features.cutoff_micros(rows))
    scaling = features.fit(rows.filter(train))
    windows = materialise(features.window_units(rows, scaling, LENGTH), "windows")
    risk = features.train_regressor(windows.filter(train), scaling.width, LENGTH)
    scored = windows.withColumn("predicted_risk", round_to(F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)), 6))
    return scored.select(
        "asset_id", "event_id", "risk_proxy", "predicted_risk", failure_hours("predicted_risk").alias("time_to_failure_hours"),
        F.when(train, "train").otherwise("validation").alias("part"),
    )


@query(
    "csv_roundtrip",
    """select asset_id, ts, cargo_type, scenario, temperature, humidity, vibration, cast(door_open as integer) as door_open,
    cast(refrigeration_failed as integer) as refrigeration_failed, risk_proxy, cast(0 as double) as total_minutes from telemetry""",
)
def csv_roundtrip(t: Tables) -> DataFrame:
    """Readings written as CSV and loaded again as training rows."""
    path = work_path(t.spark, "training-csv")
    training.write_training_csv(t.telemetry, path)
    return training.read_training_csv(t.spark, path).select(
        "asset_id", "ts", "cargo_type", "scenario", "temperature", "humidity", "vibration", "door_open", "refrigeration_failed",
        "risk_proxy", "total_minutes",
    )


@query(
    "incremental_read",
    """select asset_id, event_id, ts, temperature, risk_proxy, (row_number() over (order by ts, event_id) - 1) // 15000 as batch
    from telemetry where ts > timestamp '2024-01-10'""",
)
def incremental_read(t: Tables) -> DataFrame:
    """All readings after a time with the batch of at most 15,000 that they are read in."""
    newer = stored.read_since(t.telemetry, "2024-01-10", ["asset_id", "event_id", "ts", "temperature", "risk_proxy"])
    return stored.in_batches(newer, ties=["event_id"])


@query(
    "prediction_upsert",
    """with writes as (
      select asset_id, ts, prediction_id, predicted_risk_proxy as risk, 0 as batch from prediction union all
      select asset_id, ts, prediction_id, 1.0 - predicted_risk_proxy, 1 from prediction where predicted_risk_proxy > 0.5)
    select asset_id, ts, prediction_id, round(risk, 3) as risk from writes qualify row_number() over (partition by asset_id, ts order by batch desc, prediction_id desc) = 1""",
)
def prediction_upsert(t: Tables) -> DataFrame:
    """Predictions written, then the risky ones again with another value; the second write repeated, as after a failure."""
    table = stored.UpsertTable(t.spark, work_path(t.spark, "predictions"), ["asset_id", "ts"], ["prediction_id"])
    first = t.prediction.select("asset_id", "ts", "prediction_id", F.col("predicted_risk_proxy").alias("risk"))
    again = first.filter(F.col("risk") > 0.5).withColumn("risk", 1.0 - F.col("risk"))
    table.write(first, 0)
    table.write(again, 1)
    table.write(again, 1)
    return table.read().withColumn("risk", round_to("risk", 3))
