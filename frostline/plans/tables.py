"""Input tables of the registered queries, derived from the given parquet files.

Readings, predictions, centres and the rest are computed from ``events`` and
``supplier`` by plain SQL that Spark and DuckDB both run, so a query and its
check see the same rows. Every table covers its whole source.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import profiles
from ..session import use_utc

# Readings: one per event, temperatures spread 12 degrees around each cargo's mid band, all values in tenths.
TELEMETRY = """
select concat('TRUCK_', lpad(cast(e.user_id as varchar(20)), 5, '0')) as asset_id, e.event_id, e.ts, p.profile_cargo as cargo_type,
 case when e.user_id % 10 = 4 then 'refrigeration_failure' when e.user_id % 3 = 0 then 'micro_excursions' else 'normal' end as scenario,
 cast(cast((p.band_low + p.band_high) * 5 as bigint) + (e.event_id * 37 + e.user_id * 11) % 241 - 120 as double) / 10 as temperature,
 cast(200 + (e.event_id * 53) % 790 as double) / 10 as humidity,
 cast((e.event_id * 29) % 100 as double) / 10 as vibration,
 e.event_type = 'click' as door_open,
 (e.user_id % 10 = 4 and e.event_type <> 'signup') as refrigeration_failed,
 cast((e.event_id * 13) % 1001 as double) / 1000 as risk_proxy,
 cast(26400 + (e.event_id * 7) % 2400 as double) / 1000 as gps_lat,
 cast(77000 + (e.event_id * 17) % 3400 as double) / 1000 as gps_lon
from {events} e join {cargo_no} p on e.user_id % 10 = p.cargo_no
"""

# Predictions: one per event, from 20 minutes before to an hour after its reading, so some wait, some expire.
PREDICTION = """
select concat('TRUCK_', lpad(cast(user_id as varchar(20)), 5, '0')) as asset_id, event_id as prediction_id,
 ts + ((event_id * 37) % 4801 - 1200) * interval '1' second as ts,
 cast((event_id * 19) % 1001 as double) / 1000 as predicted_risk_proxy,
 case when event_id % 11 = 0 then cast(event_id % 80 as double) / 10 when event_id % 7 = 0 then null
  else cast(72000 - ((event_id * 19) % 1001) * 66 as double) / 1000 end as time_to_failure_hours
from {events}
"""

# Distribution centres: one per supplier, 8% under maintenance, each without some cargo types.
CENTRE = """
select concat('DC_', lpad(cast(s_suppkey as varchar(20)), 5, '0')) as id, s_name as name, s_suppkey,
 cast(26400 + (s_suppkey * 311) % 2400 as double) / 1000 as lat, cast(77000 + (s_suppkey * 177) % 3400 as double) / 1000 as lon,
 cast(40 + s_suppkey % 90 as integer) as capacity, cast((s_suppkey * 7) % (41 + s_suppkey % 90) as integer) as current_load,
 case when s_suppkey % 13 = 0 then 'maintenance' else 'operational' end as refrigeration_status,
 cast(1 + s_nationkey % 3 as integer) as priority_rank
from {supplier}
"""

# Service status messages: one per event.
STATUS = """
select concat('publisher-', cast(user_id % 40 as varchar(20))) as service_id, event_id, ts,
 case when event_type = 'error' then 'offline' else 'online' end as status
from {events}
"""

# Storage room readings: one per event.
ROOM_READING = """
select event_id, ts, cast(1 + user_id % 5 as integer) as room_id,
 cast((event_id * 37) % 400 - 200 as double) / 10 as temperature,
 cast(250 + (event_id * 53) % 400 as double) / 10 as humidity,
 case when event_type = 'click' then 'Open' else 'Closed' end as door_status,
 case when event_type = 'error' then 'Failed' else 'Active' end as power_status
from {events}
"""

# A centre of this number lacks the cargo types of these positions.
UNSUPPORTED = "(s_suppkey + cargo_no) % 7 = 0"


class Tables:
    """Lazily defined inputs over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = use_utc(spark)
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _derive(self, sql: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(sql, **frames)

    @cached_property
    def profiles(self) -> DataFrame:
        return profiles.cargo_profiles(self.spark)

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def cargo_no(self) -> DataFrame:
        rows = [(i, row[0], row[1], row[2]) for i, row in enumerate(profiles.CARGO_PROFILES)]
        schema = "cargo_no int, profile_cargo string, band_low double, band_high double"
        return F.broadcast(profiles.constant_table(self.spark, rows, schema))

    @cached_property
    def telemetry(self) -> DataFrame:
        return self._derive(TELEMETRY, events=self.events, cargo_no=self.cargo_no)

    @cached_property
    def prediction(self) -> DataFrame:
        return self._derive(PREDICTION, events=self.events)

    @cached_property
    def centre(self) -> DataFrame:
        base = self._derive(CENTRE, supplier=self.read("supplier"))
        supported = F.filter(
            F.array(*[F.when(~F.expr(UNSUPPORTED.replace("cargo_no", str(i))), F.lit(c))
                      for i, c in enumerate(profiles.CARGO_TYPES)]),
            lambda c: c.isNotNull(),
        )
        return base.withColumn("supported_cargo_types", supported).drop("s_suppkey")

    @cached_property
    def status(self) -> DataFrame:
        return self._derive(STATUS, events=self.events)

    @cached_property
    def room_reading(self) -> DataFrame:
        return self._derive(ROOM_READING, events=self.events)

    @cached_property
    def rooms(self) -> DataFrame:
        return profiles.rooms(self.spark)


def _number(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"cast({value} as double)"
    return f"'{value}'" if isinstance(value, str) else str(value)


def _values(rows, columns: list[str]) -> str:
    body = ",\n ".join("(" + ", ".join(_number(v) for v in row) + ")" for row in rows)
    return f"select * from (values\n {body}) as t({', '.join(columns)})"


def duckdb_tables() -> dict[str, str]:
    """The same inputs as DuckDB table expressions, in dependency order."""
    columns = [part.split()[0] for part in profiles.PROFILE_SCHEMA.split(", ")]
    profile_rows = [(i, *row) for i, row in enumerate(profiles.CARGO_PROFILES)]
    room_columns = [part.split()[0] for part in profiles.ROOM_SCHEMA.split(", ")]

    def named(sql: str) -> str:
        return sql.strip().replace("{", "").replace("}", "")

    return {
        "cargo_no": _values(profile_rows, ["cargo_no", *columns]),
        "rooms": _values(profiles.ROOMS, room_columns),
        "telemetry": named(TELEMETRY),
        "prediction": named(PREDICTION),
        "centre": named(CENTRE),
        "centre_cargo": f"select id, profile_cargo as cargo from (select 'DC_' || lpad(cast(s_suppkey as varchar), 5, '0') as id, s_suppkey from supplier) s, cargo_no where not ({UNSUPPORTED})",
        "status": named(STATUS),
        "room_reading": named(ROOM_READING),
    }
