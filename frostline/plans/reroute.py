"""Nearest centres, reroute benefit and recommendation, route positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import profiles
from ..operators import nearest, routing
from .cases import CASES, case_table
from .registry import query, rounded
from .tables import Tables

KM = (
    "12742.0 * asin(sqrt(least(1.0, power(sin(radians({b}lat - {a}gps_lat) / 2), 2)"
    " + cos(radians({a}gps_lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}gps_lon) / 2), 2))))"
)

OPEN_CENTRES = """
open_centres as (
 select *, greatest(0, capacity - current_load) as available_capacity from centre
 where refrigeration_status = 'operational' and greatest(0, capacity - current_load) >= 1)
"""


def ranked(source: str, keys: str, k: int, centres: str = "open_centres") -> str:
    """All distances, the k best per reading."""
    km = KM.format(a="t.", b="c.")
    return f"""
near as (
 select * exclude (km) from (
  select {keys}, t.cargo_type, c.id, c.name, c.capacity, c.available_capacity, c.priority_rank, {km} as km, {rounded(km, 2)} as distance_km
  from {source} t join {centres} c on true
  where exists (select 1 from centre_cargo s where s.id = c.id and s.cargo = t.cargo_type))
 where km <= 350
 qualify row_number() over (partition by {keys.replace('t.', '')} order by distance_km, available_capacity desc, priority_rank, id) <= {k}),
ranked_near as (
 select *, row_number() over (partition by {keys.replace('t.', '')} order by distance_km, available_capacity desc, priority_rank, id) as rank from near)
"""


KEYS = ["asset_id", "event_id"]


def centre_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *KEYS, "rank", F.col("centre.id").alias("id"), "distance_km", F.col("centre.available_capacity").alias("available_capacity")
    )


@query(
    "nearest_centres",
    f"""with {OPEN_CENTRES}, {ranked('telemetry', 't.asset_id, t.event_id', 3)}
    select asset_id, event_id, cast(rank as integer) as rank, id, distance_km, available_capacity from ranked_near""",
)
def nearest_centres(t: Tables) -> DataFrame:
    return centre_columns(nearest.nearest_centres(t.telemetry, nearest.eligible(t.centre), KEYS, 3))


def excluded(t: Tables) -> DataFrame:
    """Centres a planner rules out: the ones of the second priority, spelled in lower case with blanks."""
    return t.centre.filter(F.col("priority_rank") == 2).select(F.concat(F.lit(" "), F.lower("id")).alias("id"))


@query(
    "centre_exclusion",
    f"""with {OPEN_CENTRES}, allowed as (select * from open_centres where priority_rank <> 2),
    {ranked('telemetry', 't.asset_id, t.event_id', 2, 'allowed')}
    select asset_id, event_id, cast(rank as integer) as rank, id, distance_km, available_capacity from ranked_near""",
)
def centre_exclusion(t: Tables) -> DataFrame:
    allowed = nearest.without(nearest.eligible(t.centre), excluded(t))
    return centre_columns(nearest.nearest_centres(t.telemetry, allowed, KEYS, 2))


SCORED = f"""{CASES}, {OPEN_CENTRES},
urgent as (select *, case when risk_level = 'critical' then 3 else 2 end as results from analysed where risk_level in ('high', 'critical')),
{ranked('urgent', 't.asset_id, t.prediction_id, t.results', 6)},
timed as (
 select u.*, n.id, n.name, n.capacity, n.available_capacity, n.distance_km,
  case when u.refrigeration_failed or u.scenario = 'refrigeration_failure' then 40.0 else 45.0 end as speed
 from ranked_near n join urgent u on n.asset_id = u.asset_id and n.prediction_id = u.prediction_id
 where n.rank <= greatest(3, 2 * u.results)),
arriving as (select *, {rounded('distance_km / speed', 2)} as eta_hours from timed),
buffered as (select *, {rounded('time_to_failure_hours - eta_hours', 2)} as eta_buffer_hours from arriving),
scored_offers as (
 select *, case when eta_hours > time_to_failure_hours then 0.0 else {rounded('''least(100.0, greatest(0.0, 100.0 * (
   0.30 * case when time_to_failure_hours is null then 0.5 else greatest(0.0, least(1.0, (eta_buffer_hours + 2.0) / 4.0)) end
   + 0.25 * (1.0 - greatest(0.0, least(1.0, distance_km / 350.0)))
   + 0.20 * (cast(available_capacity as double) / capacity) + 0.15 * cast(1 as double) + 0.10 * cast(1 as double)
   + (case when refrigeration_failed then cast(0.10 as double) else 0.0 end
    + case when scenario = 'refrigeration_failure' then 0.08 else 0.0 end
    + case when combined_score >= 0.80 and distance_km <= 60 then 0.05 else 0.0 end
    + case when combined_score >= 0.70 then 0.03 else 0.0 end))))''', 2)} end as benefit_score
 from buffered),
offers as (
 select *, row_number() over (partition by asset_id, prediction_id order by benefit_score desc, distance_km, available_capacity desc, id) as place
 from scored_offers),
best as (
 select asset_id, prediction_id, any_value(results) as results, count(*) as considered,
  max(case when place = 1 and benefit_score > 0 then id end) as target_dc,
  max(case when place = 1 and benefit_score > 0 then name end) as dc_name,
  max(case when place = 1 and benefit_score > 0 then eta_hours end) as eta_hours,
  max(case when place = 1 and benefit_score > 0 then distance_km end) as distance_km,
  max(case when place = 1 and benefit_score > 0 then benefit_score end) as benefit_score,
  string_agg(id, '|' order by place) filter (where place <= results) as alternatives
 from offers group by asset_id, prediction_id)
"""


def urgent_cases(analysed: DataFrame) -> DataFrame:
    """Cases whose level calls for rerouting."""
    return analysed.filter(F.col("risk_level").isin("high", "critical"))


def wanted_results() -> F.Column:
    return F.when(F.col("risk_level") == "critical", 3).otherwise(2)


@query(
    "reroute_benefit",
    f"""with {SCORED} select asset_id, prediction_id, id, distance_km, eta_hours, benefit_score,
    eta_hours <= time_to_failure_hours as can_arrive, eta_buffer_hours from scored_offers""",
)
def reroute_benefit(t: Tables) -> DataFrame:
    """Score of every centre considered for an urgent case."""
    urgent = urgent_cases(case_table(t))
    near = nearest.with_nearest(urgent, nearest.eligible(t.centre), 6)
    considered = F.slice("nearest", F.lit(1), routing.offers_considered(wanted_results()))
    offers = near.withColumn("_n", F.explode(considered)).select(*urgent.columns, "_n.distance_km", "_n.centre")
    return routing.benefit(offers).select(
        "asset_id", "prediction_id", F.col("centre.id").alias("id"), "distance_km", "eta_hours", "benefit_score",
        F.col("can_arrive_before_failure").alias("can_arrive"), "eta_buffer_hours",
    )


@query(
    "reroute_best",
    f"with {SCORED} select asset_id, prediction_id, target_dc, dc_name, eta_hours, distance_km, benefit_score, alternatives from best",
)
def reroute_best(t: Tables) -> DataFrame:
    best = routing.recommend(urgent_cases(case_table(t)), t.centre, wanted_results())
    dc = "recommended_dc"
    return best.select(
        "asset_id", "prediction_id", F.col(f"{dc}.id").alias("target_dc"), F.col(f"{dc}.name").alias("dc_name"),
        F.col(f"{dc}.eta_hours").alias("eta_hours"), F.col(f"{dc}.distance_km").alias("distance_km"),
        F.col(f"{dc}.benefit_score").alias("benefit_score"),
        F.array_join(F.transform("alternatives", lambda d: d["id"]), "|").alias("alternatives"),
    )


ROUTE_VALUES = ", ".join(
    f"('{name}', {i}, cast({lat} as double), cast({lon} as double))"
    for name, path in profiles.ROUTES.items()
    for i, (lat, lon) in enumerate(path)
)
ROUTE_NAMES = list(profiles.ROUTES)



def driven(t: Tables) -> DataFrame:
    """Kilometres driven at each event, on one of the four planned routes."""
    names = F.array(*[F.lit(r) for r in ROUTE_NAMES])
    return t.events.select(
        "event_id",
        F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("route"),
        ((F.col("event_id") * 41 % 4000).cast("double") / 10.0).alias("driven_km"),
    )


@query(
    "route_position",
    f"""with points(route, seq, lat, lon) as (values {ROUTE_VALUES}),
    legs as (select *, lead(lat) over w as to_lat, lead(lon) over w as to_lon from points window w as (partition by route order by seq)),
    lengths as (select *, greatest(0.001, {KM.format(a='', b='to_').replace('gps_', '')}) as length_km from legs where to_lat is not null),
    segments as (select *, sum(length_km) over (partition by route order by seq) as end_km,
      row_number() over (partition by route order by seq desc) = 1 as final from lengths),
    bounds as (select *, coalesce(lag(end_km) over (partition by route order by seq), 0.0) as start_km from segments),
    driven as (select event_id, {ROUTE_NAMES}[user_id % 4 + 1] as route, cast(event_id * 41 % 4000 as double) / 10 as driven_km from events)
    select event_id, d.route, driven_km, final and driven_km >= end_km as arrived,
     {rounded('case when final and driven_km >= end_km then to_lat else lat + (to_lat - lat) * ((driven_km - start_km) / length_km) end', 6)} as lat,
     {rounded('case when final and driven_km >= end_km then to_lon else lon + (to_lon - lon) * ((driven_km - start_km) / length_km) end', 6)} as lon
    from driven d join bounds b on d.route = b.route and ((driven_km >= start_km and driven_km < end_km) or (final and driven_km >= end_km))""",
)
def route_position(t: Tables) -> DataFrame:
    from ..functions.numeric import round_to

    at = routing.route_position(driven(t), profiles.default_routes(t.spark))
    return at.select("event_id", "route", "driven_km", "arrived", round_to("lat", 6).alias("lat"), round_to("lon", 6).alias("lon"))


@query(
    "centre_resolution",
    f"""with requests as (
      select event_id, gps_lat, gps_lon, ' dc_' || lpad(cast(event_id % 1300 as varchar), 5, '0') as center_id,
       case when event_id % 3 = 0 then cast(event_id % 200 as double) else cast(-1 as double) end as given from telemetry),
    found as (select r.*, c.id, {KM.format(a='r.', b='c.')} as km, c.capacity - c.current_load as free from requests r left join centre c on upper(trim(r.center_id)) = c.id)
    select event_id, id, case when id is null then null when given >= 0 then given else {rounded('km', 2)} end as distance_km,
     case when id is null then null else {rounded(f"(case when given >= 0 then given else {rounded('km', 2)} end) / 45.0", 2)} end as eta_hours,
     case when id is null then 'Unknown distribution center ID: ' || center_id end as error from found""",
)
def centre_resolution(t: Tables) -> DataFrame:
    """Centres named by id in any spelling, known or unknown, with or without a distance."""
    requests = t.telemetry.select(
        "event_id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"),
        F.concat(F.lit(" dc_"), F.lpad((F.col("event_id") % 1300).cast("string"), 5, "0")).alias("center_id"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 200).cast("double")).alias("distance_km"),
    )
    return routing.resolve_centres(requests, t.centre).select(
        "event_id", F.col("centre.id").alias("id"), "distance_km", "eta_hours", "error"
    )
