"""Reroute benefit and recommendation, centre resolution, position on a route."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import haversine_km, lerp, plain, round_to
from ..functions.text import kept
from ..functions.values import clamp, lower_name, number, truth
from . import nearest

CASE_KEYS = ("asset_id", "prediction_id")


def _case(usual_speed: float) -> dict[str, Column]:
    """What the offers of a case share."""
    scenario, failed = F.coalesce(lower_name("scenario"), F.lit("")), truth("refrigeration_failed")
    return {
        "travel_speed": nearest.travel_speed(scenario, failed, usual_speed),
        "_cargo": lower_name("cargo_type"),
        "_bonus": F.when(failed, 0.10).otherwise(0.0) + F.when(scenario == "refrigeration_failure", 0.08).otherwise(0.0),
    }


Field = Callable[[str], Column]
Step = Callable[[Field], dict[str, Column]]


def _steps(radius_km: float) -> list[Step]:
    """What is added to an offer, one step after another; ``of`` gives a field of the offer or a column of its case."""
    def timed(of: Field) -> dict[str, Column]:
        return {"eta_hours": nearest.eta_hours(of("distance_km"), of("travel_speed"))}

    def suited(of: Field) -> dict[str, Column]:
        hours, cargo, centre = of("time_to_failure_hours"), of("_cargo"), of("centre")
        return {
            "eta_buffer_hours": F.when(hours.isNotNull(), round_to(hours - of("eta_hours"), 2)),
            "can_arrive_before_failure": F.when(hours.isNotNull(), of("eta_hours") <= hours),
            "compatible_for_cargo": cargo.isNull() | F.exists(centre["supported_cargo_types"], lambda c: F.lower(F.trim(c)) == cargo),
            "_operational": F.lower(F.trim(centre["refrigeration_status"])) == "operational",
        }

    def scored(of: Field) -> dict[str, Column]:
        risk, hours, km = of("combined_score"), of("time_to_failure_hours"), of("distance_km")
        free, capacity = of("centre")["available_capacity"], F.greatest(of("centre")["capacity"], F.lit(0))
        compatible, operational = of("compatible_for_cargo"), of("_operational")
        viability = F.when(hours.isNull(), 0.5).otherwise(clamp((of("eta_buffer_hours") + 2.0) / 4.0, 0.0, 1.0))
        bonus = of("_bonus") + F.when((risk >= 0.80) & (km <= 60.0), 0.05).otherwise(0.0) + F.when(risk >= 0.70, 0.03).otherwise(0.0)
        score = F.lit(100.0) * (
            F.lit(0.30) * viability
            + F.lit(0.25) * (F.lit(1.0) - clamp(km / radius_km, 0.0, 1.0))
            + F.lit(0.20) * F.when(capacity > 0, free / capacity).otherwise(0.0)
            + F.lit(0.15) * F.when(operational, 1.0).otherwise(0.0)
            + F.lit(0.10) * F.when(compatible, 1.0).otherwise(0.0)
            + bonus
        )
        feasible = compatible & operational & (free > 0) & ~_too_late(of)
        return {"_score": F.when(feasible, clamp(score, 0.0, 100.0)).otherwise(0.0)}

    def rounded(of: Field) -> dict[str, Column]:
        return {"benefit_score": round_to(of("_score"), 2)}

    return [timed, suited, scored, rounded]


def _too_late(of: Field) -> Column:
    return F.coalesce(~of("can_arrive_before_failure"), F.lit(False))


def _rationale(of: Field) -> Column:
    """Why an offer is as good as it is."""
    compatible, operational, too_late = of("compatible_for_cargo"), of("_operational"), _too_late(of)
    free, capacity = of("centre")["available_capacity"], F.greatest(of("centre")["capacity"], F.lit(0))
    buffer = of("eta_buffer_hours")
    return kept([
        F.when(compatible, "Center supports this cargo type").otherwise("Center does not support this cargo type"),
        F.when(operational, "Refrigeration is operational").otherwise("Refrigeration is not operational"),
        F.when(free > 0, F.format_string("Available capacity: %d/%d", free, capacity)).otherwise("No available capacity"),
        F.concat(F.lit("ETA to center: "), plain(of("eta_hours"), 2), F.lit(" hours")),
        F.concat(F.lit("Distance to center: "), plain(of("distance_km"), 2), F.lit(" km")),
        F.when(of("can_arrive_before_failure"),
               F.concat(F.lit("Arrival is ahead of failure window by "), plain(buffer, 2), F.lit(" hours")))
        .when(too_late, F.concat(F.lit("ETA exceeds failure window by "), plain(F.abs(buffer), 2), F.lit(" hours"))),
        F.concat(F.lit("Assumed travel speed: "), plain(of("travel_speed"), 2), F.lit(" km/h")),
        F.when(too_late, "Center cannot be reached before the predicted failure window"),
    ])


def benefit(offers: DataFrame, radius_km: float = nearest.RADIUS_KM, usual_speed: float = nearest.SPEED_KMPH) -> DataFrame:
    """Score 0..100 of every case and centre, with feasibility and rationale.

    Expects the case columns, ``distance_km`` and the struct ``centre``.
    """
    out = offers.withColumns(_case(usual_speed))
    for step in _steps(radius_km):
        out = out.withColumns(step(F.col))
    return out.withColumn("benefit_rationale", _rationale(F.col)).drop("_cargo", "_bonus", "_score", "_operational")


DC_FIELDS = ("distance_km", "eta_hours", "compatible_for_cargo", "can_arrive_before_failure", "eta_buffer_hours", "benefit_score")


def _offers(near: Column, radius_km: float) -> tuple[Column, list[str]]:
    """The nearest centres of a case, scored in its row, and the fields they have."""
    offers, fields = near, ["distance_km", "centre"]
    for step in _steps(radius_km):
        offers = F.transform(offers, _taking(step, tuple(fields)))
        fields += step(F.col)
    return offers, fields


def _taking(step: Step, fields: Sequence[str]) -> Callable[[Column], Column]:
    """An offer after one more step."""
    return lambda o: F.struct(*[o[f].alias(f) for f in fields], *[c.alias(n) for n, c in step(_of(o, fields)).items()])


def _of(offer: Column, fields: Sequence[str]) -> Field:
    return lambda name: offer[name] if name in fields else F.col(name)


def _ranking(o: Column) -> Column:
    """An offer under ``offer``; fields in ranking order first, so sorting the structs ranks the offers."""
    return F.struct(
        (-o["benefit_score"]).alias("by_score"),
        o["distance_km"].alias("by_distance"),
        (-o["centre"]["available_capacity"]).alias("by_capacity"),
        o["centre"]["id"].alias("by_id"),
        o.alias("offer"),
    )


def _described(fields: Sequence[str]) -> Callable[[Column], Column]:
    """A ranked offer as it is shown."""
    def one(r: Column) -> Column:
        o = r["offer"]
        return F.struct(
            *[o["centre"][f].alias(f) for f in nearest.CENTRE_FIELDS], *[o[f].alias(f) for f in DC_FIELDS], _rationale(_of(o, fields)).alias("rationale")
        )

    return one


def offers_considered(results: int | Column) -> int | Column:
    """Centres scored for a wanted number of results: twice as many, at least three."""
    if isinstance(results, int):
        return max(3, results * 2)
    return F.greatest(F.lit(3), results * 2)


def with_recommended(
    cases: DataFrame, centres: DataFrame, results: Column, most: int = 3, radius_km: float = nearest.RADIUS_KM, usual_speed: float = nearest.SPEED_KMPH
) -> DataFrame:
    """The cases with ``alternatives``, their best centres, and ``recommended_dc``; null where no centre is in reach.

    ``results`` is the number of alternatives of a case, at most ``most``. The nearest centres are scored, the best of them kept and described;
    the first is recommended if its score is above 0. At most ``offers_considered(most)`` offers are one list in the row of their case:
    a case moves once, to its spot, and its offers never.
    """
    near = nearest.with_nearest(cases, nearest.eligible(centres), offers_considered(most), radius_km)
    considered = near.withColumns({"_results": results, **_case(usual_speed)})
    offers, fields = _offers(F.slice("nearest", F.lit(1), offers_considered(F.col("_results"))), radius_km)
    ranked = considered.withColumn("_ranked", F.slice(F.sort_array(F.transform(offers, _ranking)), F.lit(1), F.col("_results")))
    best = F.get(F.col("alternatives"), F.lit(0))
    return (
        ranked.withColumn("alternatives", F.transform("_ranked", _described(fields)))
        .withColumn("recommended_dc", F.when(best["benefit_score"] > 0, best))
        .select(*cases.columns, "alternatives", "recommended_dc")
    )


def recommend(
    cases: DataFrame,
    centres: DataFrame,
    results: Column,
    most: int = 3,
    keys: Sequence[str] = CASE_KEYS,
    radius_km: float = nearest.RADIUS_KM,
) -> DataFrame:
    """Best centres per case that has one in reach: ``keys``, ``alternatives`` and ``recommended_dc``."""
    found = with_recommended(cases, centres, results, most, radius_km).filter(F.col("alternatives").isNotNull())
    return found.select(*keys, "alternatives", "recommended_dc")


# What a centre description without a known id is filled with.
CENTRE_DEFAULTS = {"id": "UNKNOWN_DC", "name": "Unknown Center", "refrigeration_status": "unknown", "priority_rank": 99}


def resolve_centres(requests: DataFrame, centres: DataFrame, usual_speed: float = nearest.SPEED_KMPH) -> DataFrame:
    """Centre for each request by id; a given distance is kept, a missing one computed.

    Requests have ``center_id``, ``distance_km`` and the position ``lat``, ``lon``
    of the vehicle. ``error`` names ids that no centre has.
    """
    known = centres.select(
        F.upper("id").alias("_id"),
        F.struct(*[c if c != "available_capacity" else nearest.available_capacity().alias(c) for c in nearest.CENTRE_FIELDS]).alias("centre"),
    )
    given = number(F.col("distance_km"), default=-1.0)
    computed = haversine_km("lat", "lon", "centre.lat", "centre.lon")
    distance = F.when(given >= 0, given).otherwise(F.coalesce(computed, F.lit(0.0)))
    return (
        requests.join(known, F.upper(F.trim(F.col("center_id"))) == F.col("_id"), "left")
        .withColumn("distance_km", F.when(F.col("centre").isNotNull(), round_to(distance, 2)))
        .withColumn("eta_hours", nearest.eta_hours("distance_km", usual_speed))
        .withColumn(
            "error",
            F.when(F.col("centre").isNull(), F.concat(F.lit("Unknown distribution center ID: "), F.col("center_id"))),
        )
        .drop("_id")
    )


def describe_centre(requests: DataFrame) -> DataFrame:
    """Free-form centre descriptions (all fields text) with defaults for what is missing."""
    def whole(c: str, default: int) -> Column:
        return number(F.col(c), float(default)).cast("int")

    distance = number(F.col("distance_km"))
    return requests.select(
        F.coalesce("id", F.lit(CENTRE_DEFAULTS["id"])).alias("id"),
        F.coalesce("name", F.lit(CENTRE_DEFAULTS["name"])).alias("name"),
        round_to(number(F.col("lat")), 6).alias("lat"),
        round_to(number(F.col("lon")), 6).alias("lon"),
        round_to(distance, 2).alias("distance_km"),
        round_to(F.coalesce(number(F.col("eta_hours"), None), nearest.eta_hours(distance)), 2).alias("eta_hours"),
        whole("capacity", 0).alias("capacity"),
        whole("current_load", 0).alias("current_load"),
        whole("available_capacity", 0).alias("available_capacity"),
        F.coalesce("refrigeration_status", F.lit(CENTRE_DEFAULTS["refrigeration_status"])).alias("refrigeration_status"),
        whole("priority_rank", CENTRE_DEFAULTS["priority_rank"]).alias("priority_rank"),
    )


# A route segment counts as at least a metre long.
SHORTEST_SEGMENT_KM = 0.001


def route_segments(routes: DataFrame) -> DataFrame:
    """Segments between way points with the distance driven at their start and end."""
    along = W.partitionBy("route").orderBy("seq")
    legs = (
        routes.withColumns({"to_lat": F.lead("lat").over(along), "to_lon": F.lead("lon").over(along)})
        .filter(F.col("to_lat").isNotNull())
        .withColumn("length_km", F.greatest(F.lit(SHORTEST_SEGMENT_KM), haversine_km("lat", "lon", "to_lat", "to_lon")))
    )
    return (
        legs.withColumn("end_km", F.sum("length_km").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("start_km", F.coalesce(F.lag("end_km").over(along), F.lit(0.0)))
        .withColumn("last", F.lead("seq").over(along).isNull())
    )


def route_position(driven: DataFrame, routes: DataFrame, distance: str = "driven_km") -> DataFrame:
    """Position after a driven distance: ``lat``, ``lon`` and ``arrived``.

    Routes are way point lists of a few rows each, so a vehicle meets only the
    segments of its own route.
    """
    segments = route_segments(routes).select(
        F.col("route").alias("_route"), "start_km", "end_km", "length_km", "last",
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "to_lat", "to_lon",
    )
    d = F.col(distance)
    on = (F.col("route") == F.col("_route")) & (
        ((d >= F.col("start_km")) & (d < F.col("end_km")))
        | (F.col("last") & (d >= F.col("end_km")))
        | ((d < 0) & (F.col("start_km") <= 0))
    )
    share = F.greatest(F.lit(0.0), (d - F.col("start_km")) / F.col("length_km"))
    return (
        driven.join(segments, on)
        .withColumn("arrived", F.col("last") & (d >= F.col("end_km")))
        .withColumns(
            {
                "lat": F.when(F.col("arrived"), F.col("to_lat")).otherwise(lerp("_lat", "to_lat", share)),
                "lon": F.when(F.col("arrived"), F.col("to_lon")).otherwise(lerp("_lon", "to_lon", share)),
            }
        )
        .select(*driven.columns, "lat", "lon", "arrived")
    )
