"""The k nearest eligible distribution centres of each reading.

No reading is paired with all centres. Points on the globe get cells of a
nested grid over their 3-d position in km (cells of 400 km, halved ten times),
which has no poles and no date line. For every cell that holds readings the
finest level is taken whose 3x3x3 block of cells has at least k centres. The
k-th centre is then no further than the block's diagonal from its middle cell,
2*sqrt(3) cells, so the block two levels up, which reaches 4 cells in every
direction, holds all answers; of its centres only those within the bound of the
middle cell are compared. The sizes of the cell tables depend on the area covered, not on the
number of readings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import EARTH_RADIUS_KM, haversine_km, round_to
from ..functions.values import as_column, lower_name
from ..session import materialise

LEVELS = 10
# Cells of the coarsest level; wider where the radius is, so that a block of 27 always reaches it.
COARSE_KM = 400.0
BITS = 15
RADIUS_KM = 350.0
SPEED_KMPH = 45.0

# Spots of a cell that one task compares.
CROWD = 20_000

# Distances are ranked in hundredths of a km; twice that step covers equal ranks.
ROUNDING_KM = 0.02

# A reading without a cargo type may go to any centre.
ANY_CARGO = ""

CENTRE_FIELDS = (
    "id", "name", "lat", "lon", "capacity", "current_load", "available_capacity",
    "refrigeration_status", "supported_cargo_types", "priority_rank",
)


def available_capacity() -> Column:
    return F.greatest(F.col("capacity") - F.col("current_load"), F.lit(0))


def without(centres: DataFrame, excluded: DataFrame, column: str = "id") -> DataFrame:
    """Centres whose id is not in the list, ids compared trimmed and upper-case."""
    keys = excluded.select(F.upper(F.trim(column)).alias("_excluded")).distinct()
    return centres.join(keys, F.upper(F.trim("id")) == F.col("_excluded"), "left_anti")


def eligible(centres: DataFrame, min_available: int = 1, require_operational: bool = True) -> DataFrame:
    """Centres with room and working refrigeration, filtered before any distance is computed."""
    open_ = centres.withColumn("available_capacity", available_capacity()).filter(F.col("available_capacity") >= min_available)
    if require_operational:
        open_ = open_.filter(F.lower(F.trim("refrigeration_status")) == "operational")
    return open_


def _position(lat: str, lon: str) -> dict[str, Column]:
    """Point on the globe in km from its middle."""
    la, lo = F.radians(as_column(lat)), F.radians(as_column(lon))
    r = F.lit(EARTH_RADIUS_KM)
    return {"_px": r * F.cos(la) * F.cos(lo), "_py": r * F.cos(la) * F.sin(lo), "_pz": r * F.sin(la)}


def coarse_km(radius_km: float) -> float:
    """Cell width of the coarsest level for a radius."""
    return COARSE_KM * 2 ** max(0, math.ceil(math.log2(max(radius_km, 1.0) / COARSE_KM)))


def _fine_cell(coarse: float) -> dict[str, Column]:
    return {
        cell: F.floor((F.col(point) + 6400.0) / (coarse / 2**LEVELS)).cast("bigint")
        for cell, point in (("_x", "_px"), ("_y", "_py"), ("_z", "_pz"))
    }


def _chord_squared(prefix: str = "centre_") -> Column:
    """Squared straight-line distance between reading and centre."""
    steps = [F.col(axis) - F.col(f"{prefix}{axis}") for axis in ("_px", "_py", "_pz")]
    return steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]


def _ancestor(axis: str, level: Column) -> Column:
    return F.call_function("shiftright", F.col(axis), (F.lit(LEVELS) - level).cast("int"))


def _cell(level: Column) -> Column:
    """One number for the cell of a level that holds a finest cell."""
    side = F.lit(2**BITS).cast("bigint")
    x, y, z = (_ancestor(axis, level) for axis in ("_x", "_y", "_z"))
    return ((level.cast("bigint") * side + x) * side + y) * side + z


def _neighbours(cell: Column) -> Column:
    """The cell and its 26 neighbours; steps beyond the grid give numbers no cell has."""
    side = 2**BITS
    steps = [(dx * side + dy) * side + dz for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]
    return F.explode(F.array(*[cell + F.lit(s).cast("bigint") for s in steps]))


def _levels() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))


def _centre_points(centres: DataFrame, k: int, coarse: float) -> DataFrame:
    """Centres per cargo type with their finest cell.

    Of centres at one point only the best k can be among the k nearest of
    anything, so a crowded point does not grow the search. Centres move once, before they are repeated for their cargo types.
    """
    kinds = F.array_distinct(F.concat(F.col("supported_cargo_types"), F.array(F.lit(ANY_CARGO))))
    per_cargo = centres.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).repartition("lat", "lon").select(
        F.explode(kinds).alias("_cargo"), F.struct(*CENTRE_FIELDS).alias("centre"), "lat", "lon"
    )
    same_point = W.partitionBy("_cargo", "lat", "lon").orderBy(
        F.desc("centre.available_capacity"), "centre.priority_rank", "centre.id"
    )
    return (
        per_cargo.withColumn("_n", F.row_number().over(same_point)).filter(F.col("_n") <= k)
        .withColumns(_position("lat", "lon")).withColumns(_fine_cell(coarse))
        .select("_cargo", "centre", "_px", "_py", "_pz", "_x", "_y", "_z")
    )


def _search_cells(cells: DataFrame, points: DataFrame, k: int, coarse: float) -> DataFrame:
    """For each finest cell with readings, the cell that decides its candidates and how far those can be."""
    fine = points.groupBy("_cargo", "_x", "_y", "_z").agg(F.count("*").alias("_n"))
    by_level = fine.select("_cargo", "_x", "_y", "_z", "_n", _levels().alias("_level")).select(
        "_cargo", _cell(F.col("_level")).alias("_cell"), "_n"
    )
    around = (
        by_level.groupBy("_cargo", "_cell").agg(F.sum("_n").alias("_n"))
        .select("_cargo", _neighbours(F.col("_cell")).alias("_cell"), "_n")
    )
    enough = around.groupBy("_cargo", "_cell").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k).select("_cargo", "_cell")
    candidates = cells.select("_cargo", "_x", "_y", "_z", _levels().alias("_level")).withColumn("_cell", _cell(F.col("_level")))
    finest = (
        candidates.join(enough, ["_cargo", "_cell"], "left_semi")
        .groupBy("_cargo", "_x", "_y", "_z").agg(F.max("_level").alias("_level"))
    )
    own = F.coalesce("_level", F.lit(0))
    above = F.greatest(own - 2, F.lit(0))
    size = F.lit(coarse) / F.pow(F.lit(2.0), own)
    # The diagonal of the block, and a little for distances that only differ after rounding.
    bound = F.when(F.col("_level").isNotNull(), F.lit(2 * math.sqrt(3.0)) * size + F.lit(ROUNDING_KM))
    return cells.join(finest, ["_cargo", "_x", "_y", "_z"], "left").select(
        "_cargo", "_x", "_y", "_z", _cell(own).alias("_own"), _cell(above).alias("_search"),
        F.coalesce(bound, F.lit(4 * EARTH_RADIUS_KM)).alias("_bound"), size.alias("_size"),
        *[(_ancestor(axis, own) * size - 6400.0).alias(f"_low{axis}") for axis in ("_x", "_y", "_z")],
    )


def _outside_squared() -> Column:
    """Squared distance from a centre to the nearest point of a cell."""
    total = F.lit(0.0)
    for low, axis in (("_low_x", "_px"), ("_low_y", "_py"), ("_low_z", "_pz")):
        at = F.col(f"centre_{axis}")
        step = F.greatest(F.col(low) - at, at - (F.col(low) + F.col("_size")), F.lit(0.0))
        total = total + step * step
    return total


def nearest_centres(
    readings: DataFrame,
    centres: DataFrame,
    keys: Sequence[str],
    k: int = 3,
    radius_km: float = RADIUS_KM,
    lat: str = "gps_lat",
    lon: str = "gps_lon",
    cargo: str = "cargo_type",
) -> DataFrame:
    """Up to k centres per reading, as rows ``keys``, ``rank``, ``distance_km``, ``centre``.

    Order: distance in hundredths of a km, free capacity (most first), priority, id.
    Readings without a position and readings with no centre in reach have no rows.
    """
    placed = readings.filter(as_column(lat).isNotNull() & as_column(lon).isNotNull()).select(*keys, *[c for c in (lat, lon, cargo) if c not in keys])
    near = with_nearest(placed, centres, k, radius_km, lat, lon, cargo)
    return near.select(*keys, F.explode("nearest").alias("_b")).select(*keys, "_b.rank", "_b.distance_km", "_b.centre")


def with_nearest(
    readings: DataFrame,
    centres: DataFrame,
    k: int = 3,
    radius_km: float = RADIUS_KM,
    lat: str = "gps_lat",
    lon: str = "gps_lon",
    cargo: str = "cargo_type",
) -> DataFrame:
    """The readings with ``nearest``, the list of up to k structs ``rank``, ``distance_km``, ``centre``, nearest first; null where there is none.

    A reading moves once, as it is, to the answer of its spot, so nothing has to be joined to it by its keys.
    """
    coarse = coarse_km(radius_km)
    spot = ["_cargo", "_lat", "_lon"]
    at_spot = readings.withColumns({"_lat": as_column(lat), "_lon": as_column(lon), "_cargo": F.coalesce(lower_name(cargo), F.lit(ANY_CARGO))})
    # Readings at one spot have the same answer: each spot is searched once, however many stand there.
    places = materialise(at_spot.select(*spot).filter(F.col("_lat").isNotNull() & F.col("_lon").isNotNull()).distinct().withColumns(_position("_lat", "_lon")).withColumns(_fine_cell(coarse)), "spots")
    cells = places.select("_cargo", "_x", "_y", "_z").distinct()
    # Both tables are small next to the readings and read more than once below.
    points = materialise(_centre_points(centres, k, coarse), "centre-points")
    search = materialise(_search_cells(cells, points, k, coarse), "search-cells")
    # A cell with very many spots is dealt to several tasks: the cell's rows are repeated for each.
    crowd = places.groupBy("_cargo", "_x", "_y", "_z").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("_salts"))
    search = search.join(crowd, ["_cargo", "_x", "_y", "_z"])
    salted = search.select("*", F.explode(F.expr("sequence(0, _salts - 1)")).alias("_salt"))
    most = search.groupBy("_cargo", "_own").agg(F.max("_salts").alias("_salts"))
    places = places.join(crowd, ["_cargo", "_x", "_y", "_z"]).withColumn("_salt", F.pmod(F.xxhash64("_lat", "_lon"), F.col("_salts")).cast("int"))

    low = ["_low_x", "_low_y", "_low_z"]
    reach = search.select("_cargo", "_own", "_search", "_bound", "_size", *low).distinct().select(
        "_cargo", "_own", "_bound", "_size", *low, _neighbours(F.col("_search")).alias("_cell")
    )
    at = [F.col(axis).alias(f"centre_{axis}") for axis in ("_px", "_py", "_pz")]
    at_level = points.select("_cargo", "centre", *at, "_x", "_y", "_z", _levels().alias("_level")).select(
        "_cargo", "centre", "centre__px", "centre__py", "centre__pz", _cell(F.col("_level")).alias("_cell")
    )
    candidates = (
        reach.join(at_level, ["_cargo", "_cell"]).filter(_outside_squared() <= F.col("_bound") * F.col("_bound"))
        .select("_cargo", "_own", "centre", "centre__px", "centre__py", "centre__pz")
        .join(most, ["_cargo", "_own"]).withColumn("_salt", F.explode(F.expr("sequence(0, _salts - 1)"))).drop("_salts")
    )

    found = (
        places.drop("_salts").join(salted.select("_cargo", "_x", "_y", "_z", "_salt", "_own", "_bound"), ["_cargo", "_x", "_y", "_z", "_salt"])
        .join(candidates, ["_cargo", "_own", "_salt"])
        .filter(_chord_squared() <= F.col("_bound") * F.col("_bound"))
        .withColumn("_km", haversine_km("_lat", "_lon", "centre.lat", "centre.lon"))
        .filter(F.col("_km") <= radius_km)
        .withColumn("distance_km", round_to("_km", 2))
    )
    best = W.partitionBy(*spot).orderBy(
        "distance_km", F.desc("centre.available_capacity"), "centre.priority_rank", "centre.id"
    )
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    answers = ranked.groupBy(*spot).agg(F.sort_array(F.collect_list(F.struct("rank", "distance_km", "centre"))).alias("nearest"))
    # A spot with a third of the readings is one row on the right; Spark splits the left side of such a join.
    return at_spot.join(answers, spot, "left").select(*readings.columns, "nearest")


def eta_hours(distance_km, speed_kmph=SPEED_KMPH) -> Column:
    speed = speed_kmph if isinstance(speed_kmph, Column) else F.lit(float(speed_kmph))
    return round_to(as_column(distance_km) / F.greatest(F.lit(1.0), speed), 2)


def travel_speed(scenario: Column, failed: Column, usual: float = SPEED_KMPH) -> Column:
    """40 km/h with failing refrigeration, 45 in the regular scenarios, else the usual speed."""
    return (
        F.when(failed | (scenario == "refrigeration_failure"), 40.0)
        .when(scenario.isin("normal", "micro_excursions"), 45.0)
        .otherwise(float(usual))
    )
