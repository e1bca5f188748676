"""Fixed dimension tables: cargo profiles, rooms and default distribution centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The limits of each cargo type, in the order
# cargo type, band low, band high, humidity low, humidity high, door openings per hour, vibration warning,
# vibration critical, allowed minutes out of range per hour, hard low, hard high, freeze sensitive, freeze point.
CARGO_PROFILES = [
    ("vaccines", 2.0, 8.0, 30.0, 60.0, 3, 2.5, 5.0, 10.0, 0.0, 12.0, True, 0.0),
    ("meat", -1.0, 4.0, 85.0, 95.0, 2, 3.0, 6.0, 12.0, -5.0, 8.0, False, 0.0),
    ("dairy", 1.0, 7.0, 70.0, 85.0, 3, 3.0, 6.5, 12.0, -1.0, 12.0, False, 0.0),
    ("pharmaceuticals", 15.0, 25.0, 40.0, 60.0, 4, 2.0, 4.5, 15.0, 10.0, 35.0, False, 0.0),
    ("frozen_food", -25.0, -15.0, 60.0, 95.0, 2, 3.5, 7.0, 8.0, -35.0, -5.0, False, 0.0),
    ("produce", 2.0, 10.0, 80.0, 95.0, 4, 3.0, 6.0, 15.0, 0.0, 18.0, False, 0.0),
    ("seafood", -2.0, 2.0, 85.0, 95.0, 2, 3.0, 6.0, 10.0, -6.0, 6.0, False, 0.0),
    ("ice_cream", -30.0, -18.0, 50.0, 90.0, 2, 3.5, 7.0, 6.0, -40.0, -10.0, False, 0.0),
    ("blood_plasma", 2.0, 6.0, 30.0, 60.0, 2, 2.0, 4.0, 8.0, 0.0, 10.0, True, 0.0),
    ("flowers", 2.0, 8.0, 85.0, 95.0, 4, 3.0, 6.0, 15.0, 0.0, 14.0, False, 0.0),
]
PROFILE_SCHEMA = (
    "profile_cargo string, band_low double, band_high double, humidity_low double, humidity_high double, "
    "doors_per_hour int, vibration_warn double, vibration_critical double, allowed_minutes double, "
    "hard_low double, hard_high double, freeze_sensitive boolean, freeze_c double"
)
CARGO_TYPES = [row[0] for row in CARGO_PROFILES]

# The band assumed for cargo without a profile.
UNKNOWN_BAND = (2.0, 8.0)

# Storage rooms with their temperature and humidity bands.
ROOMS = [
    (1, "Vaccine Storage Room", 2.0, 8.0, 30.0, 50.0),
    (2, "Pharmaceutical Drug Storage", 8.0, 15.0, 40.0, 60.0),
    (3, "Blood & Plasma Storage", 1.0, 6.0, 35.0, 55.0),
    (4, "Dairy Product Storage", 2.0, 4.0, 40.0, 60.0),
    (5, "Frozen Food Storage", -20.0, -18.0, 30.0, 40.0),
]
ROOM_SCHEMA = "room_id int, room_name string, temp_min double, temp_max double, hum_min double, hum_max double"

# The default distribution centres, in the order
# id, name, lat, lon, capacity, load, status, supported cargo, priority.
CENTRES = [
    ("DC_AGRA", "Agra Distribution Center", 27.1767, 78.0081, 80, 38, "operational", CARGO_TYPES, 1),
    ("DC_MATHURA", "Mathura Cold Hub", 27.4924, 77.6737, 60, 21, "operational",
     ["vaccines", "dairy", "produce", "flowers", "blood_plasma", "pharmaceuticals"], 1),
    ("DC_FIROZABAD", "Firozabad Transit Facility", 27.1591, 78.3957, 45, 17, "operational",
     ["vaccines", "dairy", "produce", "pharmaceuticals", "flowers"], 2),
    ("DC_DELHI", "Delhi Compliance Center", 28.7041, 77.1025, 120, 66, "operational", CARGO_TYPES, 1),
    ("DC_NOIDA", "Noida Pharma and Foods Hub", 28.5355, 77.3910, 90, 44, "operational",
     ["vaccines", "dairy", "pharmaceuticals", "produce", "blood_plasma", "flowers", "seafood"], 1),
    ("DC_KANPUR", "Kanpur Refrigerated Logistics Hub", 26.4499, 80.3319, 85, 49, "operational",
     ["meat", "dairy", "frozen_food", "produce", "seafood", "ice_cream", "pharmaceuticals"], 1),
    ("DC_GURUGRAM", "Gurugram Rapid Response Center", 28.4595, 77.0266, 70, 28, "operational",
     ["vaccines", "dairy", "pharmaceuticals", "blood_plasma", "produce", "flowers"], 1),
]
CENTRE_SCHEMA = (
    "id string, name string, lat double, lon double, capacity int, current_load int, "
    "refrigeration_status string, supported_cargo_types array<string>, priority_rank int"
)

# The planned routes between the default centres, as way points (lat, lon).
ROUTES = {
    "agra_delhi": [(27.1767, 78.0081), (27.4924, 77.6737), (28.7041, 77.1025)],
    "mathura_noida": [(27.4924, 77.6737), (28.5355, 77.3910)],
    "agra_kanpur": [(27.1767, 78.0081), (27.8974, 78.0880), (26.4499, 80.3319)],
    "delhi_gurgaon": [(28.7041, 77.1025), (28.4595, 77.0266)],
}
ROUTE_SCHEMA = "route string, seq int, lat double, lon double"


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_literal(v) for v in value)})"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "null" if value is None else str(value)


def constant_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A fixed table as an inline relation: no job, exact size known to the optimizer."""
    fields = [part.strip().split(" ", 1) for part in schema.split(", ")]
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    types = ", ".join(f"cast({name} as {kind}) as {name}" for name, kind in fields)
    return spark.sql(f"select {types} from values {body} as t({names})")


def cargo_profiles(spark: SparkSession) -> DataFrame:
    """Ten rows; small by definition, so it may be broadcast."""
    return constant_table(spark, CARGO_PROFILES, PROFILE_SCHEMA)


def rooms(spark: SparkSession) -> DataFrame:
    """Five rows; small by definition, so it may be broadcast."""
    return constant_table(spark, ROOMS, ROOM_SCHEMA)


def default_centres(spark: SparkSession) -> DataFrame:
    return constant_table(spark, CENTRES, CENTRE_SCHEMA)


def default_routes(spark: SparkSession) -> DataFrame:
    points = [(r, i, lat, lon) for r, path in ROUTES.items() for i, (lat, lon) in enumerate(path)]
    return constant_table(spark, points, ROUTE_SCHEMA)
