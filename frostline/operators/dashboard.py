"""Joined views of the latest state: live dashboard, prediction view, room alerts, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kept
from .latest import latest_by
from .risk import number_text, risk_summary, threshold_risk


def live_dashboard(readings: DataFrame, predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest reading with its risk and summary, latest prediction and latest decision of each asset."""
    shown = risk_summary(threshold_risk(latest_by(readings, ["asset_id"], ["ts", "event_id"])))
    predicted = latest_by(predictions, ["asset_id"], ["ts", "prediction_id"]).select(
        "asset_id", F.col("ts").alias("prediction_ts"), F.col("predicted_risk_proxy").alias("predicted_risk"), "time_to_failure_hours"
    )
    decided = latest_by(decisions, ["asset_id"], ["ts", "decision_id"]).withColumnRenamed("ts", "decision_ts")
    return shown.join(predicted, "asset_id", "left").join(decided, "asset_id", "left")


# Fixed value: the note for an asset without a prediction.
NO_PREDICTION = "No live prediction found in MongoDB for this shipment."


def prediction_view(assets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Latest prediction of every asset, with a note where there is none."""
    risk = [c for c in ("predicted_risk", "predicted_risk_proxy") if c in predictions.columns]
    newest = latest_by(predictions, ["asset_id"], ["ts", "prediction_id"]).select(
        "asset_id", F.coalesce(*risk).alias("predicted_risk"), "time_to_failure_hours", "ts", F.lit(True).alias("_found")
    )
    return assets.join(newest, "asset_id", "left").select(
        "asset_id", "predicted_risk", "time_to_failure_hours", "ts",
        F.when(F.col("_found").isNull(), NO_PREDICTION).alias("message"),
    )


def centre_view(alternatives: str = "alternatives", most: int = 3) -> Column:
    """The first centres offered, with the fields shown and their defaults."""
    shown = F.slice(F.coalesce(F.col(alternatives), F.array()), 1, most)
    return F.transform(
        shown,
        lambda c: F.struct(
            F.coalesce(c["id"], F.lit("")).alias("id"),
            F.coalesce(c["name"], F.lit("")).alias("name"),
            F.coalesce(c["distance_km"], F.lit(0.0)).alias("distance_km"),
            F.coalesce(c["eta_hours"], F.lit(0.0)).alias("eta_hours"),
            F.coalesce(c["available_capacity"], F.lit(0)).alias("available_capacity"),
            F.array(c["lat"], c["lon"]).alias("location"),
        ),
    )


def gauge_percent(value, low: float, high: float) -> Column:
    value = value if isinstance(value, Column) else F.col(value)
    return (value - low) / (high - low) * 100.0


def predicted_label(risk: str = "predicted_risk") -> Column:
    return F.when(F.col(risk).isNull(), "NOT AVAILABLE").when(F.col(risk) >= 0.5, "HIGH").otherwise("LOW")


# Alert types of a storage room with advice and severity.
ROOM_ALERTS = {
    "Temperature Too Low": (
        "Check cooling system settings. Reduce cooling power to bring temperature up to safe range.", "warning"),
    "Temperature Too High": (
        "Increase cooling power immediately. Check for door leaks or cooling system malfunction.", "critical"),
    "Humidity Too Low": (
        "Add humidifier or check ventilation system. Low humidity can affect product quality.", "warning"),
    "Humidity Too High": (
        "Check dehumidifier. High humidity can cause condensation and spoilage.", "warning"),
    "Door Open": (
        "Close door immediately to prevent temperature loss and maintain cold chain integrity.", "critical"),
    "Power Failure": (
        "Switch to backup power immediately. Contact maintenance team urgently.", "critical"),
}


def _bare(value: str) -> Column:
    """Number without a trailing ``.0``, as the room display writes it."""
    return F.regexp_replace(number_text(F.col(value)), r"\.0$", "")


def room_alerts(readings: DataFrame, rooms: DataFrame) -> DataFrame:
    """One row per alert of each room reading. The room table has five rows, so it is broadcast."""
    def outside(what: str, value: str, unit: str, low: str, high: str) -> Column:
        required = F.concat(
            F.lit(f"{unit} (Required: "), _bare(low), F.lit(f"{unit} – "), _bare(high), F.lit(f"{unit})"))
        return F.concat(F.lit(f"{what} is "), _bare(value), required)

    def entry(kind: str, text: Column) -> Column:
        advice, level = ROOM_ALERTS[kind]
        return F.struct(
            F.lit(kind).alias("type"), text.alias("message"), F.lit(advice).alias("precaution"), F.lit(level).alias("severity"))

    warm = outside("Temperature", "temperature", "°C", "temp_min", "temp_max")
    damp = outside("Humidity", "humidity", "%", "hum_min", "hum_max")
    t, h = F.col("temperature"), F.col("humidity")
    alerts = kept([
        F.when(t < F.col("temp_min"), entry("Temperature Too Low", warm))
        .when(t > F.col("temp_max"), entry("Temperature Too High", warm)),
        F.when(h < F.col("hum_min"), entry("Humidity Too Low", damp)).when(h > F.col("hum_max"), entry("Humidity Too High", damp)),
        F.when(F.col("door_status") == "Open", entry("Door Open", F.lit("Storage door is currently open"))),
        F.when(F.col("power_status") == "Failed", entry("Power Failure", F.lit("Power supply to cooling system has failed"))),
    ])
    joined = readings.join(F.broadcast(rooms), "room_id")
    return joined.select("event_id", "room_id", "room_name", "ts", F.posexplode(alerts).alias("place", "alert")).select(
        "event_id", "room_id", "room_name", "ts", "place", "alert.*"
    )
