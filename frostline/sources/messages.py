"""Topic messages: decode, route, unnest, identify, normalise and publish.

A message is a row ``(topic, value)``, as a Kafka source or a folder of JSON
files gives it. All functions work on tables and on streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import blank_to_null, first_present, hours_to_failure, number, text_or, truth, unit

PREFIX = "coldchain"
OBJECT = "map<string,string>"
BATCH, TELEMETRY, PREDICTION, DECISION = "telemetry_batch", "telemetry", "prediction", "decision"
UNKNOWN_ASSET = "UNKNOWNASSET"
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

# Accepted spellings of each field, first match wins.
ASSET_FIELDS = ("asset_id", "assetid")
EXPLANATION_ASSET_FIELDS = ("assetid", "asset_id")
TIME_FIELDS = ("timestamp", "ts")
TELEMETRY_FIELDS = {
    "temperature": ("temperature", "currenttemp", "temp"),
    "humidity": ("humidity", "currenthumidity"),
    "vibration": ("vibration",),
    "gps_lat": ("gpslat", "gps_lat", "latitude"),
    "gps_lon": ("gpslon", "gps_lon", "longitude"),
}
EXPOSURE_FIELDS = {
    "temp_degree_minutes": ("tempdegreeminutes", "temp_degree_minutes"),
    "humidity_percent_minutes": ("humiditypercentminutes", "humidity_percent_minutes"),
    "door_open_minutes": ("dooropenminutes", "door_open_minutes"),
    "vibration_warn_minutes": ("vibrationwarnminutes", "vibration_warn_minutes"),
    "vibration_critical_minutes": ("vibrationcriticalminutes", "vibration_critical_minutes"),
    "out_of_range_minutes_in_hour": ("outofrangeminutesinhour", "out_of_range_minutes_in_hour"),
}
PREDICTED_FIELDS = ("predictedriskproxy", "predicted_risk_proxy", "riskscore", "risk_score", "riskproxy", "actualriskproxy")
ACTUAL_FIELDS = ("actualriskproxy", "actual_risk_proxy", "riskproxy")
FAILURE_FIELDS = (
    "timetofailurehours", "time_to_failure_hours", "timetofailure", "eta_to_failure_hours", "etatofailurehours",
)


def field(doc: str | Column, names: Sequence[str]) -> Column:
    """First non-null value of a JSON object among alias spellings, as text."""
    doc = doc if isinstance(doc, Column) else F.col(doc)
    return first_present([doc[n] for n in names])


def decode(messages: DataFrame) -> DataFrame:
    """Add ``doc``, the top-level fields as text; null when the value is not a JSON object.

    A message is decoded once: what is asked of ``doc`` later does not pass the generator, so it is not decoded again for each use.
    """
    looks_like_object = F.ltrim("value").startswith("{")
    return messages.withColumn("doc", F.explode(F.array(F.when(looks_like_object, F.from_json("value", OBJECT)))))


def quarantine(decoded: DataFrame) -> DataFrame:
    """Messages that could not be read."""
    return decoded.filter(F.col("doc").isNull()).select("topic", "value")


def route(decoded: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Kind of each readable message by topic; other topics are left out."""
    topic = F.trim("topic")
    kind = (
        F.when(topic == f"{prefix}/telemetry/all", BATCH)
        .when(topic.startswith(f"{prefix}/telemetry/"), TELEMETRY)
        .when(topic.startswith(f"{prefix}/predictions/"), PREDICTION)
        .when(topic.startswith(f"{prefix}/decisions/"), DECISION)
    )
    return decoded.filter(F.col("doc").isNotNull()).withColumn("kind", kind).filter(F.col("kind").isNotNull())


def unnest_batches(routed: DataFrame) -> DataFrame:
    """Readings as messages of their own, sent singly or in fleet messages; items that are no objects are skipped.

    Every message is decoded once: an item of a fleet message on the way out of its list, any other as it is.
    """
    batch = F.col("kind") == BATCH
    items = F.filter(F.from_json(F.col("doc")["batch"], "array<string>"), lambda x: F.ltrim(x).startswith("{"))
    docs = F.when(batch, F.transform(items, lambda x: F.from_json(x, OBJECT))).otherwise(F.array("doc"))
    rows = routed.filter(batch | (F.col("kind") == TELEMETRY)).withColumn("doc", F.explode(docs)).filter(F.col("doc").isNotNull())
    # The fleet topic names no asset, so an item must carry its own id.
    return rows.withColumns({"topic": F.when(batch, "").otherwise(F.col("topic")), "kind": F.lit(TELEMETRY)})


def asset_id(
    doc: str = "doc", topic: str = "topic", least_parts: int = 3, reject: str = "", names: Sequence[str] = ASSET_FIELDS
) -> Column:
    """Id from the document, else the last part of the topic; ``all`` is no id.

    ``names`` are looked at in order; the explanation service takes EXPLANATION_ASSET_FIELDS.

    ``least_parts`` is how deep the topic must be, ``reject`` lists characters
    that make a topic part a pattern instead of an id.
    """
    def usable(value: Column) -> Column:
        text = blank_to_null(value)
        return F.when(F.lower(text) != "all", text)

    parts = F.split(F.regexp_replace(topic, "^/+|/+$", ""), "/")
    last = usable(F.element_at(parts, -1))
    if reject:
        last = F.when(~last.rlike(f"[{reject}]"), last)
    document = F.col(doc)
    return F.coalesce(
        *[usable(document[n]) for n in names], F.when(F.size(parts) >= least_parts, last)
    )


def identified(messages: DataFrame, **options) -> DataFrame:
    """Messages with their asset; those without one are dropped."""
    return messages.withColumn("asset_id", asset_id(**options)).filter(F.col("asset_id").isNotNull())


def readings(messages: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """All readings of a message table, sent singly or in fleet messages."""
    return identified(unnest_batches(route(decode(messages), prefix)))


def timestamp(doc: str | Column = "doc") -> Column:
    return F.try_to_timestamp(field(doc, TIME_FIELDS))


def _texts(df: DataFrame, doc: str, fields: dict[str, Sequence[str]], prefix: str = "_") -> DataFrame:
    """The raw text of each field as a column of its own, so it is looked up once."""
    return df.withColumns({f"{prefix}{name}": field(doc, names) for name, names in fields.items()})


def _asset(df: DataFrame) -> Column:
    known = [F.col("asset_id")] if "asset_id" in df.columns else []
    return text_or(F.coalesce(*known, F.col("_asset")), UNKNOWN_ASSET).alias("asset_id")


def normalise_telemetry(df: DataFrame, doc: str = "doc") -> DataFrame:
    """One column per canonical field, with aliases, defaults and lower-case names."""
    raw = _texts(df, doc, {
        **TELEMETRY_FIELDS, "asset": ASSET_FIELDS, "time": TIME_FIELDS, "door": ("dooropen", "door_open"),
        "cargo": ("cargotype", "cargo_type"), "scenario": ("scenario",), "failed": ("refrigerationfailed", "refrigeration_failed"),
        "proxy": ("riskproxy", "risk_proxy", "telemetryriskproxy"), "exposure": ("cumulativeexposure", "cumulative_exposure"),
    })
    raw = _texts(raw.withColumn("_exposure", F.from_json("_exposure", OBJECT)), "_exposure", EXPOSURE_FIELDS, "_e_")
    return raw.select(
        *[c for c in df.columns if c not in (doc, "asset_id")],
        _asset(df),
        F.try_to_timestamp("_time").alias("ts"),
        *[number(f"_{name}").alias(name) for name in TELEMETRY_FIELDS],
        truth("_door").alias("door_open"),
        F.lower(text_or("_cargo", "unknown")).alias("cargo_type"),
        F.lower(text_or("_scenario", "unknown")).alias("scenario"),
        truth("_failed").alias("refrigeration_failed"),
        unit(number("_proxy")).alias("risk_proxy"),
        F.struct(*[number(f"_e_{name}").alias(name) for name in EXPOSURE_FIELDS]).alias("cumulative_exposure"),
    )


def normalise_prediction(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Predicted and actual risk, the one that counts, confidence and hours to failure."""
    raw = _texts(df, doc, {
        "asset": ASSET_FIELDS, "time": TIME_FIELDS, "predicted": PREDICTED_FIELDS, "actual": ACTUAL_FIELDS,
        "confidence": ("confidence", "predictionconfidence"), "hours": FAILURE_FIELDS,
        "temperature": ("currenttemp", "temperature"), "humidity": ("currenthumidity", "humidity"),
    })
    raw = raw.withColumns({
        "predicted_risk_proxy": unit(number("_predicted")), "actual_risk_proxy": unit(number("_actual")), "_hours": number("_hours", -1.0),
    })
    predicted, actual = F.col("predicted_risk_proxy"), F.col("actual_risk_proxy")
    return raw.select(
        *[c for c in df.columns if c not in (doc, "asset_id")],
        _asset(df),
        F.try_to_timestamp("_time").alias("ts"),
        predicted,
        actual,
        F.when(predicted > 0, predicted).otherwise(actual).alias("risk_score"),
        unit(number("_confidence")).alias("confidence"),
        # No value at all and an unreadable one both mean unknown.
        F.when(F.col("_hours") >= 0, F.col("_hours")).alias("time_to_failure_hours"),
        number("_temperature").alias("current_temp"),
        number("_humidity").alias("current_humidity"),
    )


ACTION_NAMES = {
    "type": ("type", "actiontype"),
    "description": ("description",),
    "priority": ("priority",),
    "tool": ("tool",),
    "action": ("action", "recommendedaction", "recommended_action"),
    "target_dc": ("targetdc", "target_dc"),
    "dc_name": ("dcname", "dc_name"),
}
ACTION_NUMBERS = {"eta_hours": ("etahours", "eta_hours"), "benefit_score": ("benefitscore", "benefit_score")}
ACTION_DEFAULTS = {"type": "unknown", "priority": "medium"}


def normalise_decision(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Analysis fields, the list of actions, what came of them, and the reading and prediction that go along.

    Entries of the lists that are no objects are dropped; ``telemetry_doc`` and ``prediction_doc`` are documents of their own, empty where there is none.
    """
    analysis, actions = F.col("_analysis"), F.from_json(F.col(doc)["actions"], "array<string>")
    objects = F.filter(actions, lambda a: F.ltrim(a).startswith("{"))

    # One step after another: what a step gives is made once for an action, however often the next step looks at it.
    def named(a: Column) -> Column:
        spelled = {**ACTION_NAMES, **ACTION_NUMBERS}
        return F.struct(*[field(a, spellings).alias(name) for name, spellings in spelled.items()])

    def one(raw: Column) -> Column:
        texts = {name: text_or(raw[name], ACTION_DEFAULTS.get(name, "")) for name in ACTION_NAMES}
        return F.struct(
            *[(F.lower(value) if name in ("type", "priority") else value).alias(name) for name, value in texts.items()],
            *[number(raw[name]).alias(name) for name in ACTION_NUMBERS],
        )

    listed = F.transform(F.transform(F.transform(objects, lambda text: F.from_json(text, OBJECT)), named), one)

    def hours(source: Column) -> Column:
        raw = number(field(source, FAILURE_FIELDS), default=-1.0)
        return F.when(raw >= 0, raw)

    factors = F.from_json(field(analysis, ("contributingfactors", "contributing_factors")), "array<string>")
    own = hours(analysis)
    keep = [c for c in df.columns if c not in (doc, "asset_id")]
    return df.withColumn("_analysis", F.from_json(F.col(doc)["analysis"], OBJECT)).select(
        *keep,
        text_or(field(doc, ("decisionid", "decision_id"))).alias("decision_id"),
        timestamp(doc).alias("ts"),
        text_or(F.coalesce(*([F.col("asset_id")] if "asset_id" in df.columns else []), field(doc, ASSET_FIELDS)), UNKNOWN_ASSET).alias("asset_id"),
        unit(number(field(analysis, ("riskscore", "risk_score", "predictedriskproxy", "riskproxy")))).alias("risk_score"),
        F.lower(text_or(field(analysis, ("risklevel", "risk_level")))).alias("risk_level"),
        F.coalesce(
            F.filter(F.transform(factors, lambda f: F.trim(f)), lambda f: f != ""), F.array().cast("array<string>")
        ).alias("contributing_factors"),
        # Zero hours in the analysis counts as missing.
        F.coalesce(F.when(own != 0, own), hours(F.col(doc))).alias("time_to_failure_hours"),
        truth(field(analysis, ("requiresaction", "requires_action"))).alias("requires_action"),
        F.lower(text_or(field(analysis, ("temperaturestatus", "temperature_status")))).alias("temperature_status"),
        F.coalesce(listed, F.array().cast(
            "array<struct<type:string,description:string,priority:string,tool:string,action:string,target_dc:string,"
            "dc_name:string,eta_hours:double,benefit_score:double>>")).alias("actions"),
        F.coalesce(
            F.filter(F.from_json(field(doc, ("executionresults", "execution_results")), "array<string>"), lambda r: F.ltrim(r).startswith("{")),
            F.array().cast("array<string>"),
        ).alias("execution_results"),
        *[F.coalesce(F.from_json(F.col(doc)[name], OBJECT), F.create_map().cast(OBJECT)).alias(f"{name}_doc") for name in ("telemetry", "prediction")],
    )


def cached_or_carried(decisions: DataFrame, telemetry: DataFrame, prediction: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, predictions), normalised, of decisions: the cached one of the asset, else the one that the decision carries.

    ``telemetry`` and ``prediction`` have ``decision_id`` and ``doc``; a decision that neither side knows has a document of defaults.
    """
    def one(cached: DataFrame, name: str, normalise) -> DataFrame:
        found = cached.select("decision_id", F.col("doc").alias("_cached"))
        joined = decisions.select("decision_id", "asset_id", F.col(f"{name}_doc").alias("_carried")).join(found, "decision_id", "left")
        return normalise(joined.select("decision_id", "asset_id", F.coalesce("_cached", "_carried").alias("doc"), F.col("_cached").isNotNull().alias("cached")))

    return one(telemetry, "telemetry", normalise_telemetry), one(prediction, "prediction", normalise_prediction)


def complete_prediction(df: DataFrame) -> DataFrame:
    """Fill ``risk_score``, ``predicted_risk_proxy`` and ``time_to_failure_hours`` of raw predictions where absent."""
    from ..functions.values import risk_score

    score, hours = risk_score(df.columns), hours_to_failure(df.columns)
    columns = {}
    for name, value in (("risk_score", score), ("predicted_risk_proxy", score), ("time_to_failure_hours", hours)):
        if name not in df.columns:
            columns[name] = value
    return df.withColumns(columns) if columns else df


def merged_asset(*names: str) -> Column:
    """First known asset id of the inputs."""
    known = [F.when(~F.col(n).isin("", UNKNOWN_ASSET), F.col(n)) for n in names]
    return F.coalesce(*known, F.lit(UNKNOWN_ASSET))


def topic_of(kind: str, asset: str = "asset_id", prefix: str = PREFIX) -> Column:
    return F.concat_ws("/", F.lit(prefix), F.lit(kind), F.col(asset))


def publish(df: DataFrame, kind: str, asset: str = "asset_id", prefix: str = PREFIX, metadata: Column | None = None) -> DataFrame:
    """Rows as messages: one JSON object per row on the topic of its asset, with the service's ``metadata`` if it is given."""
    extra = [] if metadata is None else [metadata.alias("ragservicemetadata")]
    return df.select(topic_of(kind, asset, prefix).alias("topic"), F.to_json(F.struct(*df.columns, *extra), JSON_OPTIONS).alias("value"))


def service_metadata(kind: str, service: str, ts: Column | str, asset: str = "asset_id", prefix: str = PREFIX) -> Column:
    """What a service says of itself in each message."""
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(service).alias("serviceid"), (F.col(ts) if isinstance(ts, str) else ts).alias("timestamp"),
        F.col(asset).alias("assetid"), F.lit(prefix).alias("mqttprefix"),
    )


def fleet_messages(
    readings_: DataFrame, tick: Column, publisher: str = "publisher-1", most: int = 10_000, prefix: str = PREFIX
) -> DataFrame:
    """All readings of each tick as fleet messages of about ``most`` readings.

    A tick of any size is spread over as many messages as it needs by a hash of
    the asset, so no task has to hold a whole tick.
    """
    marked = readings_.withColumn("_tick", tick)
    parts = marked.groupBy("_tick").agg(F.ceil(F.count("*") / F.lit(most)).alias("_parts"))
    spread = marked.join(parts, "_tick").withColumn("_part", F.pmod(F.xxhash64("asset_id", "ts"), F.col("_parts")))
    return (
        spread.groupBy("_tick", "_part")
        .agg(F.collect_list(F.struct(*readings_.columns)).alias("batch"))
        .select(
            F.lit(f"{prefix}/telemetry/all").alias("topic"),
            F.to_json(F.struct(F.lit(publisher).alias("publisher_id"), "batch"), JSON_OPTIONS).alias("value"),
        )
    )
