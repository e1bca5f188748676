"""Value parsing and normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that count as true.
TRUE_WORDS = ("1", "true", "yes", "y", "on")

# Accepted spellings of the prediction fields, first match wins.
RISK_FIELDS = ("predicted_risk_proxy", "risk_score", "riskscore", "risk_proxy", "actual_risk_proxy")
TIME_TO_FAILURE_FIELDS = (
    "time_to_failure_hours",
    "time_to_failure",
    "timetofailurehours",
    "timetofailure",
    "eta_to_failure_hours",
)

def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def number(value, default: float | None = 0.0) -> Column:
    """Text to double; null or unreadable text gives the default.

    Boolean words are not numbers here; a JSON boolean arrives as text and is
    mapped to 1 and 0. Java number suffixes (``1.5f``) are not accepted, digit
    group underscores are.
    """
    text = F.trim(as_column(value).cast("string"))
    lower = F.lower(text)
    digits = F.when(F.contains(text, F.lit("_")), F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")).otherwise(text)
    suffixed = lower.endswith("d") | (lower.endswith("f") & ~lower.endswith("inf"))
    word = F.when(lower == "true", F.lit(1.0)).when(lower == "false", F.lit(0.0))
    return F.coalesce(F.when(~suffixed, digits.try_cast("double")), word, F.lit(default).cast("double"))


def truth(value) -> Column:
    """Text to boolean: only the listed words are true, null is false."""
    return F.coalesce(F.lower(F.trim(as_column(value).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def clamp(value, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.greatest(low, F.least(high, as_column(value)))


def unit(value) -> Column:
    """Clamp to 0..1."""
    return clamp(value, 0.0, 1.0)


def first_present(columns: Sequence, default: Column | None = None) -> Column:
    """First non-null of several alias fields."""
    options = [as_column(c) for c in columns]
    if default is not None:
        options.append(default)
    return F.coalesce(*options) if options else F.lit(None)


def present(available: Sequence[str], names: Sequence[str]) -> list[str]:
    """The alias spellings a frame really has, in order."""
    return [n for n in names if n in available]


def text_or(value, default: str = "") -> Column:
    """Trimmed text, the default for null."""
    return F.coalesce(F.trim(as_column(value).cast("string")), F.lit(default))


def blank_to_null(value) -> Column:
    text = F.trim(as_column(value).cast("string"))
    return F.when(text != "", text)


def lower_name(value) -> Column:
    """Lower-case trimmed name, null when blank."""
    return F.lower(blank_to_null(value))


def risk_score(available: Sequence[str]) -> Column:
    """Risk from the first non-null alias, 0 when unreadable, clamped to 0..1."""
    names = present(available, RISK_FIELDS)
    if not names:
        return F.lit(0.0)
    return unit(number(first_present([F.col(n).cast("string") for n in names])))


def hours_to_failure(available: Sequence[str], names: Sequence[str] = TIME_TO_FAILURE_FIELDS) -> Column:
    """Hours from the first non-null alias; negative or unreadable gives null."""
    found = present(available, names)
    if not found:
        return F.lit(None).cast("double")
    raw = number(first_present([F.col(n).cast("string") for n in found]), default=-1.0)
    return F.when(raw >= 0, raw)
