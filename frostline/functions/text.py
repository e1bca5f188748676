"""Text column expressions for documents and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import as_column

# Display names that the general rule does not give.
CARGO_DISPLAY_NAMES = {"frozenfood": "Frozen Food", "bloodplasma": "Blood Plasma", "icecream": "Ice Cream"}

# Whitespace as Unicode sees it, not only ASCII.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(value) -> Column:
    return F.regexp_replace(as_column(value), f"^{SPACE}+|{SPACE}+$", "")


def compact(value) -> Column:
    """Runs of whitespace become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(as_column(value), f"{SPACE}+", " "))


def slug(value) -> Column:
    dashed = F.regexp_replace(F.lower(as_column(value)), "[^a-zA-Z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(trimmed == "", F.lit("document")).otherwise(trimmed)


def stable_id(prefix, value) -> Column:
    prefix = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(prefix, F.lit("-"), F.substring(F.sha1(as_column(value)), 1, 12))


def first_line(value, fallback) -> Column:
    """First non-empty line without leading ``#``, at most 140 characters."""
    lines = F.transform(
        F.split(as_column(value), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"),
        lambda line: strip(F.regexp_replace(strip(line), "^#+", "")),
    )
    filled = F.filter(lines, lambda line: line != "")
    return F.coalesce(F.substring(F.get(filled, F.lit(0)), 1, 140), as_column(fallback))


def title_words(value) -> Column:
    return F.initcap(F.regexp_replace(as_column(value), "[-_]", " "))


def cargo_display(value) -> Column:
    value = as_column(value)
    named = F.create_map(*[F.lit(x) for pair in CARGO_DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, value), F.initcap(F.replace(value, F.lit("_"), F.lit(" "))))


def yes_no(flag) -> Column:
    return F.when(as_column(flag), "yes").otherwise("no")


def listed(parts: list[Column], separator: str) -> Column:
    """Join the non-null parts."""
    return F.concat_ws(separator, *parts)


def kept(parts: list[Column]) -> Column:
    """Array of the non-null parts, in order."""
    return F.filter(F.array(*parts), lambda part: part.isNotNull())
