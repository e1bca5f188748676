"""The hourly out-of-range counter over readings at any intervals, spread over ranges of one asset.

Minutes into the hour add up reading by reading; the reading that completes an hour restarts them, and what exceeds the hour is dropped. Where
restarts fall therefore depends on all readings before. A range of readings is a function of the minutes into the hour at
its start: these decide which of its first readings restarts the hour, and from a restart on everything is known. Each range's function is
a table with a row for each reading that can be its first restart; the functions are composed range after range, on
these tables alone, and each range is then run from its own start.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, partitions
from .running import ranged

#: Microseconds of an hour; times are whole microseconds, so sums do not depend on how they are split.
HOUR = 3_600_000_000

# Groups of keys in a range.
GROUPS = 32


def following(total: np.ndarray) -> np.ndarray:
    """The reading that restarts the hour after a restart at each one, by running time; the number of readings where none does."""
    return np.searchsorted(total, total + HOUR, side="left")


def function_of(step: np.ndarray, units: np.ndarray) -> pd.DataFrame:
    """(needs, hour, units): what a range of readings makes of the minutes before it.

    The first row is for no restart: ``hour`` and ``units`` are added to what there was. Each other row is a reading that is
    the first restart if at least ``needs`` of the hour has passed before the range and no earlier reading is; ``hour`` and ``units`` are
    those at the range's end then.
    """
    total, done = np.cumsum(step), np.cumsum(units)
    before = total - step
    first = np.flatnonzero(before < HOUR)
    last = np.arange(len(step))
    if len(step):
        after = following(total)
        for i in range(len(step) - 1, -1, -1):
            if after[i] < len(step):
                last[i] = last[after[i]]
    # The restarting reading's own units are counted after the restart.
    ends = last[first]
    return pd.DataFrame({
        "needs": np.concatenate([[-1], np.maximum(0, HOUR - total[first])]).astype("int64"),
        "hour": np.concatenate([[total[-1] if len(total) else 0], total[-1:] - total[ends] if len(total) else []]).astype("int64"),
        "units": np.concatenate([[done[-1] if len(done) else 0], (done[-1:] - done[ends] + units[ends]) if len(done) else []]).astype("int64"),
    })


def applied(hour: int, units: int, needs: np.ndarray, hours: np.ndarray, sums: np.ndarray) -> tuple[int, int]:
    """Hour and units after a range, given those before it and its function; rows of first restarts come in order."""
    able = np.flatnonzero(needs[1:] <= hour)
    if len(able):
        return int(hours[1 + able[0]]), int(sums[1 + able[0]])
    return hour + int(hours[0]), units + int(sums[0])


def run(step: np.ndarray, units: np.ndarray, hour: int, before: int) -> np.ndarray:
    """Units since the last restart, after each reading."""
    total, done = np.cumsum(step), np.cumsum(units)
    out = done + before
    at = int(np.searchsorted(total, HOUR - hour, side="left"))
    while at < len(step):
        out[at:] = done[at:] - done[at] + units[at]
        at = int(np.searchsorted(total, total[at] + HOUR, side="left"))
    return out


def hourly_counter(rows: DataFrame, key: str, order: Sequence[str], step: Column, units: Column, name: str) -> DataFrame:
    """The rows with ``name``: units times microseconds since the hour was last restarted, the current reading included.

    ``step`` is the time that a reading stands for in whole microseconds, ``units`` a whole number. Rows without a key are left out, rows
    without a time come first; null steps and units are 0.
    """
    known = rows.filter(F.col(key).isNotNull()).withColumns({
        "_step": F.coalesce(step.cast("long"), F.lit(0)), "_units": F.coalesce(units.cast("long") * step.cast("long"), F.lit(0)),
    })
    marked = ranged(known, key, *order)
    kind = rows.schema[key].dataType.simpleString()

    # Many small keys share a group: a call for each would cost more than its readings.
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")

    def by_key(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[slice]]:
        """The rows by key, each key's in order, and where each key's rows are."""
        frame = frame.sort_values([key, *order], kind="stable", na_position="first", ignore_index=True)
        keys = frame[key].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
        return frame, [slice(start, end) for start, end in zip(starts, [*starts[1:], len(frame)])]

    def functions(frame: pd.DataFrame) -> pd.DataFrame:
        frame, parts = by_key(frame)
        step, units = frame["_step"].to_numpy(), frame["_units"].to_numpy()
        out = [function_of(step[p], units[p]) for p in parts]
        sizes = [len(made) for made in out]
        made = pd.concat(out, ignore_index=True)
        made.insert(0, "_chunk", frame["_chunk"].iloc[0])
        made.insert(0, key, np.repeat(frame[key].to_numpy()[[p.start for p in parts]], sizes))
        return made.assign(place=np.concatenate([np.arange(n) for n in sizes]))

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, "_chunk", "place"], kind="stable", ignore_index=True)
        out, last, hour, done = [], None, 0, 0
        keys, chunks = frame[key].to_numpy(), frame["_chunk"].to_numpy()
        columns = [frame[c].to_numpy() for c in ("needs", "hour", "units")]
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])])).tolist()
        for start, end in zip(cuts, [*cuts[1:], len(frame)]):
            if keys[start] != last:
                last, hour, done = keys[start], 0, 0
            out.append((last, chunks[start], hour, done))
            hour, done = applied(hour, done, *(c[start:end] for c in columns))
        return pd.DataFrame(out, columns=[key, "_chunk", "_hour", "_done"])

    small = marked.select(key, "_chunk", *order, "_step", "_units")
    tables = small.groupBy("_chunk", group).applyInPandas(functions, f"{key} {kind}, _chunk int, needs long, hour long, units long, place long")
    spread = F.pmod(F.xxhash64(key), F.lit(GROUPS * partitions(rows.sparkSession))).cast("int")
    starts = materialise(tables.groupBy(spread).applyInPandas(composed, f"{key} {kind}, _chunk int, _hour long, _done long"), "starts")

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        frame, parts = by_key(frame)
        step, units, hour, done = (frame[c].to_numpy() for c in ("_step", "_units", "_hour", "_done"))
        values = [run(step[p], units[p], int(hour[p.start]), int(done[p.start])) for p in parts]
        return frame.drop(columns=["_step", "_units", "_chunk", "_hour", "_done"]).assign(**{name: np.concatenate(values)})

    schema = rows.schema.add(name, "long")
    return marked.join(starts, [key, "_chunk"]).groupBy("_chunk", group).applyInPandas(
        lambda frame: counted(frame)[[f.name for f in schema.fields]], schema
    )
