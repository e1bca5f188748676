"""Run a registered query in Spark and its SQL check in DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, folder: str) -> dict:
    from frostline.plans import ORACLES, QUERIES

    started = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "rows": len(rows), "sec": round(time.time() - started, 2), "ok": None}
    if name not in ORACLES:
        return out
    started = time.time()
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    out["check_sec"] = round(time.time() - started, 2)
    if sorted(columns) != sorted(df.columns):
        out.update(ok=False, why=f"columns {sorted(df.columns)} but the check has {sorted(columns)}")
        return out
    mine, theirs = table(df.columns, rows), table(columns, expected)
    out["ok"] = mine == theirs
    if not out["ok"]:
        missing, extra = sorted(set(theirs) - set(mine)), sorted(set(mine) - set(theirs))
        out["why"] = f"{len(mine)} rows, check {len(theirs)}; only spark {extra[:2]}; only check {missing[:2]}"
    return out


def main(argv: list[str]) -> int:
    from frostline.plans import QUERIES
    from frostline.session import local_session

    folder = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    names = argv[1:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            result = {"name": name, "ok": False, "why": str(error)[:1500]}
        bad += result["ok"] is False
        print(result, flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
