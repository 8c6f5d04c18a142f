"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [--sf DIR] [name part ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recordshield.queries import load  # noqa: E402
from recordshield.queries.base import TABLES  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, dt.date):
        return v.strftime("%Y-%m-%d 00:00:00.000000")
    if hasattr(v, "item"):
        return plain(v.item())
    return str(v)


def rows_of(table, columns) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in zip(*[table.column(c).to_pylist() for c in columns])), key=repr)


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> str:
    df = fn(spark, sf)
    got = df.toArrow()
    if sql is None:
        return f"rows {got.num_rows}"
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"COLUMNS {sorted(got.column_names)} != {sorted(want.column_names)}"
    columns = sorted(got.column_names)
    types = [(c, str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in columns]
    off = [t for t in types if t[1].replace("large_", "") != t[2].replace("large_", "")]
    a, b = rows_of(got, columns), rows_of(want, columns)
    if len(a) != len(b):
        return f"ROWS {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"VALUES {columns}\n   spark  {x}\n   duckdb {y}"
    return f"ok {len(a)}" + (f"  types {off}" if off else "")


def main(argv: list[str]) -> int:
    from recordshield.session import build_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    queries, sql = load()
    spark = build_session("oracle", 8, 8)
    con = connect(sf)
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) or a == name for a in argv):
            continue
        start = time.time()
        try:
            result = compare(spark, con, sf, name, fn, sql.get(name))
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        good = result.startswith(("ok", "rows"))
        bad += not good
        print(f"{'   ' if good else '!! '}{name:45s} {time.time() - start:6.2f}s  {result}", flush=True)
    print(f"{bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
