"""Compares a query's rows with its SQL on DuckDB."""

import glob
import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


def value(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return "[" + ",".join(map(value, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(value, r)) for r in frame.astype(object).itertuples(index=False, name=None))


def same(spark, con, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or (_number(p) and _number(q) and abs(float(p) - float(q)) < 2e-6) for p, q in zip(x, y)), (x, y)


def _number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True
