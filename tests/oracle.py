"""Comparison of a query with its SQL in DuckDB, by columns by name and rows in any order."""

import glob
import math
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else format(float(v), ".6g")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


def compare(spark, run, sql):
    con = duckdb.connect()
    for p in glob.glob(FOLDER + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, rel = run(spark, FOLDER), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs
