"""Compares a query with its DuckDB SQL: row count, columns, values without order."""

import glob
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(names), sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def differences(spark, con, f, sql, sf_dir=DATA):
    df = f(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    q = con.sql(sql)
    b = rows(q.columns, q.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} and {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y and not all(u == v or (isinstance(u, float) and isinstance(v, (int, float)) and abs(u - v) <= 2e-5 * max(1, abs(u))) for u, v in zip(x, y))]
    return f"{len(bad)} rows differ, as {bad[0]} in {a[0]}" if bad else ""
