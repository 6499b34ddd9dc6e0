"""Compares queries with their SQL on one of the driver's folders."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*' if os.path.isdir(p) else ''}'")
    return c


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    return str(v)


def compare(df, con, sql):
    """Columns, and rows that only one side has."""
    names = sorted(df.columns)
    got = sorted(tuple(canonical(v) for v in r) for r in df.select(*names).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names, (names, sorted(rel.columns))
    want = sorted(tuple(canonical(v) for v in r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({sql.strip().rstrip(';')})").fetchall())
    return got, want
