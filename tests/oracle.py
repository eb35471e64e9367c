"""Compares a query with its SQL in DuckDB, by columns' names and without order."""

import decimal
import pathlib

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def database(d):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in pathlib.Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same(df, con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*cols).collect()), key=repr)
    assert got == want
