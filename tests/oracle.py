"""Spark rows and DuckDB rows of one query, side by side."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x + 0.0, 6) + 0.0)
    if isinstance(x, bool) or x is None or isinstance(x, str | int):
        return str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return str(x)


def differences(df, con, sql):
    """A text that says how the rows differ; empty if they do not."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in names]
    want = sorted([plain(r[i]) for i in at] for r in rel.fetchall())
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    if got == want:
        return ""
    odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return f"{len(got)} and {len(want)} rows; {names}; {odd}"


def type_of(t):
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}.get(t, t)


def type_differences(df, con, sql):
    rel = con.sql(sql)
    want = dict(zip(rel.columns, map(str, rel.types)))
    return {c: (t, want.get(c)) for c, t in df.dtypes if type_of(t) != want.get(c)}
