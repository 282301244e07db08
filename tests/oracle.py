"""Compares a query with its SQL in DuckDB, as sets of rows with columns by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, tuple) else (True, "t", str(v)) for v in row)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=_key)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=_key)


def differences(df, con, sql):
    """None if equal, else a description of the first difference."""
    a, b = rows_of(df), rows_of_sql(con, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows against {len(b[1])}"
    for x, y in zip(a[1], b[1]):
        if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6) for p, q in zip(x, y)):
            return f"{x} against {y} in {a[0]}"
    return None
