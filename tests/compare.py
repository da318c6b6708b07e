"""Run a query and its SQL, and compare their rows, columns sorted by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    return "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6f}" if isinstance(x, float) else str(x)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(_plain(r[i]) for i in at) for r in rows)


def differences(df, con, sql):
    """An empty text if both agree."""
    got_columns, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} and {want_columns}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} and {len(want)} rows, {len(a)} and {len(b)} differ: {sorted(a)[:2]} {sorted(b)[:2]}"
    return ""
