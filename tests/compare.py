"""Run a registered query and its SQL over the same tables and compare names and rows."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, bool) or v is None:
        return v
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((repr([plain(r[i]) for i in order]) for r in rows))


def oracle_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall())


def assert_same(df, sql, sf_dir):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = oracle_rows(sql, sf_dir)
    assert got[0] == want[0], f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        raise AssertionError(f"{len(got[1])} rows against {len(want[1])}; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}")
