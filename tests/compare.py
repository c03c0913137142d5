"""Runs registered queries next to their SQL on DuckDB. ``python tests/compare.py [sf_dir] [name ...]``"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(query, sql, spark, sf_dir, con) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


if __name__ == "__main__":
    from tablewright.session import local_session

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sql = e.oracle_sql()
    bad = 0
    for name, q in e.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            if name in sql:
                d = difference(q, sql[name], spark, sf, con)
                status = "ok" if d is None else f"DIFF {d}"
            else:
                df = q(spark, sf)
                rows = df.collect()
                status = f"rows {len(rows)} {rows[0] if rows else ''}"[:300]
        except Exception as exc:  # noqa: BLE001
            status = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.1f}s {status}", flush=True)
    print("bad:", bad)
