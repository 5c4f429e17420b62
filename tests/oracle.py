"""Run queries against their SQL and compare, as rows in any order."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{at}'")
    return c


def canon(rows, names) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if isinstance(x, float):
            return f"{x:.6g}"
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(one, x)) + "]"
        if hasattr(x, "isoformat"):
            return x.isoformat()
        if hasattr(x, "asDict"):
            return "{" + ",".join(f"{k}:{one(v)}" for k, v in sorted(x.asDict().items())) + "}"
        if isinstance(x, dict):
            return "{" + ",".join(f"{k}:{one(v)}" for k, v in sorted(x.items())) + "}"
        return str(x)

    return sorted("|".join(one(r[i]) for i in order) for r in rows)


def run(spark, f, d: str) -> tuple[list, list[str], float]:
    t = time.time()
    df = f(spark, d)
    return df.collect(), df.columns, time.time() - t


def compare(spark, name: str, f, sql: str | None, d: str, con=None, ran=None) -> str:
    got, names, took = ran or run(spark, f, d)
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    cur = (con or views(d)).execute(sql)
    want, wnames = cur.fetchall(), [x[0] for x in cur.description]
    if sorted(names) != sorted(wnames):
        return f"{name}: DIFFERENT columns {names} {wnames}"
    a, b = canon(got, names), canon(want, wnames)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"{name}: DIFFERENT {len(a)} {len(b)} spark only {only_a} sql only {only_b}"
    return f"{name}: same {len(a)} rows, {took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as e
    from ripplemark.runtime import local_session

    d, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8", 8)
    q, o, con = e.queries(), e.oracle_sql(), views(d)
    for n in q:
        if not names or any(n == x or n.startswith(x) for x in names):
            try:
                print(compare(spark, n, q[n], o.get(n), d, con)[:600], flush=True)
            except Exception as x:
                print(n, "FAILED", str(x)[:900], flush=True)
