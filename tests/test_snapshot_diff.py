import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplemark.operators import snapshot_diff as D

SCHEMA = "snap int, usr string, at timestamp_ntz, a array<string>, b array<string>"
T0 = dt.datetime(2025, 1, 1)


def brute(rows):
    last = {}
    for s, u, at, a, b in rows:
        if s is not None and u is not None:
            k = (s, u)
            if k not in last or at > last[k][0]:
                last[k] = (at, (a or [], b or []))
    snaps = sorted({s for s, _ in last})
    out = set()
    for p, s in zip(snaps, snaps[1:]):
        old = {u: v[1] for (x, u), v in last.items() if x == p}
        new = {u: v[1] for (x, u), v in last.items() if x == s}
        out |= {(s, u, "added") for u in new.keys() - old.keys()} | {(s, u, "removed") for u in old.keys() - new.keys()}
        out |= {(s, u, "modified") for u in new.keys() & old.keys() if new[u] != old[u]}
    return out


def snapshots(seed, n=400, change=0.1):
    r = random.Random(seed)
    words = ["a", "b", "", "ab", None, "x y"]
    state = {f"u{i}": ([r.choice(words) for _ in range(r.randint(0, 4))], [r.choice(words)]) for i in range(n)}
    rows = []
    for s in (1, 2, 4):
        for u, (a, b) in state.items():
            at = T0 + dt.timedelta(days=s)
            rows.append((s, u, at, a if a or r.random() < 0.5 else None, b))
            if r.random() < 0.1:
                rows.append((s, u, at - dt.timedelta(hours=5), ["stale"], b))
            if r.random() < 0.1:
                rows.append((s, u, at, a, b))
        for u in list(state):
            x = r.random()
            if x < change:
                state[u] = (state[u][0] + ["new"], state[u][1]) if x < change / 2 else (state[u][1], state[u][0])
            elif x < change * 1.3:
                del state[u]
                state[f"{u}+{s}"] = (["n"], [])
    return rows


def changes(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash"))
    return {tuple(r) for r in D.snapshot_changes(df, "snap", "usr", "at", ["a", "b"], **kw).collect()}


@pytest.mark.parametrize("change,kw", [(0.1, {"rows_a_bucket": 64}), (0.0, {}), (0.9, {"rows_a_bucket": 50}), (0.6, {"rows_a_bucket": 100, "cells_a_row": 0.05})])
def test_against_brute_force(spark, change, kw):
    rows = snapshots(3, change=change)
    assert changes(spark, rows, **kw) == brute(rows)


def test_rows_by_rows_when_tables_never_open(spark, monkeypatch):
    monkeypatch.setattr(D, "ROUNDS", 1)
    rows = snapshots(5, n=200, change=0.8)
    assert changes(spark, rows, cells_a_row=0.01) == brute(rows)


def test_what_is_the_same(spark):
    rows = [(1, "u", T0, None, ["x"]), (2, "u", T0, [], ["x"]), (1, "w", T0, ["a"], ["b"]), (2, "w", T0, ["a", "b"], []), (1, None, T0, ["q"], []), (None, "z", T0, [], [])]
    assert changes(spark, rows) == {(2, "w", "modified")}
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "u", T0, [], [])]) == set()


def test_hash_is_the_jvms(spark):
    r = spark.range(1).select(F.xxhash64(F.lit(17), F.lit(-5).cast("bigint"), F.lit(2**62).cast("bigint"), F.lit(0).cast("bigint"))).first()[0]
    assert D.spark_hash(17, -5, 2**62, 0) == r


def test_peeling_gives_up_when_cells_are_few():
    cells = pd.DataFrame({"pair": [2], "bucket": [0], "m": [3], "cell": [0], "n": [2], "k1": [5], "k2": [6], "v": [7], "c": [8], "g": [9], "p": [0]})
    assert D.peel(cells)["ok"].tolist() == [False]
