"""The queries that walk, against a plain walk over the same rows."""

import os

import pytest
from pyspark.sql import functions as F
from test_graph_cases import brute_reach

import __spark_entry__ as entry
from ripplemark.plans import bindings as B

DATA = "/root/testdata/sf0.001"
Q = entry.queries()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def rows(spark, name):
    return [tuple(r) for r in Q[name](spark, DATA).collect()]


def header_seeds(spark):
    """The first root of each header that carries a risk of its file."""
    file = {r["usr"]: r["file"] for r in Q["changed_symbols"](spark, DATA).collect()}
    first = {}
    for root, group, _ in rows(spark, "risk_rules"):
        if group in ("abi_layout", "build_config") and file[root].endswith((".h", ".hh", ".hpp", ".hxx")):
            first[file[root]] = min(root, first.get(file[root], root))
    return [(r, f"file:{f}") for f, r in first.items()]


def walk(spark, hops, limits=False, seeds=()):
    edges = [tuple(r) for r in B.edges(spark, DATA).select("ord", "dependency", "dependent", "relation", "file", "line").collect()]
    roots = {r: (x.split(",") if x is not None else None) if limits else None for r, x in rows(spark, "traverse_limits")}
    return edges, roots, *brute_reach(edges, roots, hops, seeds)


@needs_data
def test_cases_at_two_hops(spark):
    _, _, hops, used = walk(spark, 2, limits=True, seeds=header_seeds(spark))
    nodes = {n for _, n in hops}
    assert 2 in hops.values()
    got = Q["case_features"](spark, DATA).select("node", "fan_in").collect()
    assert {n: k for n, k in got} == {n: len({r for r, x in hops if x == n}) for n in nodes}
    cases = rows(spark, "case_generation")
    assert {c[1] for c in cases} == {0, 1, 2}
    least = lambda pairs: {n: min(h for x, h in pairs if x == n) for n in {x for x, _ in pairs if not x.startswith("file:")}}
    assert least([(c[0], c[1]) for c in cases]) == least([(n, h) for (_, n), h in hops.items()])
    assert len(rows(spark, "case_ranking")) == len(rows(spark, "case_keys")) == len(cases) == sum(r[-1] for r in rows(spark, "case_priority"))
    assert {(r, n, o) for r, n, o, _ in rows(spark, "reach_edges_topk")} <= used


@needs_data
def test_gaps_and_units_at_two_hops(spark):
    edges, roots, hops, used = walk(spark, 2)
    tests = {e[0] for e in edges if e[4] and any(e[4].split("/")[-1].split("_")[1:2] == [x] for x in ("monitor", "guard"))}
    assert {r for (r,) in rows(spark, "test_gaps")} == set(roots) - {r for r, _, o in used if o in tests}
    unit = {r["usr"]: r["u"] for r in Q["changed_symbols"](spark, DATA).select("usr", F.regexp_extract("file", "^([^/]+/[^/]+)/", 1).alias("u")).collect()}
    want = {}
    for (r, n), h in hops.items():
        ns, top = want.get(unit[r], (set(), 0))
        want[unit[r]] = (ns | {n}, max(top, h))
    assert {u: (n, h) for u, n, h in rows(spark, "split_units")} == {u: (len(ns), h) for u, (ns, h) in want.items()}


@needs_data
def test_deep_reach_over_all_edges(spark):
    _, _, hops, _ = walk(spark, 4)
    want = {}
    for (_, n), h in hops.items():
        want.setdefault(h, []).append(n)
    assert {(h, p, n) for h, p, n in rows(spark, "impact_deep")} == {(h, len(ns), len(set(ns))) for h, ns in want.items()}


@needs_data
def test_folders_and_entry_points_over_all_relations(spark):
    all_ = set(rows(spark, "target_dependents"))
    touched = {r["t"] for r in Q["changed_symbols"](spark, DATA).select(F.regexp_extract("file", "^([^/]+/[^/]+)/", 1).alias("t")).collect() if r["t"]}
    want = {(t, None) for t in touched} | {(a, min(n for x, n in all_ if x == a and n in touched)) for a, b in all_ if b in touched and a not in touched}
    assert set(rows(spark, "affected_targets")) == want
    calls = {(r["callee"], r["caller"]) for r in B.edges(spark, DATA).where("relation = 'call' and dependency is not null and dependent is not null").selectExpr("dependency callee", "dependent caller").collect()}
    starts = {r["usr"] for r in Q["changed_symbols"](spark, DATA).collect()}
    assert {r[0] for r in rows(spark, "entry_points")} == {s for s in starts if any(a == s and b != s for a, b in calls)}
