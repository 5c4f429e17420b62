import random
from collections import defaultdict

from pyspark.sql import functions as F

from ripplemark.operators import cases as K
from ripplemark.operators import graph as G
from ripplemark.operators import results as R
from ripplemark.operators.ranking import first_k, global_rank
from ripplemark.streaming.incremental import daily_counts, merge_once

EDGE = "ord bigint, dependency string, dependent string, relation string, file string, line int"


def brute_reach(edges, roots, max_hop, seeds=()):
    by = defaultdict(list)
    for e in edges:
        if e[1] is not None and e[2] is not None:
            by[e[1]].append(e)
    hops, used = {}, set()
    for root, limit in roots.items():
        seen, front = {root}, [root]
        hops[(root, root)] = 0
        for h in range(1, max_hop + 1):
            found = defaultdict(list)
            for n in front:
                for o, _, to, rel, _, _ in by[n]:
                    allowed = (limit is None or rel in limit) if h == 1 else rel not in G.FIRST_HOP_ONLY
                    if allowed and to not in roots and to not in seen:
                        found[to].append((o, rel))
            for to, es in found.items():
                hops[(root, to)] = h
                used |= {(root, to, o) for o, _ in es}
            seen |= set(found)
            front = [to for to, es in found.items() if any(r != G.TERMINAL for _, r in es)]
            for to in (t for r, t in seeds if r == root and h == 1 and t not in roots):
                hops[(root, to)] = 1
                seen.add(to)
                front = list({*front, to})
    return hops, used


def test_reach_against_brute_force(spark):
    r = random.Random(3)
    rel = ["call", "contains", "uses_type", "include", "inherit_override", G.TERMINAL]
    edges = [(i, r.choice(["n0", f"n{r.randint(0, 60)}"]), r.choice([None, f"n{r.randint(0, 60)}"]), r.choice(rel), "f", i) for i in range(500)]
    roots = {"n0": None, "n1": ["include", "inherit_override"], "n2": [], "n3": None, "absent": None}
    nodes, found = G.reach(spark.createDataFrame(edges, EDGE), spark.createDataFrame(list(roots.items()), "root string, limit array<string>"), 3)
    hops, used = brute_reach(edges, roots, 3)
    assert {(x["root"], x["node"]): x["hop"] for x in nodes.collect()} == hops
    assert {(x["root"], x["node"], x["ord"]) for x in found.collect()} == used
    e, rt = spark.createDataFrame(edges, EDGE), spark.createDataFrame(list(roots.items()), "root string, limit array<string>")
    seeds = [("n2", "n7"), ("n0", "n1"), ("n3", "new"), ("n3", "n9")]
    nodes, none = G.reach(e, rt, 3, 0, spark.createDataFrame(seeds, "root string, node string"))
    assert none is None and {(x["root"], x["node"]): x["hop"] for x in nodes.collect()} == brute_reach(edges, roots, 3, seeds)[0]
    _, few = G.reach(e, rt, 3, 1)
    first = {}
    for root, to, o in used:
        first[(root, to)] = min(o, first.get((root, to), o))
    assert {(x["root"], x["node"], x["ord"]) for x in few.collect()} == {(*k, o) for k, o in first.items()}
    few = G.reach_edges(found, 2, 3).collect()
    assert max(len([1 for x in few if x["node"] == n]) for n in {x["node"] for x in few}) <= 3


def test_header_seeds(spark):
    roots = spark.createDataFrame([("b", "x/a.h"), ("a", "x/a.h"), ("c", "x/c.cc"), ("d", "x/d.hpp"), ("e", None)], "root string, file string")
    risks = spark.createDataFrame([("a", "logic"), ("b", "abi_layout"), ("c", "abi_layout"), ("d", "build_config")], "root string, risk_group string")
    assert sorted(tuple(r) for r in G.header_seeds(roots, risks, ["abi_layout", "build_config"], r"\.(h|hpp)$").collect()) == [("b", "file:x/a.h"), ("d", "file:x/d.hpp")]


def test_closure_with_loops(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), (None, "a"), ("e", None)] + [(f"k{i}", f"k{i + 1}") for i in range(40)]
    got = {tuple(x) for x in G.closure(spark.createDataFrame(pairs, "a string, b string")).collect()}
    ring = {"a", "b", "c"}
    assert got == {(p, q) for p in ring for q in ring | {"d"}} | {("x", "x")} | {(f"k{i}", f"k{j}") for i in range(40) for j in range(i + 1, 41)}
    assert G.closure(spark.createDataFrame([], "a string, b string")).collect() == []


def test_global_rank_is_a_plain_sort(spark):
    r = random.Random(1)
    rows = [(i, r.randint(0, 50), r.choice([None, "x", "y"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a int, b string")
    got = {x["id"]: x["rank"] for x in global_rank(df, [F.desc("a"), F.asc_nulls_first("b"), F.col("id")]).collect()}
    want = sorted(rows, key=lambda x: (-x[1], x[2] is not None, x[2] or "", x[0]))
    assert got == {x[0]: i + 1 for i, x in enumerate(want)}
    assert global_rank(df.limit(0), [F.col("id")]).collect() == []


def test_same_ranks_whatever_the_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") * 7919 % 101).alias("a"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted((x["id"], x["rank"]) for x in global_rank(df, [F.col("a"), F.col("id")]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_priorities(spark):
    rows = [(0, "thread_safety", "mutex"), (1, "abi_layout", "signature_change"), (2, "logic", ""), (2, "thread_safety", ""), (0, "logic", "removed_guard"), (1, "logic", "removed_guard"), (2, "logic", "removed_write"), (0, "logic", "logging"), (0, "abi_layout", "header_change")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, hop int, g string, s string")
    got = [x["p"] for x in df.select("i", K.priority(F.col("hop"), F.col("g"), F.col("s")).alias("p")).orderBy("i").collect()]
    assert got == ["P1", "P2", "P3", "P2", "P1", "P2", "P3", "P3", "P2"]


def test_files_carry_file_risks_only(spark):
    nodes = spark.createDataFrame([("r1", "file:a", 1), ("r2", "file:a", 2), ("r1", "m", 2), ("r2", "m", 1), ("r1", "r1", 0)], "root string, node string, hop int")
    risks = spark.createDataFrame([("r1", "logic", ""), ("r2", "logic", ""), ("r2", "thread_safety", "mutex")], "root string, risk_group string, sub_reason string")
    got = {(x["node"], x["hop"], x["risk_group"], tuple(x["roots"])) for x in K.generate(nodes, risks, F.col("node").startswith("file:")).collect() if x["hop"]}
    assert got == {("file:a", 1, "abi_layout", ("r1",)), ("m", 1, "logic", ("r2",)), ("m", 1, "thread_safety", ("r2",))}


def test_duplicate_keys_are_numbered(spark):
    c = spark.createDataFrame([(3, "n", None, "logic", "", ["a"]), (1, "n", None, "logic", "", ["a"]), (2, "n", None, "logic", "", ["b"])], "rank int, name string, file string, risk_group string, sub_reason string, roots array<string>")
    k = {x["rank"]: x["key"] for x in K.keys(c).collect()}
    assert k[3] == k[1] + "-2" and k[2] != k[1] and len(k[1]) == 12


def test_carry_over_and_verdicts(spark):
    a = spark.createDataFrame([("k1", "f"), ("k2", "g"), ("k3", None), ("k5", None)], "key string, fingerprint string")
    b = spark.createDataFrame([("k1", "f", "pass"), ("k2", "x", "fail"), ("k4", "q", "pass"), ("k5", None, "fail")], "key string, fingerprint string, verdict string")
    assert {x["key"]: (x["verdict"], x["state"]) for x in R.carry_over(a, b).collect()} == {"k1": ("pass", "carried"), "k2": ("fail", "needs_recheck"), "k3": (None, "new"), "k4": ("pass", "orphaned"), "k5": ("fail", "carried")}
    cases = spark.createDataFrame([(i,) for i in range(5)], "id int")
    v = spark.createDataFrame([(0, "weak", "n", None), (1, "not_needed", " ", None), (2, "pass_by_review", "n", ""), (3, "pass_by_review", None, "a:1"), (9, "confirmed", None, None)], "id int, verdict string, note string, proof string")
    got, lost = R.annotate(cases, v)
    assert {x["id"]: x["verdict"] for x in got.collect()} == {0: "not_needed", 1: "needs_info", 2: "needs_info", 3: "pass_by_review", 4: None}
    assert [x["id"] for x in lost.collect()] == [9]


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "a", 1), ("q2", "c", 15), ("q3", "z", 1)], "query string, item string, rank int")
    truth = spark.createDataFrame([("q1", "b"), ("q2", "c"), ("q2", "b"), ("q3", "none")], "query string, item string")
    m = R.metrics(R.first_hits(ranked, truth)).first()
    assert (m["queries"], m["top10"], m["top20"], m["missed"], m["median"]) == (3, 1, 2, 1, 15)
    assert abs(m["mrr"] - (1 / 2 + 1 / 15) / 3) < 1e-8


def test_first_k(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5), (None, 1)], "g string, v int")
    assert sorted((x["g"] or "", x["v"]) for x in first_k(df, ["g"], [F.col("v")], 2).collect()) == [("", 1), ("a", 1), ("a", 2), ("b", 5)]


def test_stream_counts_each_event_once(spark, tmp_path):
    import datetime as dt

    rows = [(i % 40, dt.datetime(2025, 1, 1 + i % 3), "x" if i % 2 else "y") for i in range(40)]
    spark.createDataFrame(rows + rows[:7], "id int, at timestamp_ntz, kind string").repartition(3).write.parquet(f"{tmp_path}/e.parquet")
    got = {(x["day"].day, x["kind"]): x["events"] for x in daily_counts(spark, f"{tmp_path}/e.parquet", "at", "kind", "id").collect()}
    want = defaultdict(int)
    for _, at, k in rows:
        want[(at.day, k)] += 1
    assert got == want


def test_batches_are_merged_once(spark, tmp_path):
    df = spark.range(3)
    assert merge_once(df, 1, str(tmp_path), "r") and not merge_once(df, 1, str(tmp_path), "r") and merge_once(df, 2, str(tmp_path), "r")
    assert spark.read.parquet(str(tmp_path)).count() == 6
