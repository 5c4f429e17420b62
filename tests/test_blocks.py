"""Reach by blocks: right on loops and across blocks, and nothing is written that grows with the pairs."""

import random

import pytest

from ripplemark.operators import detectors as D
from ripplemark.operators import flow
from ripplemark.operators import graph as G
from ripplemark.runtime import Staged


@pytest.fixture
def written(monkeypatch):
    """Counts the rows of the intermediate tables."""
    kept, init = [], Staged.__init__

    def watched(self, *a, **k):
        init(self, *a, **k)
        kept.append(self)

    monkeypatch.setattr(Staged, "__init__", watched)
    return lambda: sum(x.count() for x in kept)


def brute(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    far = set()
    for a in out:
        todo, seen = list(out[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        far |= {(a, x) for x in seen}
    return far


def links(n, k, seed):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(k)} | {(f"l{i}", f"l{(i + 1) % 40}") for i in range(40)})


def test_override_groups_write_no_pairs_of_classes(spark, written):
    bases = links(60, 70, 1)
    methods = [(f"m{i}", f"{p}{i % 60 if p == 'n' else i % 40}", "abc"[i % 3], i % 4 == 0) for i, p in enumerate("nl" * 60)]
    up = brute(bases)
    one = {(a[0], b[0]) for a in methods for b in methods if (a[1], b[1]) in up and a[2] == b[2] and (a[3] or b[3]) and a[0] != b[0]}
    want = {}
    for a, b in one | {(b, a) for a, b in one}:
        want.setdefault(a, set()).add(b)
    mk = spark.createDataFrame
    got = G.override_groups(mk(methods, "id string, parent string, display string, is_virtual boolean"), mk(bases, "cls string, base string")).collect()
    assert {r["method"]: r["overrides"] for r in got} == {a: sorted(bs) for a, bs in want.items()} and len(got) == len(want)
    assert written() < len(bases)


def test_closure_writes_no_pairs(spark, written):
    pairs = links(80, 120, 2)
    got = [tuple(r) for r in G.closure(spark.createDataFrame(pairs, "a string, b string")).collect()]
    assert set(got) == brute(pairs) and len(got) == len(set(got))
    assert written() < len(pairs)


def test_affected_targets_write_no_pairs(spark, written):
    deps = links(80, 60, 3)
    touched = {"n3", "n7", "l5", "alone"}
    via = {}
    for a, b in brute(deps):
        if b in touched and a not in touched:
            via[a] = min(b, via.get(a, b))
    got = G.affected_targets(spark.createDataFrame([(x,) for x in touched], "target string"), spark.createDataFrame(deps, "target string, needs string")).collect()
    assert sorted((r["target"], r["via"] or "") for r in got) == sorted([(x, "") for x in touched] + list(via.items()))
    assert written() < len(deps)


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_new_enum_value_meets_few_users(spark):
    types, names = [f"t{i}" for i in range(60)], ["AAAA", "BBBB", "CCCC", "DDDD"]
    old = [(t, n) for t in types for n in names]
    new = old + [(t, f"N{i % 3}") for i, t in enumerate(types)]
    users = [(f"u{k:04}", n) for k in range(600) for n in names] + [(f"u{k:04}", f"N{j}") for j in range(3) for k in range(600) if j < 2 and (k < 100 or k % 2 == j) or k < 3]
    holds = set(users)
    want = sorted((t, f"N{i % 3}", u) for i, t in enumerate(types) for u in [f"u{k:04}" for k in range(600) if (f"u{k:04}", f"N{i % 3}") not in holds][:8])
    mk, before = spark.createDataFrame, shuffled(spark)
    got = D.new_enum_value(mk(old, "usr string, name string"), mk(new, "usr string, name string"), mk(users, "usr string, name string")).collect()
    assert sorted(tuple(r) for r in got) == want
    assert shuffled(spark) - before < len(types) * 600


def flow_tables(spark, n=60):
    """Functions f0.. that all hand two values over to all functions of one name, and a few that no one takes."""
    mk, f = spark.createDataFrame, range(n)
    within = mk([(f"f{i}|n", f"f{i}|x") for i in f] + [(f"f{i}|x", f"f{i}|y") for i in f], "src string, dst string")
    exits = mk([(f"f{i}|y", f"arg|c{i % 3}") for i in f] + [(f"f{i}|x", f"arg|lost{i % 7}") for i in f], "node string, channel string")
    entries = mk([(f"arg|c{(i + 1) % 3}", f"f{i}|n") for i in f], "channel string, node string")
    starts = mk([(f"f{i}", f"f{i}|x") for i in f], "root string, node string")
    calls = mk([(f"f{i}|y", f"f{i}", "send" if i % 2 else "log", i % 2 == 1) for i in f], "node string, usr string, callee string, emits boolean")
    return within, exits, entries, starts, calls


def depths(n=60, depth=3):
    """For each root the functions whose values are reached, with the least depth; f's own x and y come at 0, its n later."""
    out = {}
    for r in range(n):
        out[f"f{r}"] = {f"f{r}|x": 0, f"f{r}|y": 0} | {f"f{i}|{v}": d for d in range(depth, 0, -1) for i in range(n) if (i - r) % 3 == (-d) % 3 for v in "nxy" if i != r or v == "n"}
    return out


def test_reach_counts_write_no_values(spark, written):
    *t, calls = flow_tables(spark)
    got = {(r["root"], r["depth"]): r["vals"] for r in flow.reach_counts(flow.flow(*t), 3).collect()}
    want = {}
    for root, nodes in depths().items():
        for d in nodes.values():
            want[root, d] = want.get((root, d), 0) + 1
    assert got == want
    assert written() < 60


def test_emitting_writes_no_values(spark, written):
    got = {(r["root"], r["usr"]): r["depth"] for r in flow.emitting(flow.flow(*flow_tables(spark)), 3).collect()}
    assert got == {(root, f"f{i}"): nodes[f"f{i}|y"] for root, nodes in depths().items() for i in range(1, 60, 2) if f"f{i}" != root}
    assert written() < 60


def test_breaks_write_no_values(spark, written):
    *t, _ = flow_tables(spark)
    g = flow.flow(*t)
    every, few = flow.breaks(g, 3).collect(), flow.breaks(g, 3, 5).collect()
    want = {}
    for root, nodes in depths().items():
        at = {(f"arg|lost{int(x[1:-2]) % 7}", "no one takes it") for x, d in nodes.items() if x.endswith("|x") and d < 3}
        want[root] = sorted(at | {(f"arg|c{int(x[1:-2]) % 3}", "depth limit") for x, d in nodes.items() if x.endswith("|y") and d == 3}, key=lambda p: (p[1], p[0]))
    by = lambda rows, root: sorted(((r["channel"], r["why"]) for r in rows if r["root"] == root), key=lambda p: (p[1], p[0]))
    assert all(by(every, r) == w and by(few, r) == w[:5] for r, w in want.items())
    assert all(r["n"] == len(want[r["root"]]) for r in few)
    assert written() < 60
