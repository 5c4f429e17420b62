import random

import pytest

from ripplemark.operators.hierarchy import descendants, one_parent, solve


def brute(up):
    out = {}
    for n in set(up) | set(up.values()):
        path, seen = [n], {n}
        while path[-1] in up and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if path[-1] not in up:
            out[n] = (path[-1], len(path) - 1, "tree")
        else:
            ring, x = [], up[path[-1]]
            while x not in ring:
                ring.append(x)
                x = up[x]
            out[n] = (min(ring), -1, "on_cycle" if n in ring else "below_cycle")
    return out


def forest(seed, n=400):
    r = random.Random(seed)
    up = {f"n{i}": f"n{r.randint(max(0, i - 3), i - 1)}" for i in range(1, n)}
    up |= {f"c{i}": f"c{i - 1}" for i in range(1, 150)}  # a long chain
    for k, size in enumerate((1, 2, 3, 40)):
        up |= {f"r{k}_{i}": f"r{k}_{(i + 1) % size}" for i in range(size)}
        up |= {f"u{k}_{i}": r.choice([f"r{k}_{i % size}", f"u{k}_{i - 1}" if i else f"r{k}_0"]) for i in range(60)}
    return up


@pytest.mark.parametrize("one_in", [1, 3, 8, 1000])
def test_against_brute_force(spark, one_in):
    up = forest(one_in)
    f = solve(spark.createDataFrame(list(up.items()), "node string, up string"), with_paths=True, one_in=one_in)
    assert {r["node"]: (r["root"], r["depth"], r["status"]) for r in f.nodes.collect()} == brute(up)
    want = {}
    for n, (_, d, s) in brute(up).items():
        if s == "tree":
            p = [n]
            while p[-1] in up:
                p.append(up[p[-1]])
            want[n] = p[::-1]
    assert {r["node"]: r["path"] for r in f.paths.collect()} == want
    pairs = {(a, p[-1], len(p) - 1 - i) for p in want.values() for i, a in enumerate(p[:-1])}
    assert {tuple(r) for r in descendants(f.paths).collect()} == pairs


def test_hub_and_nothing(spark):
    star = {f"s{i}": "hub" for i in range(2000)} | {"hub": "top"}
    f = solve(spark.createDataFrame(list(star.items()), "node string, up string"))
    assert {r["node"]: (r["root"], r["depth"], r["status"]) for r in f.nodes.collect()} == brute(star)
    assert solve(spark.createDataFrame([], "node string, up string")).nodes.collect() == []


def test_one_parent(spark):
    e = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), ("c", None), ("a", "x")], "p string, c string")
    assert [tuple(r) for r in one_parent(e, "p", "c").collect()] == [("x", "a")]
