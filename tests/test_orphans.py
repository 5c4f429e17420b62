import datetime as dt
import random

from ripplemark.operators import orphans as O

T = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
REFS = "src string, row_id bigint, ref_id string, at timestamp_ntz, x int"
LIVES = "id string, born timestamp_ntz, gone timestamp_ntz, x int"


def brute(refs, lives):
    out = set()
    for s, r, i, at, _ in refs:
        if i is None:
            continue
        mine = [(b, g) for n, b, g, _ in lives if n == i]
        if at is None:
            if not mine:
                out.add((s, r, i, at, "missing"))
            continue
        if any((b is None or b <= at) and (g is None or g > at) for b, g in mine):
            continue
        out.add((s, r, i, at, "missing" if not mine else "deleted" if any(g is not None and g <= at for _, g in mine) else "late"))
    return out


def test_periods(spark, monkeypatch):
    r = random.Random(1)
    lives = [(f"s{r.randint(0, 40)}", r.choice([None, T(r.randint(0, 50))]), r.choice([None, T(r.randint(51, 99))]), 1) for _ in range(60)]
    lives = [x for x in lives if not (x[0] == "s7")] + [("s7", T(10), T(20), 1), ("s7", T(30), None, 1), (None, T(1), None, 1)] * 2
    refs = [("dep", k, r.choice([None, "s7", "nowhere", f"s{r.randint(0, 45)}"]), r.choice([None, T(r.randint(0, 120)), T(10), T(20), T(30)]), 2) for k in range(800)]
    refs += refs[:50] + [("dep", 5000 + k, "hot", T(k % 100), 0) for k in range(500)]
    lives += [("hot", T(k), T(k + 1), 0) for k in range(0, 100, 2)]
    df, lv = spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES).select("id", "born", "gone")
    want = brute(refs, lives)
    assert {tuple(x) for x in O.period_orphans(df.drop("x"), lv).collect()} == want
    monkeypatch.setattr(O, "PERIODS_IN_ARRAY", 3)
    got = [tuple(x) for x in O.period_orphans(df.drop("x"), lv).collect()]
    assert set(got) == want and len(got) == len(want)


def test_nothing(spark):
    no_refs, no_lives = spark.createDataFrame([], REFS).drop("x"), spark.createDataFrame([], LIVES).drop("x")
    assert O.period_orphans(no_refs, no_lives).collect() == []
    one = spark.createDataFrame([("a", 1, "i", T(1), 0)], REFS).drop("x")
    assert [r["reason"] for r in O.period_orphans(one, no_lives).collect()] == ["missing"]


def test_masks(spark):
    refs = spark.createDataFrame([(1, "a", "f"), (2, "a", None), (3, "z", None), (4, None, "f"), (5, None, "g"), (6, None, None), (7, "a", "g"), (8, "a", "f"), (7, "a", "g")], "id int, k string, file string")
    target = spark.createDataFrame([("a", "f"), (None, "g2"), ("b", None)], "tk string, tf string")

    def ids(match):
        return sorted((r["id"], r["null_mask"]) for r in O.orphans_by_mask(refs, ["k", "file"], target, ["tk", "tf"], match, ["id"]).collect())

    assert ids("simple") == [(7, ".."), (7, "..")]
    assert ids("partial") == [(3, ".0"), (5, "0."), (7, ".."), (7, "..")]
    assert ids("full") == [(2, ".0"), (3, ".0"), (4, "0."), (5, "0."), (7, ".."), (7, "..")]


def test_all_masks_of_a_period(spark):
    refs = spark.createDataFrame([("a", 1, "i", T(5), 0), ("a", 2, "i", T(15), 0), ("a", 3, "i", None, 0), ("a", 4, "n", None, 0), ("a", 5, None, T(5), 0), ("a", 6, None, None, 0), ("a", 7, "n", T(1), 0)], REFS)
    lives = spark.createDataFrame([("i", T(0), T(10), 0), (None, T(0), None, 0)], LIVES)
    o = O.orphans_by_mask(refs, ["ref_id", "at"], lives, ["id"], "partial", ["row_id"], O.Period("at", "born", "gone"), ("ref_id",))
    assert sorted((r["row_id"], r["null_mask"], r["known"]) for r in o.collect()) == [(2, "..", True), (4, ".0", False), (7, "..", False)]
    simple = O.orphans_by_mask(refs, ["ref_id", "at"], lives, ["id"], "simple", ["row_id"], O.Period("at", "born", "gone"))
    assert sorted(r["row_id"] for r in simple.collect()) == [2, 7]
    full = O.orphans_by_mask(refs, ["ref_id", "at"], lives, ["id"], "full", ["row_id"], O.Period("at", "born", "gone"))
    assert sorted((r["row_id"], r["null_mask"]) for r in full.collect()) == [(2, ".."), (3, ".0"), (4, ".0"), (5, "0."), (7, "..")]
