import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ripplemark.operators import skew

SCHEMA = "ord bigint, dependency string, dependent string, seen_at timestamp_ntz"


def brute(rows):
    out = defaultdict(lambda: [set(), set(), [], 0])
    for ord_, a, b, at in rows:
        for side, node, other in (("dependency", a, b), ("dependent", b, a)):
            if node is None:
                continue
            s = out[(side, node)]
            s[0].add(ord_)
            if other is not None:
                s[1].add(other)
            s[2].append(at)
    return {k: (len(v[0]), len(v[1]), min(v[2]), max(v[2])) for k, v in out.items()}


def got(df):
    return {(r["side"], r["node"]): (r["edges"], r["counterparts"], r["first_seen_at"], r["last_seen_at"]) for r in df.collect()}


def edges(seed, n=3000):
    import datetime as dt

    r = random.Random(seed)
    out = []
    for i in range(n):
        a = "hub" if r.random() < 0.4 else f"a{r.randint(0, 300)}"
        b = r.choice([None, "sink", f"b{r.randint(0, 400)}", f"b{r.randint(0, 9)}"])
        if r.random() < 0.35:
            a, b = "hub", "sink"
        row = (i, a, b, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=r.randint(0, 9999)))
        out += [row] * r.choice([1, 1, 1, 2, 3])
    return out


@pytest.mark.parametrize("one_in", [1, 16])
def test_node_loads(spark, one_in):
    rows = edges(one_in)
    assert got(skew.node_loads(spark.createDataFrame(rows, SCHEMA), one_in, bins=6)) == brute(rows)


def test_node_loads_of_nothing_and_of_nulls(spark):
    assert skew.node_loads(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a", None, None), (None, "a", None, None), (1, None, None, None)]
    assert got(skew.node_loads(spark.createDataFrame(rows, SCHEMA))) == {("dependency", "a"): (1, 0, None, None)}


def test_large_keys_are_split_and_bins_even(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"), "id")
    plan = skew.plan_loads(df, ["k"], bins=8)
    hot = plan.heavy.collect()
    assert [r["k"] for r in hot] == ["hot"] and hot[0]["_shards"] >= 5
    assert max(plan.loads) < 1.25 * sum(plan.loads) / 8
    sizes = [r["n"] for r in skew.fragment(df, plan, ["id"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1.4 * 20000 / 8


def test_no_exchange_after_fragmenting(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    plan = skew.plan_loads(df, ["k"], bins=4)
    f = skew.fragment(df, plan, ["id"]).groupBy("_bin", "k").count()
    text = f._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") - text.count("BroadcastExchange") == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_the_plain_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (77, "q")], "k int, v string")
    a = skew.skew_join(left, right, ["k"], ["id"], how, bins=5)
    b = left.join(right, ["k"], how)
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_skew_join_refuses_others(spark):
    with pytest.raises(ValueError):
        skew.skew_join(spark.range(1), spark.range(1), ["id"], ["id"], "full")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_keep_the_placement(spark, how):
    left = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 4000).cast("int").alias("k"), "id")
    right = spark.range(2000).select(F.col("id").cast("int").alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = skew.skew_join(left, right, ["k"], ["id"], how, bins=6)
        j.write.format("noop").mode("overwrite").save()
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("direct_shuffle_partition_id") == 2 and "ENSURE_REQUIREMENTS" not in join.split("distinct")[0].split("HashAggregate")[0]
