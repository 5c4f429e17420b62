"""Work on keys of very uneven size, spread evenly: fragment-replicate by estimated load.

The load of every key is estimated; keys above half a task's share are split into shards in proportion to their load,
the others are hashed to small slots; shards and slots are bin-packed (largest first into the emptiest bin) onto tasks.
Rows travel to their bin by repartitionById, so the plan, not chance, decides who works on what. In a join, the
matching side is copied only to the bins that hold a shard of its key.

What reaches the driver is bounded by the number of bins: at most 2 keys a bin can be above half a share, and there are
`slots` slot sums a bin. Estimates only steer the placement: results are exact whatever they are.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.runtime import partitions

#: A key is split once it is expected to fill more than this share of a bin; a shard fills at most as much.
SHARE = 0.5
SLOTS_A_BIN = 16
#: Rows a bin is meant to hold, so that a task's work does not grow with the data, and the number of bins a plan has at
#: most; beyond that bins grow, and Spark spills.
ROWS_A_BIN = 1 << 18
MAX_BINS = 1 << 14


@dataclass
class LoadPlan:
    keys: list[str]
    bins: int
    slots: int
    heavy: DataFrame  # keys, _lead (first unit), _shards; at most bins / SHARE rows
    bin_of: list[int]  # unit -> bin: first the slots, then the shards
    loads: list[float]  # expected rows of each bin


def plan_loads(df: DataFrame, keys: list[str], sample_on: list[str] | None = None, one_in: int = 16, bins: int | None = None, slots_a_bin: int = SLOTS_A_BIN) -> LoadPlan:
    """Estimate loads by counting the rows whose hash of `sample_on` falls into one of `one_in` classes (all rows if
    sample_on is None) and pack them. An empty table gives a plan of equal slots."""
    picked = df if sample_on is None else df.where(F.pmod(F.xxhash64(*sample_on), F.lit(one_in)) == 0)
    counted = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        return plan_counts(counted, keys, 1 if sample_on is None else one_in, bins, slots_a_bin)
    finally:
        counted.unpersist()


def plan_counts(counted: DataFrame, keys: list[str], one_in: int = 1, bins: int | None = None, slots_a_bin: int = SLOTS_A_BIN) -> LoadPlan:
    """The plan for keys whose rows, one in so many, are counted in column n. There are as many bins as tasks of
    ROWS_A_BIN rows are needed, and no fewer than the session's shuffle partitions."""
    spark = counted.sparkSession
    if bins is None:
        rows = (counted.agg(F.sum("n")).first()[0] or 0) * one_in
        bins = min(MAX_BINS, max(partitions(spark), -(-rows // ROWS_A_BIN)))
    slots = bins * slots_a_bin
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")
    counted = counted.withColumn("_slot", slot)
    sums = [0] * slots
    for r in counted.groupBy("_slot").agg(F.sum("n").alias("n")).collect():
        sums[r["_slot"]] = r["n"]
    most = max(1.0, sum(sums) * SHARE / bins)
    large = counted.where(F.col("n") > most).orderBy(F.desc("n"), *keys).limit(int(bins / SHARE) + 1).collect()
    units: list[tuple[float, int]] = []
    rows, lead = [], slots
    for r in large:
        shards = math.ceil(r["n"] / most)
        sums[r["_slot"]] -= r["n"]
        rows.append((*[r[k] for k in keys], lead, shards))
        units += [(r["n"] / shards, lead + i) for i in range(shards)]
        lead += shards
    units += [(float(n), i) for i, n in enumerate(sums)]
    heap = [(0.0, b) for b in range(bins)]
    bin_of = [0] * lead
    for load, unit in sorted(units, key=lambda u: (-u[0], u[1])):
        at, b = heapq.heappop(heap)
        bin_of[unit] = b
        heapq.heappush(heap, (at + max(load, 1e-3), b))
    schema = T.StructType([counted.schema[k] for k in keys] + [T.StructField("_lead", T.IntegerType()), T.StructField("_shards", T.IntegerType())])
    for f in schema.fields:
        f.nullable = True
    loads = [0.0] * bins
    for at, b in heap:
        loads[b] = at
    return LoadPlan(keys, bins, slots, spark.createDataFrame(rows, schema), bin_of, loads)


def _bin(plan: LoadPlan, unit: Column) -> Column:
    """The bin of a unit. The mapping is one literal text, folded to an array when the query is planned."""
    return F.element_at(F.split(F.lit(",".join(map(str, plan.bin_of))), ",").cast("array<int>"), unit + 1)


def _with_heavy(df: DataFrame, plan: LoadPlan) -> DataFrame:
    names = {k: f"_h_{k}" for k in plan.keys}
    h = F.broadcast(plan.heavy.withColumnsRenamed(names))
    on = None
    for k, n in names.items():
        same = df[k].eqNullSafe(h[n])
        on = same if on is None else on & same
    return df.join(h, on, "left").drop(*names.values())


def fragment(df: DataFrame, plan: LoadPlan, spread: list[str]) -> DataFrame:
    """Send each row to its bin (column _bin). Rows of one key and the same values in `spread` meet in one bin. Rows
    with a null key, which match nothing, are spread too."""
    any_null = F.lit(False)
    for k in plan.keys:
        any_null = any_null | F.col(k).isNull()
    h = F.xxhash64(*spread)
    unit = (
        F.when(F.col("_lead").isNotNull(), F.col("_lead") + F.pmod(h, F.col("_shards")).cast("int"))
        .when(any_null, F.pmod(h, F.lit(plan.slots)).cast("int"))
        .otherwise(F.pmod(F.xxhash64(*plan.keys), F.lit(plan.slots)).cast("int"))
    )
    return _with_heavy(df, plan).withColumn("_bin", _bin(plan, unit)).drop("_lead", "_shards").repartitionById(plan.bins, F.col("_bin"))


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Copy each row of the matching side to every bin that holds a shard of its key, and to no other."""
    units = F.when(F.col("_lead").isNotNull(), F.sequence(F.col("_lead"), F.col("_lead") + F.col("_shards") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64(*plan.keys), F.lit(plan.slots)).cast("int"))
    )
    where = F.array_distinct(F.transform(units, lambda u: _bin(plan, u)))
    return _with_heavy(df, plan).withColumn("_bin", F.explode(where)).drop("_lead", "_shards").repartitionById(plan.bins, F.col("_bin"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "left", plan: LoadPlan | None = None, **estimate) -> DataFrame:
    """left join right on keys (equal names on both sides); the left side may be as uneven as it likes.

    how: inner, left, left_semi or left_anti. Null keys match nothing. Other columns of `right` must not clash.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no such join here: {how}")
    plan = plan or plan_loads(left, keys, **estimate)
    lf = fragment(left, plan, spread)
    if how in ("inner", "left"):
        return lf.join(replicate(right, plan), ["_bin", *keys], how).drop("_bin")
    # a semi or anti join would be pushed below the placement of the rows and lose it
    there = replicate(right.select(*keys).distinct(), plan).withColumn("_there", F.lit(True))
    j = lf.join(there, ["_bin", *keys], "left")
    return j.where(F.col("_there").isNotNull() if how == "left_semi" else F.col("_there").isNull()).select(*left.columns)


def node_loads(edges: DataFrame, one_in: int = 16, bins: int | None = None) -> DataFrame:
    """Per side and node of an edge table: edges, distinct counterparts, first and last seen_at.

    edges: ord, dependency, dependent, seen_at. An edge counts once per ord, whatever copies of it are delivered (a null
    ord is one edge of its own). Ids that are null belong to no node; a null counterpart is none. Shards of a large node
    are cut by the counterpart, so their distinct counts add up; copies of an edge share it and so meet in one shard.
    """
    both = edges.select(
        "ord",
        "seen_at",
        F.explode(
            F.array(
                F.struct(F.lit("dependency").alias("side"), F.col("dependency").alias("node"), F.col("dependent").alias("other")),
                F.struct(F.lit("dependent").alias("side"), F.col("dependent").alias("node"), F.col("dependency").alias("other")),
            )
        ).alias("e"),
    ).select("ord", "seen_at", "e.*")
    both = both.where(F.col("node").isNotNull())
    # one sample gives both plans: of nodes, and of pairs; pairs above a task's share of their own are cut by ord instead of
    # by the counterpart, and there are at most 2 a bin of them
    picked = both.where(F.pmod(F.xxhash64("ord"), F.lit(one_in)) == 0)
    sample = picked.groupBy("side", "node", "other").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        plan = plan_counts(sample.groupBy("side", "node").agg(F.sum("n").alias("n")), ["side", "node"], one_in, bins)
        pairs = plan_counts(sample, ["side", "node", "other"], one_in, plan.bins)
    finally:
        sample.unpersist()
    hot = F.col("_lead").isNotNull()
    cut = _with_heavy(both, pairs).withColumn("hot", hot).withColumn("_cut", F.when(hot, F.xxhash64("ord")).otherwise(F.xxhash64("other"))).drop("_lead", "_shards")
    cut = fragment(cut, plan, ["_cut"])
    per_edge = cut.groupBy("_bin", "side", "node", "other", "ord").agg(F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi"), F.max("hot").alias("hot"))
    per_pair = per_edge.groupBy("_bin", "side", "node", "other").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("hot").alias("hot"))
    per_shard = per_pair.groupBy("_bin", "side", "node").agg(
        F.sum("n").alias("n"),
        F.count(F.when(~F.col("hot"), F.col("other"))).alias("c"),
        F.collect_set(F.when(F.col("hot"), F.col("other"))).alias("hs"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    merged = per_shard.groupBy("side", "node").agg(F.sum("n").alias("edges"), F.sum("c").alias("c"), F.collect_list("hs").alias("hs"), F.min("lo").alias("first_seen_at"), F.max("hi").alias("last_seen_at"))
    hot_ones = F.size(F.array_distinct(F.flatten("hs")))
    return merged.select("side", "node", "edges", (F.col("c") + hot_ones).alias("counterparts"), "first_seen_at", "last_seen_at")
