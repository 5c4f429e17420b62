"""Ranks over whole tables and first-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.runtime import Staged


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1.. in an order, without one task that sees them all.

    Rows are range-partitioned by the order and sorted within; each partition numbers its own, and the partitions' sizes,
    one number a partition, give the offsets. The order should be total; rows that tie share no rank but may swap."""
    spark = df.sparkSession
    # written first, as the bounds of the ranges are found by a pass of their own
    ranged = Staged(df, "unranked").df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    held = Staged(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_own", own), "rank").df
    sizes = {r["_pid"]: r["n"] for r in held.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, at = [], 0
    for pid in sorted(sizes):
        rows.append((pid, at))
        at += sizes[pid]
    offsets = spark.createDataFrame(rows, "_pid int, _at bigint")
    return held.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_own") + F.col("_at")).drop("_pid", "_own", "_at")


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def log_bucket(c: Column) -> Column:
    """floor(log2(1 + c)), without the rounding of a cast."""
    return F.floor(F.log2(F.lit(1) + c)).cast("int")
