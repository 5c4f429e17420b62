"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.ids import clean_id, clean_word


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dep with tidy ids and relations; rows as delivered, so an ord may come more than once."""
    return table(spark, sf_dir, "dep").select(
        "ord",
        clean_id("dependency").alias("dependency"),
        clean_id("dependent").alias("dependent"),
        clean_word("relation").alias("relation"),
        "file",
        "line",
        "seen_at",
    )


def provider_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "provider_edge").select(
        "edge_id",
        "run_id",
        clean_id("dependency").alias("dependency"),
        clean_id("dependent").alias("dependent"),
        clean_word("relation").alias("relation"),
        "file",
        "line",
        "confidence",
        "heuristic",
        "seen_at",
    )


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, born, gone): every life of every symbol, of both symbol tables; repeated rows may remain."""
    cols = [clean_id("id").alias("id"), F.col("first_seen").alias("born"), F.col("removed_at").alias("gone")]
    return (
        table(spark, sf_dir, "symbol")
        .select(*cols)
        .unionByName(table(spark, sf_dir, "core_symbol").select(*cols))
        .where(F.col("id").isNotNull())
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id: the latest life (first_seen, then file and line decide), of both symbol tables."""
    cols = ["id", "name", "spelling", "kind", "file", "line", "end_line", "first_seen"]
    both = table(spark, sf_dir, "symbol").select(*cols, "is_def", "is_virtual", "parent", "display").unionByName(
        table(spark, sf_dir, "core_symbol").select(*cols), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c != "id"]
    return (
        both.withColumn("id", clean_id("id"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("first_seen", "file", "line", *[c for c in rest if c not in ("first_seen", "file", "line")])).alias("s"))
        .select("id", *[F.col(f"s.{c}").alias(c) for c in rest])
    )
