"""The p1_ to p5_ queries on tables with columns of clashing names, rows of nulls and every row twice."""

import os

import pytest
from oracle import canon
from pyspark.sql import functions as F

from ripplemark.plans import data_queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
TABLES = ["symbol", "core_symbol", "dep", "provider_edge", "provider_result", "symbol_version", "report_raw"]
CLASH = ["_bin", "_lead", "_shards", "_slot", "_unit", "node", "side", "other", "up", "ptr", "dist", "done", "v", "doc", "doc_key", "row_key", "pos", "snap", "bucket", "key", "src", "row_id", "ref_id", "at", "spans", "null_mask"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        nulls = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        df = df.unionByName(df).unionByName(nulls)
        for c in CLASH:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.repartition(3).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_result(spark, odd, name):
    a, b = Q.QUERIES[name](spark, DATA), Q.QUERIES[name](spark, odd)
    x, y = canon(a.collect(), a.columns), canon(b.collect(), b.columns)
    if name == "p1_kind_matrix":  # the rows of nulls are one edge without ends or relation
        y.remove("None|None|1|None")
    assert a.columns == b.columns and x == y


def test_hubs_are_found_with_a_third_of_all_rows(spark, tmp_path):
    n = 3000
    e = spark.range(n).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, " hub ").otherwise(F.concat(F.lit("d"), F.col("id"))).alias("dependency"), F.concat(F.lit("t"), F.col("id") % 200).alias("dependent"),
        F.lit(" CONTAINS").alias("relation"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(None).cast("timestamp_ntz").alias("seen_at"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"),
    )
    e.write.parquet(f"{tmp_path}/dep.parquet")
    assert [tuple(r) for r in Q.p1_found(spark, str(tmp_path)).collect()] == [("dependency", "hub")]
    loads = {(r["side"], r["node"]): (r["edges"], r["counterparts"]) for r in Q.p1_node_loads(spark, str(tmp_path)).where("node = 'hub'").collect()}
    assert loads == {("dependency", "hub"): (1000, 200)}
