"""The p6_ to p8_ queries on tables with columns of clashing names, rows of nulls and repeated texts."""

import os

import pytest
from oracle import canon
from pyspark.sql import functions as F

from ripplemark.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
CLASH = ["doc", "ids", "chunk", "part", "last", "item", "words", "no_prose", "t", "k"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("oddllm"))
    for t in ("documents", "eval_item", "common_word"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        if t == "common_word":
            df = df.unionByName(df).unionByName(spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
        if t == "eval_item":
            df = df.unionByName(spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
        for c in CLASH:
            df = df.withColumn(c, F.lit("clash"))
        df.repartition(3).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_result(spark, odd, name):
    a, b = Q.QUERIES[name](spark, DATA), Q.QUERIES[name](spark, odd)
    assert a.columns == b.columns and canon(a.collect(), a.columns) == canon(b.collect(), b.columns)


def test_one_text_far_longer_than_the_rest(spark, tmp_path):
    long = "The lock was taken in the wrong order, and the thread was not woken. " * 20000
    rows = [(1, long), (2, "short"), (3, None), (4, ""), (5, " " * 50000), (6, "x" * 200000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, long)], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_item.parquet")
    spark.createDataFrame([("en", "the"), ("en", "was"), ("en", "in"), ("en", "and"), ("en", "not")], "lang string, word string").write.parquet(f"{tmp_path}/common_word.parquet")
    d = str(tmp_path)
    assert Q.p6_round_trip(spark, d).count() == 0
    n = {r["doc_id"]: len(r["ids"]) for r in Q.p6_ids(spark, d).collect()}
    assert n[3] == n[4] == 0 and n[1] > 200000 and n[5] > 0 and n[6] > 0
    assert {r["doc_id"] for r in Q.p8_found(spark, d).collect()} == {1, 6}  # one sentence without end is junk as well
    assert [tuple(r) for r in Q.p7_found(spark, d).collect()] == [(1, 1)]
    assert Q.p8_basic(spark, d).count() == 6
