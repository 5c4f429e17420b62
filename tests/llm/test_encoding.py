import random

import pytest
from pyspark.sql import functions as F

from ripplemark.llm import encoding as E

SCHEMA = "doc_id bigint, text string"
ODD = [None, "", " ", "a", "<|endoftext|> plain", "don't WE'LL I'VE", "x" * 5000, " " * 3000, "\n\n\r\n\t", "é é ﬁ ①", "số liệu đã đổi", "𝔘𝔫𝔦 👩‍👩‍👧 ​", "1234567890" * 400, "...!!!" * 500, "a b" + " " * 700 + "c"]


def reference():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def ids_of(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: r["ids"] for r in E.encode(df, **kw).collect()}


def test_same_ids_as_the_other_library(spark):
    t = reference()
    got = ids_of(spark, ODD)
    for i, x in enumerate(ODD):
        assert got[i] == ([] if not x else t.encode(x, add_special_tokens=False).ids)


def test_chunks_make_no_difference(spark):
    random.seed(4)
    pieces = ["word", " two", "  ", "\n", "'s", "I'll", "foo::bar()", " 12", "é", "đã", "!!", " ", " x" * 9, "\t\t"]
    long = ["".join(random.choice(pieces) for _ in range(random.randint(50, 900))) for _ in range(12)]
    got = ids_of(spark, ODD + long, chunk=200, overlap=40)
    e = E.encoder()
    for i, x in enumerate(ODD + long):
        assert got[i] == (e.encode_ordinary(x) if x else []), repr(x)[:80]


def test_chunk_that_begins_behind_white_space(spark):
    texts = [("word " * 20)[: 64 - len(x)] + x + "bar" + " more words" * 20 for x in ("\n\n", "\r\n", " \t", "\n \n\n", "\t\t", "\n")]
    e, got = E.encoder(), ids_of(spark, texts, chunk=64, overlap=16)
    assert [got[i] for i in range(len(texts))] == [e.encode_ordinary(x) for x in texts]


def test_round_trip(spark):
    texts = [x for x in ODD if x]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    back = {r["doc_id"]: r["text"] for r in E.decode(E.encode(df, chunk=150, overlap=30)).collect()}
    assert back == dict(enumerate(texts))


def test_empty_table_and_extra_columns(spark):
    assert E.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b", "z")], SCHEMA + ", ids string").withColumn("doc", F.lit(5))
    assert E.encode(df).first()["ids"] == E.encoder().encode_ordinary("a b")


@pytest.mark.parametrize("text", ["ab  cd", "ab \n cd", "it's'll", "  lead", "x" * 90 + " y"])
def test_boundaries_agree_after_meeting(text):
    full = E.boundaries(text, 0, len(text))
    for start in range(len(text)):
        part = [start + p for p in E.boundaries(text[start:], 0, len(text))]
        common = [p for p in part if p in full]
        if common:
            assert [p for p in part if p >= common[0]] == [p for p in full if p >= common[0]]
