"""The p6_ to p8_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm import encoding, leakage, quality


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- 6: encoding of the whole corpus


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(_read(spark, d, "documents").select("doc_id", "text"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are not their text again (a null text counts as empty): none."""
    docs = _read(spark, d, "documents").select("doc_id", "text")
    back = encoding.decode(encoding.encode(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("back"))).select("doc_id")


def p6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "source")
    n = p6_ids(spark, d).select("doc_id", F.size("ids").alias("n"))
    return docs.join(n, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


# --- 7: evaluation texts in training text


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "eval_item").select("item_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


# --- 8: text quality


def _common(spark: SparkSession, d: str) -> dict[str, set[str]]:
    """The common words by language: a fixed table of some hundred rows."""
    out: dict[str, set[str]] = {}
    for r in _read(spark, d, "common_word").where("lang is not null and word is not null").collect():
        out.setdefault(r["lang"], set()).add(r["word"].casefold())
    return out


def p8_basic(spark: SparkSession, d: str) -> DataFrame:
    words = set().union(*_common(spark, d).values(), set())
    cols = quality.basic(F.col("text"), sorted(words))
    return _read(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()])


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    return quality.measure(_read(spark, d, "documents").select("doc_id", "text"), _common(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_repetition(spark, d).where(F.col("no_prose") >= quality.NO_PROSE).select("doc_id")


QUERIES = {f.__name__: f for f in (p6_ids, p6_round_trip, p6_token_counts, p7_found, p7_leaks, p7_items, p8_found, p8_repetition, p8_basic)}

_WS = r"[ \t\n\x0B\f\r]"
_TRIMMED = ".,;:!?()[]{}\"''`*_"

ORACLE = {
    "p6_round_trip": "select doc_id from documents where false",
    "p8_basic": rf"""with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') ws, regexp_replace(text, '{_WS}', '', 'g') vis,
        list_filter(regexp_split_to_array(text, '[\r\n]+'), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') ls from documents)
      select doc_id, cast(case when len(ws) > 0 then len(ws) else 0 end as bigint) words,
        case when len(ws) > 0 then length(vis) / len(ws) end mean_word_length,
        case when len(ws) > 0 then length(regexp_replace(vis, '[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]', '', 'g')) / length(vis) end symbol_ratio,
        case when len(ws) > 0 then len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;]{_WS}*$'))) / len(ls) end punctuated_lines,
        case when len(ws) > 0 then len(list_filter(ws, lambda x: list_contains(known, lower(trim(x, '{_TRIMMED}'))))) / len(ws) end common_words
      from w, (select list(distinct lower(word)) known from common_word)""",
}
