"""Results of checks across analyses: carry-over by key, verdicts, validation, summaries, packets, and rank metrics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.text import glob_regex
from ripplemark.operators.ranking import global_rank

#: Rank of a truth no list holds.
MISSING = 10_000


def carry_over(cases: DataFrame, previous: DataFrame) -> DataFrame:
    """(key, verdict, state): results of an earlier analysis on the cases of a new one.

    cases: key, fingerprint; previous: key, fingerprint, verdict. state: new (no result), carried, needs_recheck (the code
    moved), orphaned (the case is gone). A full join by key; keys are unique on either side."""
    a, b = cases.alias("a"), previous.alias("b")
    j = a.join(b, F.col("a.key") == F.col("b.key"), "full")
    state = F.when(F.col("a.key").isNull(), "orphaned").when(F.col("b.key").isNull(), "new").when(F.col("a.fingerprint").eqNullSafe(F.col("b.fingerprint")), "carried").otherwise("needs_recheck")
    return j.select(F.coalesce("a.key", "b.key").alias("key"), F.col("b.verdict").alias("verdict"), state.alias("state"))


def annotate(cases: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with their verdict, and the verdicts that name no case.

    A case judged not_needed without a note, or pass_by_review without proof, still needs information; weak counts as
    not_needed. cases: id; verdicts: id, verdict, note, proof."""
    said = F.when(F.col("verdict") == "weak", "not_needed").otherwise(F.col("verdict"))
    note, proof = (F.coalesce(F.btrim(c), F.lit("")) != "" for c in ("note", "proof"))
    v = verdicts.withColumn("verdict", F.when((said == "not_needed") & ~note, "needs_info").when((said == "pass_by_review") & ~proof, "needs_info").otherwise(said))
    return cases.join(v.select("id", "verdict"), "id", "left"), v.join(cases.select("id").distinct(), "id", "left_anti")


def action(verdict: Column, verify_by: Column) -> Column:
    """Final bucket of a case."""
    return (
        F.when(verdict == "pass_by_review", "closed_by_review")
        .when(verdict.isin("not_needed", "weak"), "not_needed")
        .when((verify_by == "target") | verdict.isNotNull(), "test_on_target")
        .otherwise("review")
    )


def problems(rules: list[tuple[Column, str]]) -> Column:
    """The texts of all rules that hold, in order; a null condition does not hold."""
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull())


def packets(cases: DataFrame, by: list[str], order: list[Column], size: int = 8) -> DataFrame:
    """(by, cases, batch): groups of cases by evidence, the largest first, dealt into batches of `size`."""
    g = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"))
    r = global_rank(g, order, "rn")
    return r.select(*by, "cases", F.floor((F.col("rn") - 1) / F.lit(size)).cast("int").alias("batch"))


def first_hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, rank): the least rank of a truth in each query's list; MISSING where there is none.

    ranked: query, item, rank; truth: query, item. Queries without truth are not scored."""
    hit = ranked.join(truth.select("query", "item").distinct(), ["query", "item"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return truth.select("query").distinct().join(hit, "query", "left").select("query", F.coalesce("rank", F.lit(MISSING)).cast("bigint").alias("rank"))


def metrics(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Queries, mean reciprocal rank, hits among the first 10 and 20, median rank and misses."""
    r = F.col("rank")
    return hits.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(F.when(r < MISSING, 1 / r).otherwise(F.lit(0.0))), 9).alias("mrr"),
        F.count_if(r <= 10).alias("top10"),
        F.count_if(r <= 20).alias("top20"),
        F.median(r).alias("median"),
        F.count_if(r == MISSING).alias("missed"),
    )


def first_seen_rank(ranked: DataFrame) -> DataFrame:
    """(query, symbol, symbol_rank): how many distinct symbols a list shows up to the first place of each."""
    f = ranked.groupBy("query", "symbol").agg(F.min("rank").alias("at"))
    return f.withColumn("symbol_rank", F.row_number().over(Window.partitionBy("query").orderBy("at"))).select("query", "symbol", "symbol_rank")


def shape(text: Column) -> Column:
    """A text with numbers and quoted names masked, to count misses by shape."""
    return F.regexp_replace(F.regexp_replace(text, r"`[^`]*`|'[^']*'|\"[^\"]*\"", "_"), "[0-9]+", "0")


@dataclass(frozen=True)
class Lesson:
    """What a team learnt: conditions that must all hold; one that is not given always does."""

    id: str
    tokens_any: tuple[str, ...] = ()
    name_glob: str | None = None
    path_glob: str | None = None
    sub_reason: str | None = None

    def holds(self) -> Column:
        """On rows with name, file, tokens and sub_reason; a name may match whole or by its last part."""
        c = []
        if self.tokens_any:
            c.append(F.arrays_overlap("tokens", F.lit(list(self.tokens_any))))
        if self.name_glob:
            rx = glob_regex(self.name_glob)
            c.append(F.col("name").rlike(rx) | F.element_at(F.split("name", "::"), -1).rlike(rx))
        if self.path_glob:
            c.append(F.col("file").rlike(glob_regex(self.path_glob)))
        if self.sub_reason:
            c.append(F.col("sub_reason") == self.sub_reason)
        return F.coalesce(reduce(lambda a, b: a & b, c, F.lit(True)), F.lit(False))


def match_lessons(rows: DataFrame, lessons: list[Lesson]) -> DataFrame:
    """rows with the column lesson, once for each lesson that applies: a projection, as lessons are a short list."""
    ids = F.filter(F.array(*[F.when(x.holds(), F.lit(x.id)) for x in lessons]), lambda i: i.isNotNull()) if lessons else F.expr("cast(array() as array<string>)")
    return rows.withColumn("lesson", F.explode(ids))


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens read and written, and cost, of a model's calls: by, input_tokens, cached_tokens, output_tokens, cost.
    What a call does not say counts as nothing."""
    total = lambda *cs: F.sum(sum((F.coalesce(F.col(c), F.lit(0)) for c in cs), F.lit(0)))
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), total("input_tokens", "cached_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), F.round(total("cost"), 6).alias("cost"))


def summarise(results: DataFrame, by: list[str], verdicts: list[str]) -> DataFrame:
    """Of the results of checks: how many have each verdict, none, or one that is not known; how many the code moved under;
    their number, whether all have one, and the bytes attached. results: by, verdict, needs_recheck, bytes."""
    v = F.col("verdict")
    some = v.isNotNull() & (F.btrim("verdict") != "")
    return results.groupBy(*by).agg(
        *[F.count_if(v == x).alias(x) for x in verdicts],
        F.count_if(~F.coalesce(some, F.lit(False))).alias("untested"),
        F.count_if(some & ~v.isin(*verdicts)).alias("invalid"),
        F.count_if(F.coalesce("needs_recheck", F.lit(False))).alias("recheck"),
        F.count(F.lit(1)).alias("total"),
        F.bool_and(F.coalesce(some & v.isin(*verdicts), F.lit(False))).alias("complete"),
        F.sum(F.coalesce("bytes", F.lit(0))).cast("bigint").alias("bytes"),
    )
