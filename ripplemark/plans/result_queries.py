"""Queries over results, verdicts and metrics, data flow, edit shapes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.functions import scanners as Z
from ripplemark.functions import text as X
from ripplemark.operators import flow, results
from ripplemark.operators.changes import innermost
from ripplemark.operators.ranking import global_rank
from ripplemark.plans import bindings as B
from ripplemark.plans.bindings import E, L, S, V
from ripplemark.sources.tables import table
from ripplemark.streaming.incremental import daily_counts

# --- results and verdicts: orders stand for the results of an earlier run, customers and parts for cases


def carry_over(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linestatus").alias("fingerprint"))
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderpriority").alias("verdict"))
    return results.carry_over(new, old)


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    verdict = F.when(F.col("o_orderstatus") == "F", "pass_by_review").when(F.col("o_orderstatus") == "P", "weak").otherwise("confirmed")
    note = F.when(~F.col("o_orderpriority").contains("NOT"), F.col("o_orderpriority"))
    return o.select(F.col("o_custkey").alias("id"), verdict.alias("verdict"), note.alias("note"), F.when(F.col("o_totalprice") > 100000, F.lit("src/a.cc:1")).alias("proof"))


def annotate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return results.annotate(c, _verdicts(spark, d))[0]


def annotate_unknown(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return results.annotate(c, _verdicts(spark, d))[1].groupBy("verdict").agg(F.count(F.lit(1)).alias("verdicts"))


def action_bucket(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "target").otherwise("review").alias("verify_by"))
    j = results.annotate(c, _verdicts(spark, d))[0]
    return j.groupBy(results.action(F.col("verdict"), F.col("verify_by")).alias("bucket")).agg(F.count(F.lit(1)).alias("cases"))


def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Edges of providers by what is wrong with them."""
    rules = [
        (F.col("dependent").isNull(), "no dependent"),
        (F.col("dependency").isNull(), "no dependency"),
        (F.col("confidence").isNull(), "no confidence"),
        ((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"),
        (F.col("line") < 1, "line before the first"),
        (F.col("dependent") == F.col("dependency"), "depends on itself"),
    ]
    p = B.T.provider_edges(spark, d).dropDuplicates(["edge_id"])
    return p.select("edge_id", F.array_join(results.problems(rules), "; ").alias("problems")).where("problems <> ''")


VERDICTS = ["pass", "fail", "blocked"]


def results_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders as results of a run: open ones have no verdict, ones in progress an unknown one, low priorities none at all."""
    s = F.col("o_orderstatus")
    verdict = F.when(F.col("o_orderpriority").startswith("5") & (s == "O"), F.lit(None)).when(s == "F", "pass").when(s == "P", "odd").when(F.col("o_totalprice") > 200000, "fail").otherwise("")
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), verdict.alias("verdict"), (s == "P").alias("needs_recheck"), F.floor("o_totalprice").alias("bytes"))
    return results.summarise(o, ["run"], VERDICTS)


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Lines as calls of a model, by ship flag."""
    c = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("input_tokens"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("cached_tokens"), F.col("l_quantity").cast("bigint").alias("output_tokens"), F.col("l_linenumber").cast("double").alias("cost"))
    return results.usage_totals(c, ["run"])


def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges by relation and origin, one column an origin."""
    a = B.edges(spark, d).select("relation", F.lit("index").alias("origin"))
    b = B.provider(spark, d).select("relation", F.when(F.col("run_id") % 2 == 0, "even").otherwise("odd").alias("origin"))
    return a.unionByName(b).groupBy("relation").pivot("origin", ["index", "even", "odd"]).count().na.fill(0)


def packets(spark: SparkSession, d: str) -> DataFrame:
    s = B.symbols(spark, d).where("file is not null")
    return results.packets(s, ["file"], [F.desc("cases"), F.col("file")])


# --- metrics: the customers of a nation as its list, ranked in several ways


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("item"), "c_acctbal", "c_mktsegment")
    t = table(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("item")).distinct()
    return c, c.select("query", "item").join(t, "item", "left_semi")


def _by(c: DataFrame, *order: F.Column) -> DataFrame:
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order, "item")))


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    c, truth = _lists(spark, d)
    hits = results.first_hits(_by(c, F.desc("c_acctbal")), truth)
    return results.metrics(hits.withColumn("part", F.when(F.col("query") % 2 == 0, "dev").otherwise("holdout")), ["part"])


def rank_lab(spark: SparkSession, d: str) -> DataFrame:
    c, truth = _lists(spark, d)
    rankers = {"balance": [F.desc("c_acctbal")], "poorest": [F.col("c_acctbal")], "segment": [F.col("c_mktsegment"), F.desc("c_acctbal")]}
    out = None
    for name, order in rankers.items():
        one = results.first_hits(_by(c, *order), truth).withColumn("ranker", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return results.metrics(out, ["ranker"])


def symbol_ranks(spark: SparkSession, d: str) -> DataFrame:
    c, _ = _lists(spark, d)
    return results.first_seen_rank(_by(c, F.desc("c_acctbal")).withColumnRenamed("c_mktsegment", "symbol"))


def ai_triage(spark: SparkSession, d: str) -> DataFrame:
    """All cases in one order: verdict first, then the earlier rank."""
    c = annotate(spark, d)
    place = F.coalesce(F.element_at(F.create_map(F.lit("confirmed"), F.lit(0), F.lit("needs_info"), F.lit(1), F.lit("not_needed"), F.lit(3)), F.coalesce("verdict", F.lit("none"))), F.lit(2))
    return global_rank(c.withColumn("place", place), [F.col("place"), F.col("id")], "rn").select("rn", "id")


def truth_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the last snapshot around provider edges' lines that were there in the snapshot before too."""
    old, new = B.last_two(spark, d)
    p = B.provider(spark, d).where("file is not null and line is not null").select("file", "line").distinct()
    f = innermost(p, new.select("file", "usr", "start_line", "end_line")).where("usr is not null").select("usr").distinct()
    return f.join(old.select("usr"), "usr", "left_semi")


def seeded_score(spark: SparkSession, d: str) -> DataFrame:
    """For each folder the first symbol, by place, that is named like one of the base library."""
    s = B.symbols(spark, d).where("name is not null and file is not null")
    victims = table(spark, d, "core_symbol").select(F.regexp_extract("spelling", "^[a-z]+", 0).alias("tail")).where("tail <> ''").distinct()
    r = s.withColumn("set", F.regexp_extract("file", r"^([^/]+/[^/]+)/", 1)).withColumn("rank", F.row_number().over(Window.partitionBy("set").orderBy("file", F.asc_nulls_first("line"), "id")))
    hit = r.withColumn("tail", F.regexp_extract("spelling", "^[a-z]+", 0)).join(victims, "tail", "left_semi")
    return hit.groupBy("set").agg(F.min("rank").alias("rank")).select("set", "rank", (F.col("rank") - 1).alias("noise"))


def shape_counts(spark: SparkSession, d: str) -> DataFrame:
    x = B.lines(spark, d).where(F.length("text") >= 20).select(results.shape(F.col("text")).alias("shape"))
    return x.groupBy(F.md5("shape").alias("digest")).agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")


# --- data flow, over the listings among the documents

HEAD = r"^[a-z ]+[A-Za-z]+::[A-Za-z_]+\([^)]*\) \{"
ASSIGN = r"^ *([A-Za-z_]+) = ([A-Za-z_]+)\(([A-Za-z_]+)"


def _defs(spark: SparkSession, d: str) -> DataFrame:
    return flow.definitions(B.lines(spark, d), HEAD, ASSIGN)


def store_readers(spark: SparkSession, d: str) -> DataFrame:
    return flow.store_readers(_defs(spark, d), "^m_")


def taint(spark: SparkSession, d: str) -> DataFrame:
    x = _defs(spark, d)
    first = x.groupBy("file", "fn").agg(F.min("no").alias("no")).select("file", "no")
    return flow.taint(x, first)


# --- scanners


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    return Z.function_table(table(spark, d, "documents").select("doc_id", "text"))


def edit_shapes(spark: SparkSession, d: str) -> DataFrame:
    return Z.shape_table(X.parse_diff(B.lines(spark, d)))


def mask_literals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return Z.per_text(docs, "doc_id", "text", "file bigint, quoted bigint", lambda t: [(sum(a != b for a, b in zip(t, Z.mask_literals(t))),)])


def cond_stack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return Z.per_text(docs, "doc_id", "text", "file bigint, no int, conditions string", lambda t: [(i + 1, " && ".join(c)) for i, c in enumerate(Z.conditions_of(t.split("\n"))) if c])


def guard_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")

    def scopes(t: str) -> list[tuple]:
        lines = t.split("\n")
        s = Z.Scopes(lines)
        return [s.of(i + 1) for i, x in enumerate(lines) if x.lstrip().startswith("if (")]

    return Z.per_text(docs, "doc_id", "text", "file bigint, first int, last int", scopes)


def _decls(spark: SparkSession, d: str) -> DataFrame:
    """Declarations in listings, as text."""
    return B.lines(spark, d).where(F.col("text").rlike(HEAD)).select(F.col("file"), F.regexp_replace("text", r"\{.*$", "").alias("decl"))


def signature_parts(spark: SparkSession, d: str) -> DataFrame:
    return Z.per_text(_decls(spark, d), "file", "decl", "file bigint, pointers int, refs int", lambda t: [Z.passes_by(Z._TOKENS.findall(t))])


def input_classes(spark: SparkSession, d: str) -> DataFrame:
    return Z.per_text(_decls(spark, d), "file", "decl", "file bigint, hint string", lambda t: [(h,) for h in Z.input_classes(Z._TOKENS.findall(t))])


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, counted by a stream that reads the table's files as they come."""
    return daily_counts(spark, f"{d}/events.parquet", "ts", "event_type", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        carry_over, annotate, annotate_unknown, action_bucket, validate_records, results_summary, usage_totals, summary_counts, packets, rank_metrics, rank_lab, symbol_ranks, ai_triage, truth_functions, seeded_score,
        shape_counts, store_readers, taint, text_functions, edit_shapes, mask_literals, cond_stack, guard_scope, signature_parts, input_classes, stream_daily,
    )
}

_VERDICTS = """vd as (select o_custkey id, case when o_orderstatus = 'F' then 'pass_by_review' when o_orderstatus = 'P' then 'not_needed' else 'confirmed' end said, not contains(o_orderpriority, 'NOT') note, o_totalprice > 100000 proof
  from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1),
vv as (select id, case when said = 'not_needed' and not note then 'needs_info' when said = 'pass_by_review' and not proof then 'needs_info' else said end verdict from vd)"""
_HITS = """t as (select distinct c_nationkey query, c_custkey item from customer where c_custkey in (select o_custkey from orders where o_totalprice > 490000)),
hits as (select r.ranker, t.query, coalesce(min(r.rank), 10000) rank from (select distinct ranker from r) k(ranker) cross join (select distinct query from t) t left join (select r.* from r join t on t.query = r.query and t.item = r.item) r on r.ranker = k.ranker and r.query = t.query group by all)"""
_METRICS = "count(*) queries, round(avg(case when rank < 10000 then 1.0 / rank else 0.0 end), 9) mrr, count(*) filter (rank <= 10) top10, count(*) filter (rank <= 20) top20, median(rank) median, count(*) filter (rank = 10000) missed"
_DEFS = rf"""{L}, fx as (select *, max(case when regexp_matches(text, '{HEAD}') then no end) over (partition by file order by no rows unbounded preceding) fn from l),
df as (select file, fn, no, regexp_extract(text, '{ASSIGN}', 1) target, regexp_extract(text, '{ASSIGN}', 2) callee, regexp_extract(text, '{ASSIGN}', 3) source from fx where fn is not null and regexp_matches(text, '{ASSIGN}'))"""
_RANK = "row_number() over (partition by c_nationkey order by {}, c_custkey)"


def _ranker(name: str, order: str) -> str:
    return f"select '{name}' ranker, c_nationkey query, c_custkey item, {_RANK.format(order)} rank from customer"


ORACLE = {
    "carry_over": """with a as (select l_orderkey k, min(l_linestatus) f from lineitem group by 1) select coalesce(k, o_orderkey) "key", o_orderpriority verdict,
      case when k is null then 'orphaned' when o_orderkey is null then 'new' when f is not distinct from o_orderstatus then 'carried' else 'needs_recheck' end state from a full join orders on o_orderkey = k""",
    "annotate": f"with {_VERDICTS} select c_custkey id, verdict from customer left join vv on vv.id = c_custkey",
    "annotate_unknown": f"with {_VERDICTS} select verdict, count(*) verdicts from vv where id not in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1",
    "action_bucket": f"""with {_VERDICTS} select case when verdict = 'pass_by_review' then 'closed_by_review' when verdict = 'not_needed' then 'not_needed' when c_acctbal < 0 or verdict is not null then 'test_on_target' else 'review' end bucket, count(*) cases
      from customer left join vv on vv.id = c_custkey group by 1""",
    "validate_records": """with p as (select distinct edge_id, nullif(trim(dependent), '') a, nullif(trim(dependency), '') b, confidence, line from provider_edge),
      x as (select edge_id, concat_ws('; ', case when a is null then 'no dependent' end, case when b is null then 'no dependency' end, case when confidence is null then 'no confidence' end,
        case when confidence < 0 or confidence > 1 then 'confidence out of range' end, case when line < 1 then 'line before the first' end, case when a = b then 'depends on itself' end) problems from p) select * from x where problems <> ''""",
    "results_summary": """with r as (select o_orderpriority run, case when starts_with(o_orderpriority, '5') and o_orderstatus = 'O' then null when o_orderstatus = 'F' then 'pass' when o_orderstatus = 'P' then 'odd' when o_totalprice > 200000 then 'fail' else '' end v,
        o_orderstatus = 'P' n, cast(floor(o_totalprice) as bigint) b from orders)
      select run, count(*) filter (v = 'pass') pass, count(*) filter (v = 'fail') fail, count(*) filter (v = 'blocked') blocked, count(*) filter (coalesce(v, '') = '') untested, count(*) filter (v = 'odd') invalid, count(*) filter (n) recheck, count(*) total,
        bool_and(coalesce(v in ('pass', 'fail', 'blocked'), false)) complete, cast(sum(b) as bigint) bytes from r group by 1""",
    "usage_totals": "select l_returnflag run, count(*) calls, cast(sum(l_partkey + case when l_linenumber > 2 then l_suppkey else 0 end) as bigint) input_tokens, cast(sum(cast(l_quantity as bigint)) as bigint) output_tokens, round(sum(cast(l_linenumber as double)), 6) cost from lineitem group by 1",
    "summary_counts": f"""with {E}, {B.PE}, x as (select relation, 'index' o from e union all select relation, case when run_id % 2 = 0 then 'even' else 'odd' end from pe)
      select relation, count(*) filter (o = 'index') "index", count(*) filter (o = 'even') even, count(*) filter (o = 'odd') odd from x group by 1""",
    "packets": f"with {S}, g as (select file, count(*) cases from s where file is not null group by 1) select file, cases, cast(floor((row_number() over (order by cases desc, file) - 1) / 8) as integer) batch from g",
    "rank_metrics": f"with r as ({_ranker('x', 'c_acctbal desc')}), {_HITS} select case when query % 2 = 0 then 'dev' else 'holdout' end part, {_METRICS} from hits group by 1",
    "rank_lab": f"with r as ({_ranker('balance', 'c_acctbal desc')} union all {_ranker('poorest', 'c_acctbal')} union all {_ranker('segment', 'c_mktsegment, c_acctbal desc')}), {_HITS} select ranker, {_METRICS} from hits group by 1",
    "symbol_ranks": f"""with r as (select c_nationkey query, c_mktsegment symbol, {_RANK.format('c_acctbal desc')} rank from customer), f as (select query, symbol, min(rank) a from r group by 1, 2)
      select query, symbol, row_number() over (partition by query order by a) symbol_rank from f""",
    "ai_triage": f"""with {_VERDICTS} select row_number() over (order by case verdict when 'confirmed' then 0 when 'needs_info' then 1 when 'not_needed' then 3 else 2 end, c_custkey) rn, c_custkey id from customer left join vv on vv.id = c_custkey""",
    "truth_functions": f"""with {B.PE}, {V}, p as (select distinct file, line from pe where file is not null and line is not null),
      i as (select (select n.usr from n where n.file = p.file and p.line between n.start_line and n.end_line order by n.end_line - n.start_line, n.usr limit 1) usr from p) select distinct usr from i where usr in (select usr from o)""",
    "seeded_score": f"""with {S}, r as (select *, regexp_extract(file, '^([^/]+/[^/]+)/', 1) st, row_number() over (partition by regexp_extract(file, '^([^/]+/[^/]+)/', 1) order by file, line nulls first, id) rank from s where name is not null and file is not null)
      select st "set", min(rank) rank, min(rank) - 1 noise from r where regexp_extract(spelling, '^[a-z]+') in (select regexp_extract(spelling, '^[a-z]+') from core_symbol where regexp_extract(spelling, '^[a-z]+') <> '') group by 1""",
    "shape_counts": rf"""with {L} select md5(regexp_replace(regexp_replace(text, '`[^`]*`|''[^'']*''|"[^"]*"', '_', 'g'), '[0-9]+', '0', 'g')) digest, count(*) lines from l where length(text) >= 20 group by 1 having count(*) > 1""",
    "store_readers": f"""with {_DEFS}, w as (select distinct file, fn, target store from df), r as (select distinct file r_file, fn r_fn, source store from df),
      j as (select w.*, r_file, r_fn, row_number() over (partition by file, fn, w.store order by r_file, r_fn) k from w join r on r.store = w.store where (file <> r_file or fn <> r_fn) and (not starts_with(w.store, 'm_') or file = r_file))
      select file, fn, store, r_file, r_fn from j where k <= 4""",
    "stream_daily": "select cast(date_trunc('day', ts) as date) \"day\", event_type kind, count(distinct event_id) events from events group by 1, 2",
}
