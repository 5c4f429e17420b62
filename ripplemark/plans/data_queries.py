"""The p1_ to p5_ queries: uneven keys, hierarchies, nested records, snapshot changes, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.ids import clean_id, clean_word
from ripplemark.operators import nested
from ripplemark.operators.hierarchy import descendants, one_parent, solve
from ripplemark.operators.orphans import orphans_by_mask, period_orphans
from ripplemark.operators.skew import node_loads, plan_loads, skew_join
from ripplemark.operators.snapshot_diff import snapshot_changes
from ripplemark.sources.tables import dep_edges, lives, provider_edges, symbols, table

# --- 1: a few keys holding most records


def p1_node_loads(spark: SparkSession, d: str) -> DataFrame:
    return node_loads(dep_edges(spark, d).select("ord", "dependency", "dependent", "seen_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "dep").select("ord").distinct().count()
    return p1_node_loads(spark, d).where(F.col("edges") * 100 >= F.lit(edges)).select("side", "node")


def p1_kind_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Edges by relation and the kinds of their two ends: two joins on very uneven keys."""
    e = dep_edges(spark, d).groupBy("ord").agg(*[F.min(c).alias(c) for c in ("dependency", "dependent", "relation")])
    s = symbols(spark, d).select("id", "kind")
    out, sides = e, ("dependency", "dependent")
    plans = {x: plan_loads(e.select(x, "ord"), [x], ["ord"]) for x in sides}
    for x in sides:
        out = skew_join(out, s.select(F.col("id").alias(x), F.col("kind").alias(f"{x}_kind")), [x], ["ord"], "left", plan=plans[x])
    return out.groupBy("relation", "dependency_kind", "dependent_kind").agg(F.count(F.lit(1)).alias("edges"))


# --- 2: parent-child links to full hierarchies


def _contains(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str) -> DataFrame:
        return (
            table(spark, d, name)
            .where(clean_word("relation") == "contains")
            .select(clean_id("dependent").alias("up"), clean_id("dependency").alias("down"))
        )

    return one_parent(part("dep").unionByName(part("provider_edge")), "up", "down")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return solve(_contains(spark, d)).nodes.select("node", "root", "depth", "status")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return solve(_contains(spark, d), with_paths=True).paths.select("node", "path")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(solve(_contains(spark, d), with_paths=True).paths)


# --- 3: deeply nested records


KINDS = ("report", "pilot", "verdicts")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "report_raw").where(F.col("body").isNotNull() & clean_word("kind").isin(*KINDS))
    rows = raw.select("record_id", clean_word("kind").alias("kind"), F.concat_ws("#", "record_id", F.md5("body")).alias("doc_key"), "body")
    return nested.documents(rows, "body", by=("kind",))


class _Records:
    """The related tables of all three kinds of record, out of one parse and one inference pass."""

    CARRY = {"id": ("id",), "intro": ("intro",)}

    def __init__(self, spark: SparkSession, d: str):
        docs = _documents(spark, d)
        self.spark = spark
        trees = nested.infer_schema(docs, "doc", "kind")
        self.tables = {}
        for kind in KINDS:
            mine = docs.where(F.col("kind") == kind)
            self.tables[kind] = nested.tables(mine, trees.get(kind, nested.Place()), ["record_id"], carry=self.CARRY)

    def at(self, kind: str, place: str) -> list[tuple[str, nested.Table]]:
        """The tables of a field, wherever in the record it is."""
        return [(n, t) for n, t in self.tables[kind].items() if n == place or n.endswith(f".{place}")]

    def union(self, parts: list[DataFrame], empty: str) -> DataFrame:
        out = self.spark.createDataFrame([], empty)
        for p in parts:
            out = out.unionByName(p)
        return out

    CANDIDATE = "record_id bigint, row_key string, pos int, id string, description string, priority string, risk_group string, sub_reason string, hop_distance bigint"

    def candidates(self) -> DataFrame:
        cols = ("id", "description", "priority", "risk_group", "sub_reason")
        return self.union(
            [t.df.select("record_id", F.col("_row_key").alias("row_key"), F.col("_pos").alias("pos"), *[t.col(c).alias(c) for c in cols], t.col("hop_distance").cast("bigint").alias("hop_distance")) for _, t in self.at("report", "test_case_candidates")],
            self.CANDIDATE,
        )

    def evidence(self) -> DataFrame:
        """Each evidence element with its candidate's id; the parent's fields travel with the exploded row."""
        parts = []
        for name, _ in self.at("report", "test_case_candidates"):
            ev = self.tables["report"].get(f"{name}.evidence")
            if ev is None:
                continue
            q = "qualified_name"
            val = F.coalesce(*[ev.col(*p) for p in ((q,), ("symbol", q), ("from_symbol", q), ("edge", "from_symbol", q), ("symbol",), ())])
            parent = F.col("_parent_id") if "_parent_id" in ev.df.columns else F.lit(None).cast("string")
            parts.append(ev.df.select("record_id", F.col("_row_key").alias("row_key"), F.col("_parent_key").alias("parent_key"), parent.alias("parent"), F.col("_pos").alias("pos"), val.alias("val"), F.coalesce(ev.col("relation"), ev.col("edge", "relation")).alias("relation")))
        return self.union(parts, "record_id bigint, row_key string, parent_key string, parent string, pos int, val string, relation string")

    def hits(self) -> DataFrame:
        parts = []
        for _, t in self.at("pilot", "hits"):
            path, function = t.col("symbol", "file_path"), t.col("symbol", "function")
            pair = F.when(path.isNotNull() & function.isNotNull(), F.concat_ws(":", path, function))
            parent = F.col("_parent_intro") if "_parent_intro" in t.df.columns else F.lit(None).cast("string")
            parts.append(t.df.select("record_id", F.col("_row_key").alias("row_key"), F.col("_parent_key").alias("parent_key"), parent.alias("parent"), F.col("_pos").alias("pos"), F.coalesce(t.col("symbol"), pair).alias("val"), t.col("hop").cast("bigint").alias("hop")))
        return self.union(parts, "record_id bigint, row_key string, parent_key string, parent string, pos int, val string, hop bigint")

    def checks(self) -> DataFrame:
        """Entries of additional_checks with evidence; of several evidence values the first stands for the entry."""
        parts = []
        for name, t in self.at("verdicts", "additional_checks"):
            ev = self.tables["verdicts"].get(f"{name}.evidence")
            src, at = (t, ("evidence",)) if ev is None else (ev, ())  # nowhere a list
            path, line = src.col(*at, "file_path"), src.col(*at, "line").cast("string")
            val = F.coalesce(src.col(*at), F.when(path.isNotNull() & line.isNotNull(), F.concat_ws(":", path, line)))
            if ev is None:
                parts.append(t.df.select("record_id", F.col("_row_key").alias("row_key"), F.col("_pos").alias("pos"), val.alias("val")).where("val is not null"))
                continue
            v = ev.df.select("record_id", F.col("_parent_key").alias("row_key"), F.col("_parent_pos").alias("pos"), F.col("_pos").alias("at"), val.alias("val")).where("val is not null")
            parts.append(v.groupBy("record_id", "row_key", "pos").agg(F.min_by("val", "at").alias("val")))
        return self.union(parts, "record_id bigint, row_key string, pos int, val string")

    def verdicts(self) -> DataFrame:
        """The judged cases: entries of the map of a verdicts record, by case id."""
        parts = []
        for _, t in self.at("verdicts", "cases.{}"):
            parts.append(t.df.select("record_id", F.col("_row_key").alias("row_key"), F.col("_map_key").alias("case_id"), t.col("verdict").alias("verdict"), t.col("note").alias("note")))
        return self.union(parts, "record_id bigint, row_key string, case_id string, verdict string, note string")


def p3_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _Records(spark, d).candidates().distinct()


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _Records(spark, d).evidence().distinct()


def p3_hits(spark: SparkSession, d: str) -> DataFrame:
    return _Records(spark, d).hits().distinct()


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    return _Records(spark, d).checks().distinct()


def p3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _Records(spark, d).verdicts().distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = _Records(spark, d)

    def rows(df: DataFrame, item: str, parent: F.Column) -> DataFrame:
        return df.where("val is not null").select("record_id", F.lit(item).alias("item"), parent.alias("parent"), "pos", "val")

    out = rows(r.evidence(), "evidence", F.col("parent")).unionByName(rows(r.hits(), "hit", F.col("parent"))).unionByName(rows(r.checks(), "check", F.lit("additional_checks")))
    return out.distinct()


# --- 4: what changed between snapshots


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbol_version").select("snap_no", "loaded_at", clean_id("usr").alias("usr"), "tokens", "decl_tokens")
    return snapshot_changes(rows, "snap_no", "usr", "loaded_at", ["tokens", "decl_tokens"]).withColumnRenamed("key", "usr")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("snap_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


# --- 5: references to records that do not exist


def _references(spark: SparkSession, d: str) -> DataFrame:
    dep = table(spark, d, "dep").select(F.lit("dep").alias("src"), F.col("ord").alias("row_id"), clean_id("dependent").alias("ref_id"), F.col("seen_at").alias("at"))
    edge = table(spark, d, "provider_edge").select(F.lit("provider_edge").alias("src"), F.col("edge_id").alias("row_id"), clean_id("dependency").alias("ref_id"), F.col("seen_at").alias("at"))
    items = table(spark, d, "provider_result").select("run_id", "finished_at", F.explode("missed").alias("m"))
    run = items.select(F.lit("provider_result").alias("src"), F.col("run_id").alias("row_id"), clean_id("m").alias("ref_id"), F.col("finished_at").alias("at"))
    return dep.unionByName(edge).unionByName(run)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    o = period_orphans(_references(spark, d), lives(spark, d))
    return o.select("src", "row_id", "ref_id", F.date_format("at", "yyyy-MM").alias("period_ym"), "reason")


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("src", "period_ym", "reason").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("ref_id").alias("ids"))


def p5_composite(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose (dependent, file) is no (id, file) of any symbol, under partial match; counted by null mask."""
    e = dep_edges(spark, d).select("ord", "dependent", "file").distinct()
    cols = [clean_id("id").alias("id"), "file"]
    t = table(spark, d, "symbol").select(*cols).unionByName(table(spark, d, "core_symbol").select(*cols))
    return orphans_by_mask(e, ["dependent", "file"], t, ["id", "file"], "partial", ["ord"]).groupBy("null_mask").agg(F.count(F.lit(1)).alias("refs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_node_loads, p1_kind_matrix, p2_found, p2_paths, p2_descendants, p3_found, p3_candidates, p3_evidence, p3_hits, p3_checks, p3_verdicts, p4_found, p4_counts, p5_found, p5_by_month, p5_composite)}

_EDGES = """
e as (select ord, nullif(trim(dependency), '') dependency, nullif(trim(dependent), '') dependent, lower(trim(relation)) relation, file, seen_at from dep),
sides as (select 'dependency' side, dependency node, dependent other, ord, seen_at from e union all select 'dependent', dependent, dependency, ord, seen_at from e)"""

_LOADS = f"""with {_EDGES},
loads as (select side, node, count(distinct ord) edges, count(distinct other) counterparts, min(seen_at) first_seen_at, max(seen_at) last_seen_at
  from sides where node is not null group by side, node)"""

_CONTAINS = """with recursive e as (
  select trim(dependency) node, min(trim(dependent)) up from (
    select dependency, dependent, relation from dep union all select dependency, dependent, relation from provider_edge)
  where lower(trim(relation)) = 'contains' and trim(coalesce(dependency, '')) <> '' and trim(coalesce(dependent, '')) <> '' group by 1),
anc(node, up) as (select node, up from e union select a.node, e.up from anc a join e on a.up = e.node)"""

_ALIVE = """with refs as (
  select 'dep' src, ord row_id, nullif(trim(dependent), '') ref_id, seen_at seen from dep
  union select 'provider_edge', edge_id, nullif(trim(dependency), ''), seen_at from provider_edge
  union select 'provider_result', run_id, nullif(trim(m), ''), finished_at from (select run_id, finished_at, unnest(missed) m from provider_result)),
lives as (select trim(id) id, first_seen born, removed_at gone from symbol union select trim(id), first_seen, removed_at from core_symbol),
orphan as (select r.*, case when not exists (select 1 from lives l where l.id = r.ref_id) then 'missing'
    when exists (select 1 from lives l where l.id = r.ref_id and l.gone <= r.seen) then 'deleted' else 'late' end reason
  from refs r where ref_id is not null
    and not exists (select 1 from lives l where l.id = r.ref_id and l.born <= r.seen and (l.gone is null or l.gone > r.seen))),
found as (select distinct src, row_id, ref_id, strftime(seen, '%Y-%m') period_ym, reason from orphan)"""

_CHANGES = """with v as (
  select snap_no, nullif(trim(usr), '') usr, arg_max({'t': coalesce(tokens, []), 'd': coalesce(decl_tokens, [])}, loaded_at) x
  from symbol_version where nullif(trim(usr), '') is not null group by 1, 2),
p as (select distinct snap_no from v),
q as (select snap_no, lag(snap_no) over (order by snap_no) prev from p),
found as (
  select q.snap_no, n.usr, case when o.usr is null then 'added' else 'modified' end change_kind from q join v n on n.snap_no = q.snap_no
    left join v o on o.snap_no = q.prev and o.usr = n.usr where q.prev is not null and (o.usr is null or o.x is distinct from n.x)
  union all
  select q.snap_no, o.usr, 'removed' from q join v o on o.snap_no = q.prev left join v n on n.snap_no = q.snap_no and n.usr = o.usr where n.usr is null)"""

_AROUND = r"^[\s\x{FEFF}\x{200B}\x{00A0}]+|[\s\x{FEFF}\x{200B}\x{00A0}]+$"


def _read_json(level: int) -> str:
    """The JSON text in column t of w{level}: what stands around it is cut off; a JSON string is read once more."""
    k = level
    ok = lambda x: f"when json_valid({x}) then {x}"
    return rf"""s{k} as (select *, regexp_replace(t, '{_AROUND}', '', 'g') s from w{k}),
r{k} as (select *, regexp_extract(s, '(?ms)^[ \t\x{{FEFF}}]*([\[{{"].*[\]}}"])', 1) fr, regexp_extract(s, '(?ms)^(\{{.*\}})', 1) br, regexp_extract(s, '(?s)^[^\[{{]*(\{{.*\}}|\[.*\])', 1) il, not regexp_matches(s, '^[\[{{"]') bare, regexp_matches(s, '(?m)^[ \t\x{{FEFF}}]*[\[{{"]') opens from s{k}),
j{k} as (select record_id, kind, key, case {ok("s")} {ok("fr")} when bare and json_valid(br) then br when bare and not opens and json_valid(il) then il end j from r{k}),
w{k + 1} as (select record_id, kind, key, json_extract_string(j, '$') t from j{k} where json_type(j) = 'VARCHAR')"""


_UNWRAPS = 4
_DOCS = (
    "w0 as (select distinct record_id, lower(trim(kind)) kind, record_id || '#' || md5(body) key, body t from report_raw where body is not null), "
    + ", ".join(_read_json(k) for k in range(_UNWRAPS))
    + ", doc as ("
    + " union all ".join(f"select record_id, kind, key, j::json j from j{k} where json_type(j) in ('OBJECT', 'ARRAY')" for k in range(_UNWRAPS))
    + "), top as (select record_id, kind, key || '/' || unnest(range(len(xs))) key, unnest(xs) j from (select *, case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [j] end xs from doc))"
)


def _each(j: str, where: str, src: str, cols: str = "") -> str:
    """Rows of the elements of j of src: cols, pos and e; a lone value is the only element."""
    return f"""(select {cols}unnest(xs) e, unnest(range(len(xs))) pos from (select {cols}case json_type({j}) when 'ARRAY' then json_extract({j}, '$[*]') when 'NULL' then [] else [{j}] end xs from {src} where {where} and {j} is not null)) where json_type(e) <> 'NULL'"""


def _text(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"case when json_type(e, '$.{p}') not in ('OBJECT', 'ARRAY') then json_extract_string(e, '$.{p}') end" for p in paths) + ")"


_EVIDENCE = f"""{_DOCS}, tops as (select record_id, kind, key, j from top), holder as (select record_id, key, j from tops where kind = 'report' union all select record_id, key, json_extract(j, '$.report') from tops where kind = 'report' and json_type(j, '$.report') = 'OBJECT'),
cand as (select record_id, key || '/' || pos key, pos, e from {_each("json_extract(j, '$.test_case_candidates')", "true", "holder", "record_id, key, ")}),
ev as (select record_id, key, id, pos, e from {_each("json_extract(c, '$.evidence')", "true", "(select record_id, key, e c, json_extract_string(e, '$.id') id from cand)", "record_id, key, id, ")}),
hit as (select record_id, key, intro, pos, e from {_each("json_extract(j, '$.hits')", "kind = 'pilot'", "(select *, json_extract_string(j, '$.intro') intro from tops)", "record_id, key, intro, ")}),
chk as (select record_id, key || '/' || pos key, pos, json_extract(e, '$.evidence') x from {_each("json_extract(j, '$.additional_checks')", "kind = 'verdicts'", "tops", "record_id, key, ")}),
chv as (select record_id, key, p0 pos, min_by(v, pos) val from (select record_id, key, p0, pos, coalesce(case when json_type(e) not in ('OBJECT', 'ARRAY') then json_extract_string(e, '$') end,
    case when json_extract_string(e, '$.file_path') is not null and json_extract_string(e, '$.line') is not null then json_extract_string(e, '$.file_path') || ':' || json_extract_string(e, '$.line') end) v
  from {_each("x", "true", "(select record_id, key, pos p0, x from chk)", "record_id, key, p0, ")}) where v is not null group by 1, 2, 3)"""

ORACLE = {
    "p3_found": f"""with {_EVIDENCE} select distinct * from (
      select record_id, 'evidence' item, id parent, cast(pos as integer) pos, {_text("qualified_name", "symbol.qualified_name", "from_symbol.qualified_name", "edge.from_symbol.qualified_name", "symbol")} val from ev
      union all select record_id, 'hit', intro, cast(pos as integer), coalesce({_text("symbol")}, case when json_extract_string(e, '$.symbol.file_path') is not null and json_extract_string(e, '$.symbol.function') is not null then json_extract_string(e, '$.symbol.file_path') || ':' || json_extract_string(e, '$.symbol.function') end) from hit
      union all select record_id, 'check', 'additional_checks', cast(pos as integer), val from chv) where val is not null""",
    "p3_candidates": f"""with {_EVIDENCE} select distinct record_id, key row_key, cast(pos as integer) pos, {_text("id")} id, {_text("description")} description, {_text("priority")} priority, {_text("risk_group")} risk_group, {_text("sub_reason")} sub_reason,
      try_cast({_text("hop_distance")} as bigint) hop_distance from cand""",
    "p3_evidence": f"""with {_EVIDENCE} select distinct record_id, key || '/' || pos row_key, key parent_key, id parent, cast(pos as integer) pos, {_text("qualified_name", "symbol.qualified_name", "from_symbol.qualified_name", "edge.from_symbol.qualified_name", "symbol")} val, {_text("relation", "edge.relation")} relation from ev""",
    "p3_hits": f"""with {_EVIDENCE} select distinct record_id, key || '/' || pos row_key, key parent_key, intro parent, cast(pos as integer) pos, coalesce({_text("symbol")}, case when json_extract_string(e, '$.symbol.file_path') is not null and json_extract_string(e, '$.symbol.function') is not null then json_extract_string(e, '$.symbol.file_path') || ':' || json_extract_string(e, '$.symbol.function') end) val,
      try_cast({_text("hop")} as bigint) hop from hit""",
    "p3_checks": f"with {_EVIDENCE} select distinct record_id, key row_key, cast(pos as integer) pos, val from chv",
    "p3_verdicts": f"""with {_DOCS}, ks as (select record_id, key, json_extract(j, '$.cases') o from top where kind = 'verdicts' and json_type(j, '$.cases') = 'OBJECT'),
      es as (select record_id, key, o, unnest(list_sort(json_keys(o))) c, unnest(range(len(json_keys(o)))) pos from ks)
      select distinct record_id, key || '/' || pos row_key, c case_id, json_extract_string(o, '$."' || c || '".verdict') verdict, json_extract_string(o, '$."' || c || '".note') note from es""",
    "p1_found": _LOADS + " select side, node from loads where edges * 100 >= (select count(distinct ord) from dep)",
    "p1_node_loads": _LOADS + " select * from loads",
    "p1_kind_matrix": f"""with {_EDGES},
      one as (select ord, min(dependency) dependency, min(dependent) dependent, min(relation) relation from e group by ord),
      s as (select id, kind from (select *, row_number() over (partition by id order by first_seen desc, file desc, line desc) rn from (
        select trim(id) id, kind, file, line, first_seen from symbol union all select trim(id), kind, file, line, first_seen from core_symbol)) where rn = 1)
      select relation, a.kind dependency_kind, b.kind dependent_kind, count(*) edges from one
      left join s a on a.id = one.dependency left join s b on b.id = one.dependent group by all""",
    "p2_found": _CONTAINS
    + """, ring as (select distinct node from anc where node = up)
    select n.node, case when r.node is not null then (select min(a.up) from anc a where a.node = n.node)
        when c.root is not null then c.root else coalesce((select a.up from anc a where a.node = n.node and a.up not in (select node from e)), n.node) end root,
      cast(case when r.node is not null or c.root is not null then -1 else (select count(*) from anc a where a.node = n.node) end as integer) depth,
      case when r.node is not null then 'on_cycle' when c.root is not null then 'below_cycle' else 'tree' end status
    from (select node from e union select up from e) n left join ring r on r.node = n.node
    left join (select a.node, min(a.up) root from anc a join ring on ring.node = a.up group by a.node) c on c.node = n.node""",
    "p2_paths": _CONTAINS
    + """, d as (select node, count(*) depth from anc group by node),
    bad as (select distinct a.node from anc a join (select distinct node from anc where node = up) r on r.node = a.up)
    select n.node, list_append(coalesce((select list(a.up order by coalesce(d.depth, 0)) from anc a left join d on d.node = a.up where a.node = n.node), []), n.node) path
    from (select node from e union select up from e) n where n.node not in (select node from bad)""",
    "p2_descendants": _CONTAINS
    + """, d as (select node, count(*) depth from anc group by node),
    bad as (select distinct a.node from anc a join (select distinct node from anc where node = up) r on r.node = a.up)
    select a.up node, a.node descendant, cast(d.depth - coalesce(u.depth, 0) as integer) distance from anc a join d on d.node = a.node left join d u on u.node = a.up
    where a.node not in (select node from bad)""",
    "p4_found": _CHANGES + " select * from found",
    "p4_counts": _CHANGES + " select snap_no, change_kind, count(*) n from found group by all",
    "p5_found": _ALIVE + " select * from found",
    "p5_by_month": _ALIVE + " select src, period_ym, reason, count(*) refs, count(distinct ref_id) ids from found group by all",
    "p5_composite": f"""with {_EDGES}, k as (select distinct ord, dependent, file from e),
      t as (select trim(id) id, file from symbol union select trim(id), file from core_symbol)
      select case when dependent is null then '0' else '.' end || case when file is null then '0' else '.' end null_mask, count(*) refs from k
      where not (dependent is null and file is null) and not exists (select 1 from t where (k.dependent is null or t.id = k.dependent) and (k.file is null or t.file = k.file)) group by 1""",
}
