"""Queries of flags and of the reasons to check a case where it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.operators import evidence as V
from ripplemark.operators.changes import changed_symbols
from ripplemark.plans import bindings as B
from ripplemark.plans import case_queries as C
from ripplemark.plans.bindings import CH, E, L, S
from ripplemark.plans.bindings import V as VERSIONS
from ripplemark.runtime import Staged
from ripplemark.sources.tables import table


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Roots with what the flags look at: the newest symbol of an id tells whether it is a template or virtual."""
    old, new = B.last_two(spark, d)
    c = changed_symbols(old, new).select(F.col("usr").alias("root"), "kind", "change_kind")
    s = table(spark, d, "symbol").select(F.btrim("id").alias("root"), "is_template", "is_virtual").groupBy("root").agg(F.bool_or("is_template").alias("is_template"), F.bool_or("is_virtual").alias("is_virtual"))
    return c.join(s, "root", "left").select("root", "kind", "change_kind", F.coalesce("is_template", F.lit(False)).alias("is_template"), F.coalesce("is_virtual", F.lit(False)).alias("is_virtual"))


def _taken(edges: DataFrame) -> DataFrame:
    """Functions that a macro names: a use that is no call."""
    return edges.where("relation = 'macro_expand' and file is not null and line is not null").select(F.col("dependency").alias("root"), "file", "line")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    roots, edges = Staged(_changed(spark, d), "roots").df, B.edges(spark, d)
    over = edges.where("relation = 'inherit_override' and dependency is not null and dependent is not null").select(F.col("dependent").alias("method"), F.col("dependency").alias("member"))
    groups = over.unionByName(over.select(F.col("member").alias("method"), F.col("method").alias("member"))).distinct()
    calls = edges.where("relation = 'call' and dependent is not null").select(F.col("dependency").alias("callee"))
    missed = table(spark, d, "provider_result").select(F.explode("missed").alias("m")).select(F.btrim("m").alias("root"))
    parts = [V.template_flags(roots, edges), V.routing_flags(roots, groups, calls), V.address_flags(roots, _taken(edges)), V.unresolved_flags(roots, missed), V.foreign_flags(C._foreign_calls(spark, d))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def uncertainty_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


def flagged_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases by group where roots with a flag instead of cases have none."""
    two = C._two(spark, d)
    risks = V.without_flagged(C._risks(two), _flags(spark, d))
    c = C.K.generate(C._reach(spark, d, two), risks, F.col("node").startswith("file:"))
    return c.groupBy("risk_group", "sub_reason", "hop").agg(F.count(F.lit(1)).alias("cases"))


def _body_hits(spark: SparkSession, d: str) -> DataFrame:
    """Signs in what a symbol declares and holds in the last snapshot, as one line."""
    new = B.last_two(spark, d)[1]
    text = F.concat_ws(" ", F.array_join("decl_tokens", " "), F.array_join("tokens", " "))
    return V.target_hits(new.select(F.col("usr").alias("node"), F.col("start_line").alias("no"), text.alias("text")), ["node"])


def target_signs(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each text and category that shows a need for the device."""
    return V.target_hits(B.lines(spark, d), ["file"]).select("file", "category", "no")


def verify_by(spark: SparkSession, d: str) -> DataFrame:
    two = C._two(spark, d)
    cases = C._cases(C._reach(spark, d, two), two).withColumn("case", F.concat_ws("|", "node", "risk_group", "sub_reason", "hop"))
    hits = _body_hits(spark, d)
    changed = hits.join(changed_symbols(*two).select(F.col("usr").alias("node")), "node", "left_semi")
    flags = _flags(spark, d).withColumn("ord", F.concat_ws(" ", "category", "why"))
    r = V.verify_by(cases, flags, changed, hits)
    return r.select("case", "verify_by", F.array_join("reasons", "; ").alias("reasons"))


QUERIES = {f.__name__: f for f in (uncertainty_flags, flagged_cases, target_signs, verify_by)}

_FLAGS = rf"""rt as (select usr root, kind, change_kind, coalesce(t, false) tpl, coalesce(v, false) virt from ch left join (select trim(id) id, bool_or(is_template) t, bool_or(is_virtual) v from symbol group by 1) q on q.id = usr),
ov as (select dependent a, dependency b from e where relation = 'inherit_override' and dependency is not null and dependent is not null), gr as (select a, b from ov union select b, a from ov),
cd as (select distinct dependency u from e where relation = 'call' and dependent is not null and dependency is not null),
{C._FOREIGN},
fg as (select root, 'uninstantiated_template' category, 'no use in sight' why, null::varchar detail from rt where tpl and change_kind <> 'removed'
    and root not in (select dependency from e where relation in ('instantiate', 'call', 'uses_type', 'inherit_override') and dependency is not null and dependent is not null)
  union all select root, 'di_config_routing', 'no caller in sight', null from rt where kind = 'method' and (virt or root in (select a from gr)) and root not in (select u from cd) and not exists (select 1 from gr join cd on u = b where a = root)
  union all select root, 'dynamic_runtime_dependency', 'address taken', (select e.file || ':' || e.line from e where e.relation = 'macro_expand' and e.dependency = root and e.file is not null and e.line is not null order by e.file, e.line limit 1)
    from rt where kind in ('function', 'method') and root in (select dependency from e where relation = 'macro_expand' and file is not null and line is not null and dependency is not null)
  union all select root, 'provider_unresolved', 'provider', null from rt where root in (select trim(m) from (select unnest(missed) m from provider_result) where m is not null)
  union all select root, 'dynamic_runtime_dependency', 'foreign code', array_to_string(list(callee order by callee)[1:10], ', ') || case when count(*) > 10 then ' and ' || (count(*) - 10) || ' more' else '' end from (select distinct root, callee from ff) group by root)"""
_BASE = f"with {E}, {S}, {VERSIONS}, {CH}"
_PATTERNS = ", ".join(f"('{k}', '" + p.replace("'", "''") + "')" for k, p in V.TARGET_PATTERNS.items())


def _signs(lines: str, by: str) -> str:
    """lines: a table with `by`, no and text."""
    return f"""pt(category, rx) as (values {_PATTERNS}), cl as (select {by}, no, regexp_replace(regexp_replace(text, '//[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*\\*+/', '', 'g'), '//.*$', '', 'g') code from {lines}),
sg as (select {by}, category, min(no) as no, arg_min(substr(trim(regexp_extract(code, rx)), 1, 40), no) hit from cl join pt on regexp_matches(code, rx) group by 1, 2)"""


ORACLE = {
    "uncertainty_flags": f"{_BASE}, {_FLAGS} select * from fg",
    "flagged_cases": C._CASES.replace("far as (select", f"{_FLAGS}, kk as (select * from k where root not in (select root from fg where category in ('uninstantiated_template', 'di_config_routing'))), far as (select", 1)
    .replace("from nd join k on", "from nd join kk k on").replace("[root] roots from k union all", "[root] roots from kk k union all")
    + " select risk_group, sub_reason, hop, count(*) cases from c group by all",
    "target_signs": f"with {L}, {_signs('l', 'file')} select file, category, no from sg",
    "verify_by": C._CASES
    + f""", {_FLAGS}, tx as (select usr, start_line as no, concat_ws(' ', array_to_string(decl_tokens, ' '), array_to_string(tokens, ' ')) as text from n), {_signs('tx', 'usr')},
      cs as (select node || '|' || risk_group || '|' || sub_reason || '|' || hop as cid, * from c), ck as (select * from cs where sub_reason not in ('logging', 'test_code')),
      ff1 as (select root, arg_min(category, category || ' ' || why) category from fg where category in ('dynamic_runtime_dependency', 'di_config_routing', 'build_config_incomplete_macro') group by root),
      rs as (select cid, 0 p, 'group: ' || risk_group reason from ck where risk_group in ('thread_safety', 'ownership_lifetime', 'build_config') or (risk_group = 'abi_layout' and sub_reason = 'member_change')
        union select cid, 1, 'flag: ' || category from ck join ff1 on ff1.root = node
        union select cid, 2, 'changed: ' || category || ': ' || hit from (select cid, unnest(list_distinct(list_append(roots, node))) x from ck) q join sg on sg.usr = q.x where q.x in (select usr from ch)
        union select cid, 3, category || ': ' || hit from ck join sg on sg.usr = node),
      rk as (select cid, reason, min(p) p from rs group by 1, 2), tp as (select *, row_number() over (partition by cid order by p, reason) i from rk)
      select cs.cid as case, case when count(tp.cid) > 0 then 'target' else 'review' end verify_by, coalesce(string_agg(reason, '; ' order by i), '') reasons from cs left join tp on tp.cid = cs.cid and i <= 6 group by cs.cid""".replace("cs.cid as case", 'cs.cid as "case"'),
}
