"""Queries from risk rows to ranked cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.operators import cases as K
from ripplemark.operators import graph as G
from ripplemark.operators import rules as R
from ripplemark.operators.changes import changed_symbols
from ripplemark.operators.ranking import first_k
from ripplemark.plans import bindings as B
from ripplemark.plans.bindings import CH, E, S, V
from ripplemark.plans.graph_queries import _ROOTS, Two, _walk, _folder, _roots
from ripplemark.runtime import Staged
from ripplemark.sources.settings import Settings
from ripplemark.sources.tables import table


class Snapshots(tuple):
    """The old and the new versions, with what several steps of a query make of them, written once."""

    kept: dict[str, DataFrame]

    def once(self, name: str, make) -> DataFrame:
        self.__dict__.setdefault("kept", {})
        if name not in self.kept:
            self.kept[name] = Staged(make(), name).df
        return self.kept[name]


def _two(spark: SparkSession, d: str) -> Two:
    """The last two snapshots, written once: roots, risks and weights all read them."""
    old, new = B.last_two(spark, d)
    return Snapshots((Staged(old, "old").df, Staged(new, "new").df))


def _changed(two: Two) -> DataFrame:
    return two.once("changed", lambda: changed_symbols(*two)) if isinstance(two, Snapshots) else changed_symbols(*two)


def _risks(two: Two) -> DataFrame:
    make = lambda: R.risk_rows(R.changes_of(*two))
    return two.once("risks", make) if isinstance(two, Snapshots) else make()


def risk_rules(spark: SparkSession, d: str) -> DataFrame:
    return _risks(B.last_two(spark, d))


def risk_history(spark: SparkSession, d: str) -> DataFrame:
    """Reasons by snapshot: the rules over each snapshot and the one before it."""
    r = R.risk_rows(R.changes_of(*B.history(spark, d)))
    return r.groupBy(F.split("root", "@")[0].cast("int").alias("snap_no"), "risk_group", "sub_reason").agg(F.count(F.lit(1)).alias("roots"))


def _foreign_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of changed symbols into another component: root, callee, with what the callee's declaration tells."""
    old, new = B.last_two(spark, d)
    c = changed_symbols(old, new).where("change_kind <> 'removed'").select(F.col("usr").alias("root"), _component("file").alias("home"))
    f = R.callee_facts(F.col("decl_tokens"), F.col("noexcept_spec"))
    known = new.where("kind in ('function', 'method')").select(F.col("usr").alias("callee"), _component("file").alias("there"), *[x.alias(n) for n, x in f.items()])
    calls = B.edges(spark, d).where("relation = 'call' and dependency is not null").select(F.col("dependent").alias("root"), F.col("dependency").alias("callee")).distinct()
    return calls.join(c, "root").join(known, "callee").where("home <> there")


def external_calls(spark: SparkSession, d: str) -> DataFrame:
    return _foreign_calls(spark, d).groupBy("callee", "result", "may_throw", "out_params", "callbacks", "buffers").agg(F.count(F.lit(1)).alias("roots"))


def external_risk(spark: SparkSession, d: str) -> DataFrame:
    return R.external_risk(_foreign_calls(spark, d))


def _component(c: str) -> F.Column:
    return F.regexp_extract(c, "^([^/]+/[^/]+)/", 1)


HOPS = Settings.max_hop


def _reach(spark: SparkSession, d: str, two: Two, hops: int = HOPS) -> DataFrame:
    files = _changed(two).select(F.col("usr").alias("root"), "file")
    seeds = G.header_seeds(files, _risks(two), K.FILE_GROUPS, R.HEADER)
    return G.reach(B.edges(spark, d), _roots(spark, d, changes=_changed(two)), hops, 0, seeds)[0]


def _cases(nodes: DataFrame, two: Two) -> DataFrame:
    return K.generate(nodes, _risks(two), F.col("node").startswith("file:"))


def _plain_cases(spark: SparkSession, d: str, hops: int = HOPS) -> DataFrame:
    two = _two(spark, d)
    return _cases(_reach(spark, d, two, hops), two)


def case_generation(spark: SparkSession, d: str, hops: int = HOPS) -> DataFrame:
    return _plain_cases(spark, d, hops).select("node", "hop", "risk_group", "sub_reason", F.size("roots").alias("n_roots"), F.element_at("roots", 1).alias("first_root"))



def case_priority(spark: SparkSession, d: str, hops: int = HOPS) -> DataFrame:
    c = _plain_cases(spark, d, hops)
    return c.groupBy(K.priority(F.col("hop"), F.col("risk_group"), F.col("sub_reason")).alias("priority"), "hop", "risk_group").agg(F.count(F.lit(1)).alias("cases"))



def _weights(two: Two) -> DataFrame:
    return _changed(two).select(F.col("usr").alias("root"), "lines")


def case_features(spark: SparkSession, d: str, hops: int = HOPS) -> DataFrame:
    two = _two(spark, d)
    return K.features(_reach(spark, d, two, hops), _weights(two))



def _fixes(spark: SparkSession, d: str) -> DataFrame:
    """How often something was removed from a file: the stand-in for fix history."""
    return table(spark, d, "symbol").where("removed_at is not null and file is not null").select("id", "file", "removed_at").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("fixes"))


def _ranked(spark: SparkSession, d: str, hops: int = HOPS) -> DataFrame:
    s = B.symbols(spark, d).select(F.col("id").alias("node"), "name", "file", "line")
    two = _two(spark, d)
    nodes = Staged(_reach(spark, d, two, hops), "reach").df  # read by both the cases and their features
    c = _cases(nodes, two).join(K.features(nodes, _weights(two)), "node", "left").join(s, "node", "left").join(_fixes(spark, d), "file", "left")
    return K.rank(c.withColumn("fan_in", F.coalesce("fan_in", F.lit(0))))


def case_ranking(spark: SparkSession, d: str, hops: int = HOPS) -> DataFrame:
    return _ranked(spark, d, hops).select("id", "priority", "node", "hop", "risk_group", "sub_reason")



def case_keys(spark: SparkSession, d: str, hops: int = HOPS) -> DataFrame:
    return K.keys(_ranked(spark, d, hops)).select("rank", "key")



def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The first three places of each symbol kind and folder."""
    s = B.symbols(spark, d).select("id", "kind", _folder("file").alias("folder"), "file", "line")
    return first_k(s, ["kind", "folder"], [F.asc_nulls_first("file"), F.asc_nulls_first("line"), F.col("id")], 3).select("kind", "folder", "id")


def merge_cases(spark: SparkSession, d: str) -> DataFrame:
    """Edges folded by their two files, reasons being the relations in order of first delivery."""
    e = B.edges(spark, d).where("file is not null and dependency is not null and relation is not null")
    return K.merge(e.select("file", "dependency", "ord", "relation"), ["file", "dependency"], "ord", "relation")


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    v = B.last_two(spark, d)[1].select("usr", "name", "file")
    kept, dropped = K.evidence_gate(v, B.symbols(spark, d))
    return kept.select("usr", F.lit(True).alias("resolves")).unionByName(dropped.select("usr", F.lit(False).alias("resolves")))


def target_scope(spark: SparkSession, d: str) -> DataFrame:
    """Files by whether the folders that include them meet those of the classes of the base library."""
    e = B.edges(spark, d).where("relation = 'include' and dependency like 'file:%' and file is not null")
    nodes = e.groupBy(F.col("dependency").alias("node")).agg(F.array_sort(F.collect_set(F.nullif(_folder("file"), F.lit("")))).alias("targets"))
    wanted = table(spark, d, "core_symbol").where("kind = 'class'").select(_folder("file").alias("target")).where("target <> ''")
    return K.scope(nodes, wanted).select("node", "in_scope")


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of guard and monitor files are out of scope; how many of which kind stay or go."""
    out = F.coalesce(F.col("file").rlike(r"(^|/)[a-z]+_(monitor|guard)_[0-9]+\."), F.lit(False))
    return B.symbols(spark, d).groupBy("kind", out.alias("out_of_scope")).agg(F.count(F.lit(1)).alias("symbols"))


def reader_proximity(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest users of a changed symbol: same file, then same folder, then order of delivery."""
    c = changed_symbols(*B.last_two(spark, d)).select(F.col("usr").alias("dependency"), F.col("file").alias("home"))
    e = B.edges(spark, d).where("dependent is not null").join(c, "dependency")
    far = F.when(F.col("file") == F.col("home"), 0).when(_folder("file") == _folder("home"), 1).otherwise(2)
    return first_k(e.withColumn("far", far), ["dependency"], [F.col("far"), F.col("ord")], 5).select("dependency", "ord", "far")


QUERIES = {
    f.__name__: f
    for f in (
        risk_rules, risk_history, external_calls, external_risk, case_generation, case_priority, case_features, case_ranking, case_keys, topk_per_group, merge_cases, evidence_gate, target_scope, scope_filter, reader_proximity,
    )
}

_FOLDER = "regexp_extract({}, '^([^/]+/[^/]+)/', 1)"
_Q = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
# the values written out once more, so that a list cut short in the engine shows
_TOKENS = {
    ("build_config", "debug_release"): "NDEBUG _DEBUG DEBUG assert static_assert",
    ("ownership_lifetime", "raw_pointer"): "new delete malloc calloc realloc free nullptr NULL unique_ptr shared_ptr weak_ptr make_unique make_shared release auto_ptr",
    ("ownership_lifetime", "move_semantics"): "move forward",
    ("thread_safety", "mutex"): """mutex recursive_mutex shared_mutex timed_mutex recursive_timed_mutex shared_timed_mutex lock_guard unique_lock scoped_lock shared_lock condition_variable condition_variable_any lock unlock
      try_lock notify_one notify_all wait wait_for wait_until call_once once_flag pthread_mutex_lock pthread_mutex_unlock pthread_mutex_t pthread_cond_wait pthread_cond_signal thread async future promise pthread_create detach join""",
    ("thread_safety", "atomic"): """atomic atomic_flag atomic_bool atomic_int memory_order memory_order_relaxed memory_order_acquire memory_order_release memory_order_acq_rel memory_order_seq_cst volatile fetch_add fetch_sub
      compare_exchange_weak compare_exchange_strong exchange load store thread_local""",
    ("exception_safety", "throw_added"): "throw try catch rethrow_exception current_exception exception_ptr terminate",
    ("exception_safety", "noexcept_change"): "noexcept",
    ("logic", ""): "if else switch case default return for while do break continue goto == != < > <= >= && || ! ? : + - * / % ++ -- += -= << >> & | ^ ~ true false",
}
_RULES = "rules(token, g, u) as (values " + ", ".join(f"('{t}', '{g}', '{u}')" for (g, u), ts in _TOKENS.items() for t in ts.split()) + ")"
_HEADER = r"regexp_matches(f, '\.(h|hh|hpp|hxx|ipp|inl)$')"


def _risk_sql(pairs: str) -> str:
    """pairs: with-clauses that give dl (root, o, n): the old and the new version of what changed, either may be null."""
    return rf"""{pairs},
x0 as (select root, o, n, coalesce(n.file, o.file) f, coalesce(n.kind, o.kind) kind, o is not null and n is not null ab, n is null rm, o is null ad from dl),
tk as (select root, t, side, decl from (select root, unnest(o.tokens) t, -1 side, false decl from x0 union all select root, unnest(n.tokens), 1, false from x0
  union all select root, unnest(o.decl_tokens), -1, true from x0 union all select root, unnest(n.decl_tokens), 1, true from x0)),
dt as (select root, t, decl from tk group by 1, 2, 3 having sum(side) <> 0),
{_RULES},
x as (select *, kind in ('function', 'method') fun, ab and o.tokens is distinct from n.tokens body, ab and o.decl_tokens is distinct from n.decl_tokens decl, {_HEADER} hd,
  ab and len(list_filter(o.tokens, lambda t: t = 'if')) > len(list_filter(n.tokens, lambda t: t = 'if')) guard from x0),
abi as (select root, 'member_change' u from x where ab and kind in ('class', 'struct') and (o.bases is distinct from n.bases or coalesce(o.is_virtual, false) <> coalesce(n.is_virtual, false))
  union select root, 'signature_change' from x where (fun and decl) or rm
  union select root, 'inline_change' from x where fun and hd and body and not decl),
k1 as (select root, g risk_group, u sub_reason from dt join rules on token = t where not decl
  union select root, 'abi_layout', u from abi union select root, 'abi_layout', 'header_change' from x where hd and root not in (select root from abi)
  union select root, 'ownership_lifetime', 'move_semantics' from dt where decl and t = '&&'
  union select root, 'thread_safety', 'mutex' from dt where not decl and (regexp_matches(t, '(?i)^\w*(mutex|locker|spinlock|semaphore|critical_?section|guard_?lock)\w*$') or regexp_matches(t, '^\w*Lock$'))
  union select root, 'exception_safety', 'noexcept_change' from x where ab and o.noexcept_spec is distinct from n.noexcept_spec
  union select root, 'logic', '' from dt where not decl and regexp_matches(t, '^-?(0x[0-9a-fA-F]+|[0-9]+(\.[0-9]+)?)[uUlLfF]*$')
  union select root, 'logic', '' from x where fun and (body or ad)
  union select root, 'logic', 'removed_guard' from x where guard),
k2 as (select * from k1 where not (risk_group = 'logic' and sub_reason = '' and root in (select root from x where guard))),
k as (select * from k2 union all select root, 'logic', '' from x where root not in (select root from k2))"""


_RISKS = _risk_sql("dl as (select coalesce(n.usr, o.usr) root, case when o.usr is not null then o end o, case when n.usr is not null then n end n from o full join n on o.usr = n.usr where o.usr is null or n.usr is null or o.tokens <> n.tokens or o.decl_tokens <> n.decl_tokens)")
_HISTORY = _risk_sql("""np as (select s, lead(s) over (order by s) nx from (select distinct snap_no s from v)),
  a as (select nx || '@' || usr k, v from v join np on s = snap_no where nx is not null), b as (select snap_no || '@' || usr k, v from v where snap_no in (select nx from np)),
  dl as (select coalesce(b.k, a.k) root, a.v o, b.v n from a full join b on a.k = b.k where a.k is null or b.k is null or a.v.tokens <> b.v.tokens or a.v.decl_tokens <> b.v.decl_tokens)""")
_FOREIGN = rf"""fc as (select distinct e.dependent root, e.dependency callee, n.decl_tokens dc, n.noexcept_spec nx from e join ch on ch.usr = e.dependent and ch.change_kind <> 'removed' join n on n.usr = e.dependency and n.kind in ('function', 'method')
    where e.relation = 'call' and regexp_extract(ch.file, '^([^/]+/[^/]+)/', 1) <> regexp_extract(n.file, '^([^/]+/[^/]+)/', 1)),
  fd as (select root, callee, array_to_string(dc, ' ') s, coalesce(nx, '') nx from fc),
  fe as (select *, regexp_extract(s, '^(.*?)[A-Za-z_~]\w*\s*\(', 1) res, list_filter(string_split(regexp_extract(s, '^[^(]*\((.*)\)[^()]*$', 1), ','), lambda p: trim(p) <> '') ps, regexp_matches(s, '\)\s*const\b') cst from fd),
  ff as (select root, callee, case when contains(res, '*') then 'pointer' when regexp_matches(res, '\b(bool|int|long|ssize_t|errno_t|\w*[Ss]tatus\w*|\w*[Ee]rror\w*|optional)\b') then 'status' else 'none' end result,
    not regexp_matches(nx, 'noexcept|throw') and not cst may_throw,
    cast(case when cst then 0 else len(list_filter(ps, lambda p: regexp_matches(p, '[*&]') and not regexp_matches(p, '\bconst\b|&\s*&'))) end as integer) out_params,
    cast(len(list_filter(ps, lambda p: regexp_matches(p, '\b(function|\w*[Cc]allback\w*|\w*[Hh]andler\w*)\b|\(\s*\*'))) as integer) callbacks,
    cast(case when cst then 0 else len(list_filter(ps, lambda p, i: regexp_matches(p, '\*|\bspan\b') and coalesce(regexp_matches(ps[i + 1], '\b(size_t|int|unsigned|uint\d+_t)\b'), false))) end as integer) buffers from fe)"""
_CASES = f"""with {E}, {S}, {V}, {CH}, {_ROOTS}, {_RISKS},
sd as (select min(root) root, 'file:' || file node from (select root, file from k join ch on usr = root where risk_group in ('abi_layout', 'build_config') and regexp_matches(file, '\\.(h|hh|hpp|hxx|ipp|inl)$')) group by file having 'file:' || file not in (select root from r)),
{_walk(Settings.max_hop, "union all select root, node from sd")},
nd as (select distinct root, node, hop from arrive union select root, node, 1 from sd),
far as (select node, risk_group, sub_reason, nd.root, nd.hop, starts_with(node, 'file:') fl from nd join k on k.root = nd.root),
kept as (select * from far where not fl or risk_group in {_Q(K.FILE_GROUPS)}),
alla as (select * from kept union all select node, 'abi_layout', '', root, hop, fl from far where fl and node not in (select node from kept where fl)),
allf as (select * from alla qualify hop = min(hop) over (partition by node, risk_group)),
c as (select root node, 0 hop, risk_group, sub_reason, [root] roots from k union all
  select node, min(hop), risk_group, min(sub_reason), list(distinct root order by root) from allf group by node, risk_group)"""
_LOW = f"(sub_reason in {_Q(K.LOW_SUBS)} or (hop > 0 and sub_reason in {_Q(K.IMPACT_LOW_SUBS)}))"
_PRIO = f"""case when sub_reason in ('logging', 'test_code') then 'P3' when sub_reason = 'removed_guard' and hop = 0 then 'P1'
  when sub_reason in {_Q(K.READER_SUBS)} then case when hop <= 1 then 'P2' else 'P3' end
  when hop <= 1 and risk_group in {_Q(K.HIGH)} and not {_LOW} then 'P1' when hop <= 1 or (risk_group in {_Q(K.HIGH)} and not {_LOW}) then 'P2' else 'P3' end"""
_FEAT = "ft as (select x.node, cast(sum(ch.lines) as bigint) lines, count(distinct x.root) fan_in from (select root, node from nd union select root, root from r) x join ch on ch.usr = x.root group by x.node)"
_RANKED = f"""{_CASES}, {_FEAT}, fx as (select file, count(*) fixes from (select distinct id, file, removed_at from symbol where removed_at is not null and file is not null) group by file),
rk as (select c.*, s.name as name, s.file, s.line, row_number() over (order by hop, sub_reason = 'external_call', {_LOW}, -floor(log2(1 + coalesce(lines, 0))), -floor(log2(1 + coalesce(fixes, 0))),
  -(case risk_group {' '.join(f"when '{g}' then {v}" for g, v in K.SEVERITY.items())} end), -coalesce(fan_in, 0), list_position([{', '.join(f"'{g}'" for g in K.GROUPS)}], risk_group), s.file nulls first, s.line nulls first, c.node, sub_reason) rank
  from c left join ft on ft.node = c.node left join s on s.id = c.node left join fx on fx.file = s.file)"""

ORACLE = {
    "risk_rules": f"with {V}, {_RISKS} select * from k",
    "risk_history": f"with {V}, {_HISTORY} select cast(string_split(root, '@')[1] as integer) snap_no, risk_group, sub_reason, count(*) roots from k group by all",
    "external_calls": f"with {E}, {V}, {CH}, {_FOREIGN} select callee, result, may_throw, out_params, callbacks, buffers, count(*) roots from ff group by all",
    "external_risk": f"""with {E}, {V}, {CH}, {_FOREIGN}, sg as (select root, 'ownership_lifetime' g from ff where result = 'pointer' or out_params > 0 union select root, 'exception_safety' from ff where may_throw
      union select root, 'thread_safety' from ff where callbacks > 0 union select root, 'logic' from ff where result = 'status' or buffers > 0 or (result = 'none' and out_params = 0 and callbacks = 0 and buffers = 0 and not may_throw))
      select root, arg_min(g, list_position(['exception_safety', 'ownership_lifetime', 'thread_safety', 'logic'], g)) risk_group, 'external_call' sub_reason from sg group by root""",
    "case_generation": f"{_CASES} select node, hop, risk_group, sub_reason, cast(len(roots) as integer) n_roots, roots[1] first_root from c",
    "case_priority": f"{_CASES} select {_PRIO} priority, hop, risk_group, count(*) cases from c group by all",
    "case_features": f"{_CASES}, {_FEAT} select * from ft",
    "case_ranking": f"{_RANKED} select format('TC-{{:04d}}', rank) id, {_PRIO} priority, node, hop, risk_group, sub_reason from rk",
    "case_keys": f"""{_RANKED}, q as (select rank, substr(sha1(concat_ws(chr(31), coalesce(name, ''), coalesce(file, ''), risk_group, sub_reason, array_to_string(roots, ','), '', '')), 1, 12) x from rk),
      y as (select rank, x, row_number() over (partition by x order by rank) m from q) select rank, case when m = 1 then x else x || '-' || m end "key" from y""",
    "topk_per_group": f"""with {S}, x as (select kind, {_FOLDER.format('file')} folder, id, row_number() over (partition by kind, {_FOLDER.format('file')} order by file nulls first, line nulls first, id) k from s) select kind, folder, id from x where k <= 3""",
    "merge_cases": f"""with {E}, f as (select file, dependency, relation, min(ord) ord from e where file is not null and dependency is not null and relation is not null group by 1, 2, 3)
      select file, dependency, min(ord) ord, string_agg(relation, '; ' order by ord) relation, count(*) merged from f group by 1, 2""",
    "evidence_gate": f"with {S}, {V} select usr, exists (select 1 from s where s.name = n.name and s.file = n.file) resolves from n",
    "target_scope": f"""with {E}, x as (select dependency node, list(distinct nullif({_FOLDER.format('file')}, '')) targets from e where relation = 'include' and dependency like 'file:%' and file is not null group by 1),
      w as (select list(distinct {_FOLDER.format('file')}) w from core_symbol where kind = 'class' and {_FOLDER.format('file')} <> '')
      select node, len(list_filter(targets, lambda q: q is not null)) = 0 or list_has_any(targets, w) in_scope from x, w""",
    "scope_filter": f"""with {S} select kind, coalesce(regexp_matches(file, '(^|/)[a-z]+_(monitor|guard)_[0-9]+\\.'), false) out_of_scope, count(*) symbols from s group by all""",
    "reader_proximity": f"""with {E}, {V}, {CH}, x as (select e.dependency, ord, case when e.file = ch.file then 0 when {_FOLDER.format('e.file')} = {_FOLDER.format('ch.file')} then 1 else 2 end far from e join ch on ch.usr = e.dependency where dependent is not null),
      y as (select *, row_number() over (partition by dependency order by far, ord) k from x) select dependency, ord, far from y where k <= 5""",
}
