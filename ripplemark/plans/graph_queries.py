"""Queries of the impact graph and of change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.operators import changes as C
from ripplemark.operators import graph as G
from ripplemark.plans import bindings as B
from ripplemark.plans.bindings import CH, E, PE, S, V
from ripplemark.sources.settings import Settings
from ripplemark.sources.tables import table


Two = tuple[DataFrame, DataFrame]


def changed(spark: SparkSession, d: str) -> DataFrame:
    return C.changed_symbols(*B.last_two(spark, d))


def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d).select("usr", "file", "kind", "change_kind", F.col("lines").cast("bigint").alias("lines"))


def _roots(spark: SparkSession, d: str, changes: DataFrame | None = None) -> DataFrame:
    c = changed(spark, d) if changes is None else changes
    return c.select(F.col("usr").alias("root"), G.traverse_limit(F.col("kind"), F.col("same_shape"), F.lit(False)).alias("limit"))


def traverse_limits(spark: SparkSession, d: str) -> DataFrame:
    return _roots(spark, d).select("root", F.array_join("limit", ",").alias("relations"))


def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = G.reach(B.edges(spark, d), _roots(spark, d), Settings.max_hop, 0)
    return nodes.groupBy("node").agg(F.min("hop").alias("hop"), F.count(F.lit(1)).alias("roots"), F.min("root").alias("first_root"))


def impact_deep(spark: SparkSession, d: str) -> DataFrame:
    """Reach by hop count up to 4 hops over all edges from all changed symbols."""
    nodes, _ = G.reach(B.edges(spark, d), changed(spark, d).select(F.col("usr").alias("root")), 4, 0)
    return nodes.groupBy("hop").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("node").alias("nodes"))


def reach_edges_topk(spark: SparkSession, d: str, hops: int = Settings.max_hop) -> DataFrame:
    _, found = G.reach(B.edges(spark, d), _roots(spark, d), hops, G.EDGES_A_ROOT)
    return G.reach_edges(found).select("root", "node", "ord", "relation")



def edges_resolved(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_resolved(B.edges(spark, d), B.symbols(spark, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


def callers(spark: SparkSession, d: str) -> DataFrame:
    return G.callers(B.edges(spark, d)).groupBy("callee").agg(F.count(F.lit(1)).alias("callers"))


def override_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = B.edges(spark, d).where("relation = 'inherit_override'").select(F.col("dependent").alias("cls"), F.col("dependency").alias("base")).distinct()
    s = B.symbols(spark, d)
    # a class's methods carry their class as parent; a method that overrides stands for its class
    owner = s.select(F.col("id").alias("m"), F.coalesce("parent", "id").alias("c"))
    b = e.join(owner.select(F.col("m").alias("cls"), F.col("c").alias("a")), "cls").join(owner.select(F.col("m").alias("base"), F.col("c").alias("b")), "base")
    methods = s.where("parent is not null").withColumn("display", F.regexp_extract("spelling", "^[a-z]+", 0))
    return G.override_groups(methods, b.select(F.col("a").alias("cls"), F.col("b").alias("base")).where("cls <> base")).select("method", F.array_join("overrides", " ").alias("overrides"))


def target_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of folders of which one needs the other over any distance, by any relation."""
    return G.closure(_folder_deps(spark, d), "target", "needs")


def _folder(c: str) -> F.Column:
    return F.regexp_extract(c, r"^([^/]+/[^/]+)/", 1)


def _folder_deps(spark: SparkSession, d: str) -> DataFrame:
    s = B.symbols(spark, d).select("id", _folder("file").alias("t")).where("t <> ''")
    e = B.edges(spark, d)
    return (
        e.join(s.select(F.col("id").alias("dependent"), F.col("t").alias("target")), "dependent")
        .join(s.select(F.col("id").alias("dependency"), F.col("t").alias("needs")), "dependency")
        .where("target <> needs").select("target", "needs").distinct()
    )


def affected_targets(spark: SparkSession, d: str) -> DataFrame:
    """Folders that any change touches, and all that need them by any relation."""
    touched = changed(spark, d).select(_folder("file").alias("target")).where("target <> ''")
    return G.affected_targets(touched, _folder_deps(spark, d))


def file_targets(spark: SparkSession, d: str) -> DataFrame:
    """Folders a file belongs to: its own, and those of the files that include it."""
    e = B.edges(spark, d).where("relation = 'include'").select(F.col("dependency").alias("path"), F.col("dependent").alias("by")).where("path like 'file:%' and `by` like 'file:%'").distinct()
    own = e.select(F.explode(F.array("path", "by")).alias("path")).distinct().select("path", F.regexp_extract("path", r"^file:([^/]+/[^/]+)/", 1).alias("target"))
    via = e.select("path", F.regexp_extract("by", r"^file:([^/]+/[^/]+)/", 1).alias("target"))
    return own.unionByName(via).where("target <> ''").distinct()


def overlay_unknown(spark: SparkSession, d: str) -> DataFrame:
    return G.overlay_unknown(B.provider(spark, d), B.symbols(spark, d))[1]


def overlay_kept(spark: SparkSession, d: str) -> DataFrame:
    return G.overlay_unknown(B.provider(spark, d), B.symbols(spark, d))[0].select("edge_id", "dependent", "dependency", "relation")


def choose_def(spark: SparkSession, d: str) -> DataFrame:
    v = B.last_two(spark, d)[1].select(F.col("usr").alias("ref"), "name", "file", F.col("start_line").alias("line"))
    return G.choose_definition(v, B.symbols(spark, d)).groupBy("ref").agg(F.min("tier").alias("tier"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def resolve_symbols(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "core_symbol").select(F.col("spelling").alias("want")).union(changed(spark, d).select("name")).distinct().where("want is not null")
    return G.resolve_symbols(w, B.symbols(spark, d))


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return G.entry_points(G.callers(B.edges(spark, d)), changed(spark, d).select(F.col("usr").alias("start"))).select("start", F.array_join("entries", " ").alias("entries"), "more")


def downstream_edges(spark: SparkSession, d: str) -> DataFrame:
    """Callees on the lines of changed functions."""
    e = B.edges(spark, d).where("relation = 'call' and dependency is not null and dependent is not null and line is not null and file is not null")
    c = changed(spark, d).where("change_kind <> 'removed'").select("file").distinct()
    calls = e.select(F.col("dependent").alias("caller"), F.col("dependency").alias("callee"), "file", "line")
    lines = calls.join(c, "file", "left_semi").select("file", "line")
    return G.downstream_edges(calls, lines)


def include_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Include edges of files by the last two parts of the path, resolved again over all files."""
    files = B.symbols(spark, d).select(F.col("file").alias("path")).where("path is not null").distinct()
    e = B.edges(spark, d).where("relation = 'include' and dependency like 'file:%' and file is not null").select("file", F.regexp_extract("dependency", r"([^/:]+/[^/]+)$", 1).alias("wanted")).where("wanted <> ''").distinct()
    return G.resolve_includes(e, files)


def test_gaps(spark: SparkSession, d: str, hops: int = Settings.max_hop) -> DataFrame:
    """Changed symbols that nothing in a monitor or guard file reaches within so many hops."""
    roots = changed(spark, d).select(F.col("usr").alias("root"))
    _, found = G.reach(B.edges(spark, d), roots, hops)
    return G.test_gaps(roots, found, F.coalesce(F.col("file").rlike(r"(^|/)[a-z]+_(monitor|guard)_"), F.lit(False)))



def split_units(spark: SparkSession, d: str, hops: int = Settings.max_hop) -> DataFrame:
    """Reach by unit: the folder of the root carried through the walk."""
    c = changed(spark, d)
    nodes, _ = G.reach(B.edges(spark, d), c.select(F.col("usr").alias("root")), hops, 0)
    return nodes.join(c.select(F.col("usr").alias("root"), _folder("file").alias("unit")), "root").groupBy("unit").agg(F.countDistinct("node").alias("nodes"), F.max("hop").alias("hop"))



def innermost_range(spark: SparkSession, d: str) -> DataFrame:
    """The function around the place of each macro use."""
    p = B.edges(spark, d).where("relation = 'macro_expand' and file is not null and line is not null").select("ord", "file", "line")
    x = B.symbols(spark, d).where("kind in ('function', 'method') and end_line is not null").select("file", F.col("id").alias("usr"), F.col("line").alias("start_line"), "end_line")
    return C.innermost(p, x).select("ord", F.coalesce("usr", F.concat(F.lit("file:"), "file")).alias("usr"))


def residual_lines(spark: SparkSession, d: str) -> DataFrame:
    p = B.edges(spark, d).where("file is not null and line is not null").select("ord", "file", "line")
    x = B.symbols(spark, d).where("kind <> 'file' and end_line is not null").select("file", F.col("line").alias("start_line"), "end_line")
    return C.residual(p, x)


def residual_functions(spark: SparkSession, d: str) -> DataFrame:
    """Places outside the last snapshot's extents, looked up in those of the one before."""
    old, new = B.last_two(spark, d)
    p = B.edges(spark, d).where("relation = 'call' and file is not null and line is not null").select("ord", "file", "line")
    r = C.residual(p, new)
    return C.innermost(r, old.select("file", "usr", "start_line", "end_line")).where("usr is not null").select("ord", "usr")


def changed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Distinct callees on lines inside changed functions, with the first line."""
    x = B.last_two(spark, d)[1].join(changed(spark, d).select("usr"), "usr", "left_semi").select("file", "usr", "start_line", "end_line")
    p = B.edges(spark, d).where("relation = 'call' and dependency is not null and file is not null and line is not null").select("dependency", "file", "line").distinct()
    return C.innermost(p, x).where("usr is not null and usr <> dependency").groupBy("usr", "dependency").agg(F.min("line").alias("line"))


def function_body(spark: SparkSession, d: str) -> DataFrame:
    """Edge lines a function holds: the number and the bounds, by innermost function."""
    x = B.last_two(spark, d)[1].where("kind in ('function', 'method')").select("file", "usr", "start_line", "end_line")
    p = B.edges(spark, d).where("file is not null and line is not null").select("file", "line").distinct()
    return C.innermost(p, x).where("usr is not null").groupBy("usr").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"), F.max("line").alias("last"))


def qualify_names(spark: SparkSession, d: str) -> DataFrame:
    v = B.last_two(spark, d)[1].select("usr", "file", F.element_at(F.split("name", "::"), -1).alias("spelling"))
    return C.qualify_names(v, B.symbols(spark, d)).select("usr", "full_name")


def facts_merge(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "symbol").select("id", "is_def", "file", "line", "name").distinct()
    return C.merge_facts(f, "id", ["file", "line", "name"], "file").select("id", "is_def", "file", "line", F.size("decl_files").alias("others"))


def token_delta(spark: SparkSession, d: str) -> DataFrame:
    old, new = B.last_two(spark, d)
    j = old.select("usr", F.col("tokens").alias("a")).join(new.select("usr", F.col("tokens").alias("b")), "usr").where("a <> b")
    added, removed = C.bag_delta(F.col("a"), F.col("b"))
    return j.select("usr", F.array_join(added, " ").alias("added"), F.array_join(removed, " ").alias("removed"))


def new_values(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a modified symbol has that it had not before, in order of first place."""
    old, new = B.last_two(spark, d)
    j = old.select("usr", F.col("tokens").alias("a")).join(new.select("usr", F.col("tokens").alias("b")), "usr")
    return j.select("usr", F.array_join(F.array_except("b", "a"), " ").alias("new_tokens")).where("new_tokens <> ''")


def fix_history(spark: SparkSession, d: str) -> DataFrame:
    """Fix-like commit texts per source within 360 days before the newest document."""
    docs = table(spark, d, "documents").where("written_at is not null")
    last = docs.agg(F.max("written_at").alias("m")).first()["m"]
    c = docs.select(F.col("doc_id").alias("commit"), F.col("source").alias("file"), F.col("written_at").alias("at"), F.col("text").alias("subject"))
    return C.fix_counts(c, F.lit(last).cast("timestamp_ntz"), 360, r"\b([Ff]ix(es|ed)?|[Bb]ug|[Rr]egression|[Cc]rash)\b")


def szz_vote(spark: SparkSession, d: str) -> DataFrame:
    """For each file the folder that most edges into it come from."""
    e = B.edges(spark, d).where("file is not null and dependency is not null").select(F.col("file").alias("fix"), F.col("dependency").alias("intro"))
    return C.szz_vote(e)


QUERIES = {
    f.__name__: f
    for f in (
        changed_symbols, traverse_limits, impact_bfs, impact_deep, reach_edges_topk, edges_resolved, callers, override_pairs, target_dependents, affected_targets, file_targets,
        overlay_unknown, overlay_kept, choose_def, resolve_symbols, entry_points, downstream_edges, include_resolve, test_gaps, split_units, innermost_range, residual_lines,
        residual_functions, changed_calls, function_body, qualify_names, facts_merge, token_delta, new_values, fix_history, szz_vote,
    )
}

_ROOTS = "r as (select usr root, case when kind in ('class', 'struct', 'union') and usr in (select o.usr from o join n on o.usr = n.usr where o.bases = n.bases and o.decl_tokens = n.decl_tokens) then ['inherit_override', 'include'] end lim from ch)"
_ONE_HOP = "h1 as (select r.root, e.dependent node, 1 hop, e.ord, e.relation, e.file, e.line from r join e on e.dependency = r.root where e.dependent is not null and e.dependent not in (select root from r) and (r.lim is null or list_contains(r.lim, e.relation)))"
_STEP = """h{k} as (select h.root, e.dependent node, {k} hop, e.ord, e.relation, e.file, e.line from (select distinct root, node from h{p} where relation <> 'called_by_change' {sown}) h join e on e.dependency = h.node
  where e.dependent is not null and e.relation not in ('contains', 'uses_type') and e.dependent not in (select root from r) and not exists (select 1 from ({seen}) x where x.root = h.root and x.node = e.dependent))"""


def _walk(hops: int, sown: str = "") -> str:
    """The walk of the engine: h1, h2, ... are the edges that arrive at a node at its least hop, arrive all of them; sown
    adds what is reached at hop 1 without an edge."""
    steps = [_ONE_HOP]
    for k in range(2, hops + 1):
        seen = " union all ".join(f"select root, node from h{i}" for i in range(1, k))
        steps.append(_STEP.format(k=k, p=k - 1, sown=sown if k == 2 else "", seen=f"{seen} {sown}"))
    return ", ".join(steps) + ", arrive as (" + " union all ".join(f"select * from h{k}" for k in range(1, hops + 1)) + "), reach as (select root, root node, 0 hop from r union select root, node, hop from arrive)"


_REACH = _walk(Settings.max_hop)
_ANY_ROOT = "r as (select usr root, null::varchar[] lim from ch)"
_FOLDER = "regexp_extract({}, '^([^/]+/[^/]+)/', 1)"
_FDEPS = f"""fd as (select distinct a.t target, b.t needs from e join (select id, {_FOLDER.format('file')} t from s) a on a.id = e.dependent join (select id, {_FOLDER.format('file')} t from s) b on b.id = e.dependency
  where a.t <> '' and b.t <> '' and a.t <> b.t)"""
_ALL = f"with {E}, {V}, {CH}, {_ROOTS}, {_REACH}"
_UNLIMITED = f"with {E}, {V}, {CH}, {_ANY_ROOT}, {_REACH}"
_PRE = f"with {E}, {S}"
_INNER = "select p.{k}, (select x.usr from {x} x where x.file = p.file and p.line between x.start_line and x.end_line order by x.end_line - x.start_line, x.usr limit 1) usr from {p} p"

ORACLE = {
    "changed_symbols": f"with {V}, {CH} select usr, file, kind, change_kind, cast(lines as bigint) lines from ch",
    "traverse_limits": f"with {V}, {CH}, {_ROOTS} select root, array_to_string(lim, ',') relations from r",
    "impact_bfs": f"{_ALL} select node, min(hop) hop, count(*) roots, min(root) first_root from reach group by node",
    "impact_deep": f"with {E}, {V}, {CH}, {_ANY_ROOT}, {_walk(4)} select hop, count(*) pairs, count(distinct node) nodes from reach group by hop",
    "reach_edges_topk": f"""{_ALL}, a as (select *, row_number() over (partition by root, node order by ord) x from arrive), b as (select *, row_number() over (partition by node order by ord, root) y from a where x <= 6)
      select root, node, ord, relation from b where y <= 12""",
    "edges_resolved": f"{_PRE} select relation, count(*) edges from e where dependent in (select id from s) and dependency in (select id from s) group by relation",
    "callers": f"with {E} select dependency callee, count(distinct dependent) callers from e where relation = 'call' and dependency is not null and dependent is not null group by 1",
    "override_pairs": f"""with recursive {E}, {S}, ow as (select id m, coalesce(parent, id) c from s),
      up0 as (select distinct a.c cls, b.c base from e join ow a on a.m = e.dependent join ow b on b.m = e.dependency where e.relation = 'inherit_override' and a.c <> b.c),
      up(cls, base) as (select cls, base from up0 union select up.cls, up0.base from up join up0 on up.base = up0.cls),
      m as (select distinct id, parent, regexp_extract(spelling, '^[a-z]+') spelling, coalesce(is_virtual, false) v from s where parent is not null and spelling is not null),
      o as (select a.id x, b.id y from m a join up on up.cls = a.parent join m b on b.parent = up.base and b.spelling = a.spelling where (a.v or b.v) and a.id <> b.id)
      select x "method", string_agg(distinct y, ' ' order by y) overrides from (select x, y from o union select y, x from o) group by x""",
    "target_dependents": f"with recursive {E}, {S}, {_FDEPS}, c(target, needs) as (select * from fd union select c.target, fd.needs from c join fd on c.needs = fd.target) select * from c",
    "affected_targets": f"""with recursive {E}, {S}, {V}, {CH}, {_FDEPS}, c(target, needs) as (select * from fd union select c.target, fd.needs from c join fd on c.needs = fd.target),
      t as (select distinct {_FOLDER.format('file')} target from ch where {_FOLDER.format('file')} <> '')
      select target, null::varchar via from t union all select target, min(needs) from c where needs in (select target from t) and target not in (select target from t) group by target""",
    "file_targets": f"""with {E}, i as (select distinct dependency path, dependent b from e where relation = 'include' and dependency like 'file:%' and dependent like 'file:%'),
      x as (select path, path q from i union select b, b from i union select path, b from i) select distinct path, regexp_extract(q, '^file:([^/]+/[^/]+)/', 1) target from x where regexp_extract(q, '^file:([^/]+/[^/]+)/', 1) <> ''""",
    "overlay_unknown": f"""with {PE}, {S}, one as (select * from pe where edge_id in (select min(edge_id) from pe where dependent is not null and dependency is not null group by dependent, dependency, relation)),
      lost as (select distinct run_id, id from (select run_id, dependent id from one union select run_id, dependency from one) where id not in (select id from s)),
      g as (select run_id, list(id order by id) ids from lost group by run_id) select run_id, array_to_string(ids[1:3], ', ') first_ids, cast(greatest(len(ids) - 3, 0) as integer) more from g""",
    "overlay_kept": f"""with {PE}, {S} select edge_id, dependent, dependency, relation from pe where edge_id in (select min(edge_id) from pe where dependent is not null and dependency is not null group by dependent, dependency, relation)
      and dependent in (select id from s) and dependency in (select id from s)""",
    "choose_def": f"""with {S}, {V}, j as (select n.usr ref, s.id, abs(n.start_line - s.line) gap, count(*) over (partition by n.usr) k, s.file = n.file f, s.name = n.name m from n join s on s.spelling = string_split(n.name, '::')[-1]),
      t as (select *, case when f and gap <= 3 then 0 when m then 1 when f then 2 when k = 1 then 3 end tier from j), b as (select *, min(tier) over (partition by ref) lo from t where tier is not null),
      c as (select *, row_number() over (partition by ref order by gap, id) rn from b where tier = lo)
      select ref, min(tier) tier, count(*) n, min(id) id from c where tier > 0 or rn = 1 group by ref""",
    "resolve_symbols": f"""with {S}, {V}, {CH}, w as (select spelling want from core_symbol union select name from ch), x as (select want, id from w join s on s.name = want)
      select * from x union all select want, s.id from (select * from w where want is not null and want not in (select want from x)) w left join s on ends_with(s.name, '::' || want)""",
    "entry_points": f"""with {E}, {V}, {CH}, c as (select distinct dependency callee, dependent caller from e where relation = 'call' and dependency is not null and dependent is not null),
      l0 as (select usr start, usr node from ch),
      l1 as (select distinct start, node f, caller node from l0 join c on callee = node where caller <> start),
      s1 as (select start, node from l0 union select start, node from l1),
      l2 as (select distinct l1.start, l1.node f, caller node from (select distinct start, node from l1) l1 join c on callee = l1.node where (l1.start, caller) not in (select start, node from s1)),
      s2 as (select start, node from s1 union select start, node from l2),
      l3 as (select distinct l2.start, l2.node f, caller node from (select distinct start, node from l2) l2 join c on callee = l2.node where (l2.start, caller) not in (select start, node from s2)),
      ends as (select start, node from l1 where (start, node) not in (select start, f from l2) union select start, node from l2 where (start, node) not in (select start, f from l3) union select start, node from l3),
      g as (select start, list(node order by node) ns from ends group by start) select start, array_to_string(ns[1:5], ' ') entries, cast(greatest(len(ns) - 5, 0) as integer) more from g""",
    "downstream_edges": f"""with {E}, {V}, {CH}, k as (select dependent root, dependency callee, min(line) line from e where relation = 'call' and dependency is not null and line is not null and dependent <> dependency
        and file in (select file from ch where change_kind <> 'removed') group by 1, 2), x as (select *, row_number() over (partition by root order by line, callee) rn from k) select root, callee, line from x where rn <= 8""",
    "include_resolve": f"""{_PRE}, w as (select distinct file, regexp_extract(dependency, '([^/:]+/[^/]+)$', 1) wanted from e where relation = 'include' and dependency like 'file:%' and file is not null and regexp_extract(dependency, '([^/:]+/[^/]+)$', 1) <> ''),
      f as (select distinct file path from s where file is not null), j as (select w.file, wanted, path, row_number() over (partition by w.file, wanted order by (regexp_replace(w.file, '[^/]*$', '') <> regexp_replace(path, '[^/]*$', ''))::int, length(path), path) rn
      from w join f on path = wanted or ends_with(path, '/' || wanted)) select file, wanted, path found from j where rn = 1""",
    "test_gaps": f"""{_UNLIMITED} select root from r where root not in (select root from arrive where regexp_matches(coalesce(file, ''), '(^|/)[a-z]+_(monitor|guard)_'))""",
    "split_units": f"""{_UNLIMITED} select {_FOLDER.format('ch.file')} unit, count(distinct node) nodes, max(hop) hop from reach join ch on ch.usr = root group by 1""",
    "innermost_range": f"""{_PRE}, p as (select ord, file, line from e where relation = 'macro_expand' and file is not null and line is not null), x as (select file, id usr, line start_line, end_line from s where kind in ('function', 'method') and end_line is not null),
      i as ({_INNER.format(k='ord, p.file', x='x', p='p')}) select ord, coalesce(usr, 'file:' || file) usr from i""",
    "residual_lines": f"""{_PRE} select ord, file, line from e where file is not null and line is not null and not exists (select 1 from s where s.file = e.file and s.kind <> 'file' and e.line between s.line and s.end_line)""",
    "residual_functions": f"""with {E}, {V}, p as (select ord, file, line from e where relation = 'call' and file is not null and line is not null and not exists (select 1 from n where n.file = e.file and e.line between n.start_line and n.end_line)),
      i as ({_INNER.format(k='ord', x='o', p='p')}) select * from i where usr is not null""",
    "changed_calls": f"""with {E}, {V}, {CH}, x as (select * from n where usr in (select usr from ch)), p as (select distinct dependency, file, line from e where relation = 'call' and dependency is not null and file is not null and line is not null),
      i as ({_INNER.format(k='dependency, p.line', x='x', p='p')}) select usr, dependency, min(line) line from i where usr is not null and usr <> dependency group by 1, 2""",
    "function_body": f"""with {E}, {V}, x as (select * from n where kind in ('function', 'method')), p as (select distinct file, line from e where file is not null and line is not null),
      i as ({_INNER.format(k='file, p.line', x='x', p='p')}) select usr, count(*) lines, min(line) "first", max(line) "last" from i where usr is not null group by usr""",
    "qualify_names": f"""with {S}, {V}, q as (select file, spelling, min(name) full_name from s group by 1, 2 having count(distinct name) = 1)
      select usr, coalesce(q.full_name, string_split(n.name, '::')[-1]) full_name from n left join q on q.file = n.file and q.spelling = string_split(n.name, '::')[-1]""",
    "facts_merge": """with f as (select distinct trim(id) id, is_def, file, line, name from symbol), x as (select *, row_number() over (partition by id order by (not coalesce(is_def, false))::int, file nulls first, line nulls first, name nulls first) rn,
      count(distinct file) over (partition by id) k from f) select id, is_def, file, line, cast(k - (file is not null)::int as integer) others from x where rn = 1""",
    "token_delta": f"""with {V}, j as (select o.usr, o.tokens a, n.tokens b from o join n on o.usr = n.usr where o.tokens <> n.tokens),
      ta as (select usr, t, count(*) c from (select usr, unnest(a) t from j) group by 1, 2), tb as (select usr, t, count(*) c from (select usr, unnest(b) t from j) group by 1, 2),
      x as (select coalesce(ta.usr, tb.usr) usr, coalesce(ta.t, tb.t) t, coalesce(tb.c, 0) - coalesce(ta.c, 0) k from ta full join tb on ta.usr = tb.usr and ta.t = tb.t),
      y as (select usr, t, k, unnest(range(abs(k))) from x where k <> 0)
      select j.usr, coalesce((select string_agg(t, ' ' order by t) from y where y.usr = j.usr and k > 0), '') added, coalesce((select string_agg(t, ' ' order by t) from y where y.usr = j.usr and k < 0), '') removed from j""",
    "new_values": f"""with {V}, j as (select o.usr, o.tokens a, n.tokens b from o join n on o.usr = n.usr), u as (select usr, a, unnest(b) t, generate_subscripts(b, 1) p from j),
      x as (select usr, t, min(p) p from u where not list_contains(a, t) group by 1, 2) select usr, string_agg(t, ' ' order by p) new_tokens from x group by usr""",
    "fix_history": """select source file, count(distinct doc_id) fixes from documents where written_at > (select max(written_at) from documents) - interval 360 days and regexp_matches(text, '\\b([Ff]ix(es|ed)?|[Bb]ug|[Rr]egression|[Cc]rash)\\b') group by 1""",
    "szz_vote": f"""with {E}, k as (select file fix, dependency intro, count(*) votes from e where file is not null and dependency is not null group by 1, 2),
      x as (select *, row_number() over (partition by fix order by votes desc, intro) rn from k) select fix, intro, votes from x where rn = 1""",
}
