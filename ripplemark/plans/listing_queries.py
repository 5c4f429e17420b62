"""Queries over the statements of the functions in the listings among the documents.

A listing's function counts as changed if the symbol table knows its name. Names of variables in the listings are made of a
prefix, an attribute and a noun; the attribute is left out, so that functions share state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.functions import text as X
from ripplemark.operators import detectors as D
from ripplemark.operators import evidence as V
from ripplemark.operators import flow
from ripplemark.plans import bindings as B
from ripplemark.plans.bindings import H, L
from ripplemark.plans.bindings import V as VERSIONS
from ripplemark.plans.text_queries import _DIFF
from ripplemark.runtime import Staged
from ripplemark.sources.tables import table

HEAD = r"^[a-z ]+([A-Za-z]+)::([A-Za-z_]+)\(([^)]*)\) \{"
ASSIGN = r"^ *([A-Za-z_]+) = ([A-Za-z_]+)\(([A-Za-z_]+)"
GUARD = r"^ *if \(([A-Za-z_]+) (?:<=|>=|==|!=|<|>) [0-9]+\) return"
LOCK = r"lock_guard<[^>]*> [a-z]+\(([A-Za-z_]+)\)"
NOUN = r"^(m_|g_|k)?[A-Za-z][a-z]*([A-Z][A-Za-z]*)$"
DEPTH = 3
_GET = ["collect", "poll", "decode", "wake", "release", "drain", "rewind", "trim", "clamp", "seal", "refresh", "validate"]
VERBS = {v: _GET for v in ("probe", "commit", "settle", "publish", "encode", "park", "acquire", "flush", "stage", "notify", "expire", "adopt", "arm", "merge", "route")}
#: What this code base gives data away through, by name.
SINKS = ["encode*", "route*", "flush*", "commit*", "stage*"]


def _statements(spark: SparkSession, d: str) -> DataFrame:
    lines = B.lines(spark, d)
    w = Window.partitionBy("file").orderBy("no")
    head = F.col("text").rlike(HEAD)
    g = lambda rx, i: F.regexp_extract("text", rx, i)
    at = F.last(F.when(head, F.struct(F.col("no").alias("fn"), g(HEAD, 1).alias("cls"), g(HEAD, 2).alias("short"))), ignorenulls=True).over(w)
    kind = F.when(F.col("text").rlike(ASSIGN), "assign").when(F.col("text").rlike(GUARD), "guard").when(F.col("text").rlike(LOCK), "lock")
    x = lines.withColumn("at", at).withColumn("kind", kind).where("at is not null and kind is not null")
    noun = lambda c: F.regexp_replace(c, NOUN, "$1$2")
    name = noun(F.when(F.col("kind") == "assign", g(ASSIGN, 1)).when(F.col("kind") == "guard", g(GUARD, 1)).otherwise(g(LOCK, 1)))
    only = lambda i: F.when(F.col("kind") == "assign", g(ASSIGN, i))
    return x.select(F.concat_ws(":", "file", "at.fn").alias("usr"), "at.cls", "at.short", "file", "no", "kind", name.alias("name"), only(2).alias("callee"), noun(only(3)).alias("source"))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Statements, and the functions that changed."""
    st = Staged(_statements(spark, d), "statements").df
    names = table(spark, d, "symbol").select(F.col("spelling").alias("short")).distinct()
    return st, st.select("usr", "short").distinct().join(names, "short", "left_semi").select("usr")


def trigger_sources(spark: SparkSession, d: str) -> DataFrame:
    return D.trigger_sources(*_two(spark, d))


def pattern_lock_coupling(spark: SparkSession, d: str) -> DataFrame:
    return D.lock_coupling(*_two(spark, d))


def _conditions(st: DataFrame, changed: DataFrame) -> DataFrame:
    return st.where("kind = 'guard'").join(changed, "usr", "left_semi").select("usr", "no")


def pattern_conditional_write(spark: SparkSession, d: str) -> DataFrame:
    st, changed = _two(spark, d)
    return D.conditional_write(st, _conditions(st, changed))


def pattern_class_member(spark: SparkSession, d: str) -> DataFrame:
    return D.class_consumer(*_two(spark, d))


def pattern_guarded_callee(spark: SparkSession, d: str) -> DataFrame:
    st, changed = _two(spark, d)
    return D.guard_removed_callee(st, _conditions(st, changed))


def registered_flags(spark: SparkSession, d: str) -> DataFrame:
    """Guarded functions some of whose callers are static ones, which others may hold as callbacks."""
    st, changed = _two(spark, d)
    src = D.trigger_sources(st, changed).select(F.col("callee").alias("root"), F.col("usr").alias("source"))
    static = B.lines(spark, d).where(F.col("text").rlike("^static auto [A-Za-z]+::")).select(F.concat_ws(":", "file", "no").alias("source"))
    return V.registered_flags(src, static, static.limit(0)).select("root", "category", "detail")


def _flow(st: DataFrame) -> dict[str, DataFrame]:
    """The value graph of the statements: assignments within a function, names that others see, arguments and results."""
    a = st.where("kind = 'assign'")
    node = lambda v: F.concat_ws("|", "usr", v)
    seen = lambda v: F.concat_ws("|", F.lit("store"), D.place(F.col(v), F.col("cls")), v)
    shared = lambda v: F.col(v).rlike(D.SHARED)
    arg = lambda c: F.concat_ws("|", F.lit("arg"), c)
    back = lambda c: F.concat_ws("|", F.lit("result"), c)
    functions = st.select("usr", "short").distinct()
    exits = [a.where(shared("name")).select(node("name").alias("node"), seen("name").alias("channel")), a.select(node("source").alias("node"), arg("callee").alias("channel")), functions.select(F.concat_ws("|", "usr", F.lit("return")).alias("node"), back("short").alias("channel"))]
    entries = [a.where(shared("source")).select(seen("source").alias("channel"), node("source").alias("node")), functions.select(arg("short").alias("channel"), F.concat_ws("|", "usr", F.lit("n")).alias("node")), a.select(back("callee").alias("channel"), node("name").alias("node"))]
    union = lambda xs: xs[0].unionByName(xs[1]).unionByName(xs[2]).distinct()
    return {
        "within": a.select(node("source").alias("src"), node("name").alias("dst")).distinct(),
        "exits": Staged(union(exits), "exits").df,
        "entries": Staged(union(entries), "entries").df,
        "calls": a.select(node("source").alias("node"), "usr", "callee", flow.is_emitter(F.col("callee"), F.lit(False), SINKS).alias("emits")).distinct(),
    }


def _traced(spark: SparkSession, d: str) -> DataFrame:
    st, changed = _two(spark, d)
    f = _flow(st)
    starts = st.where("kind = 'assign'").join(changed, "usr", "left_semi").select(F.col("usr").alias("root"), F.concat_ws("|", "usr", "name").alias("node"))
    return flow.flow(f["within"], f["exits"], f["entries"], starts, f["calls"])


def data_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where values that changed functions make are given away, and how many functions on."""
    return flow.emitting(_traced(spark, d), DEPTH)


def data_reach(spark: SparkSession, d: str) -> DataFrame:
    return flow.reach_counts(_traced(spark, d), DEPTH)


def data_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Flags for what leaves the traced paths."""
    b = flow.breaks(_traced(spark, d), DEPTH, V.SHOWN)
    return V.first_breaks(b.select("root", F.concat_ws(": ", "why", "channel").alias("place"), "n")).select("root", "category", "detail")


def pattern_setter_readers(spark: SparkSession, d: str) -> DataFrame:
    """Removed calls in diffs, and who in the listings calls what answers them."""
    df = X.parse_diff(B.lines(spark, d))
    call = F.regexp_extract("text", ASSIGN, 2)
    side = lambda s: df.where(F.col("side") == s).select(F.concat_ws("#", "file", "path").alias("root"), call.alias("callee")).where("callee <> ''").distinct()
    removed = side("old").join(side("new"), ["root", "callee"], "left_anti").withColumn("owner", F.lit(None).cast("string"))
    calls = _statements(spark, d).where("kind = 'assign'").select("usr", "callee", F.lit(None).cast("string").alias("owner"))
    return D.setter_readers(removed, calls, VERBS)


def _identifiers(df: DataFrame) -> DataFrame:
    return df.select("usr", F.explode(F.array_distinct("tokens")).alias("name")).where(F.col("name").rlike(r"^[A-Za-z_]\w{3,}$"))


def pattern_changed_default(spark: SparkSession, d: str) -> DataFrame:
    """Values that changed from a snapshot to the next, and who in the last one reads them."""
    old, new = B.history(spark, d)
    c = D.changed_defaults(old, new).select(B.plain().alias("usr"), "name").distinct()
    return D.readers_of(c, _identifiers(B.last_two(spark, d)[1]))


def pattern_new_enum_value(spark: SparkSession, d: str) -> DataFrame:
    """Names that types hold stand for enumerators, functions of the last snapshot that hold them for switches."""
    old, new = B.history(spark, d)
    types = lambda v: _identifiers(v.where("kind in ('class', 'struct')")).where(~F.col("name").isin(*KEYWORDS))
    users = _identifiers(B.last_two(spark, d)[1].where("kind in ('function', 'method')")).where(~F.col("name").isin(*KEYWORDS))
    return D.new_enum_value(types(old), types(new), users)


KEYWORDS = ["return", "true", "false", "break", "auto", "nullptr", "const", "while"]


def log_only(spark: SparkSession, d: str) -> DataFrame:
    """Diffs whose changed lines are all statements about sensors and pedals, which stand for logging here, with what
    continues them."""
    r = X.parse_diff(B.lines(spark, d))
    rows = r.groupBy("file", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "line", "text"))), lambda x: x["text"]).alias("lines"))
    return rows.select("file", "path", F.size("lines").alias("changed"), X.log_only(F.col("lines"), LOGGING).alias("log_only"))


LOGGING = r"^ *[A-Za-z_]*(Sensor|Pedal|Buffer|Latch|Signal) = "


def changed_extents(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines of all diffs, by the symbol of the last snapshot around them: the smallest extent in a file of that
    name, and the lines no symbol holds."""
    from ripplemark.operators.changes import innermost

    tail = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    p = X.parse_diff(B.lines(spark, d)).where("side = 'new'").select(F.col("file").alias("doc"), tail("path").alias("file"), F.col("line").cast("int").alias("line")).distinct()
    stem = F.regexp_replace(tail("file"), r"_[0-9]+(\.[a-z]+)$", "$1")
    x = B.last_two(spark, d)[1].select(stem.alias("file"), "usr", "start_line", "end_line")
    return innermost(p, x).groupBy("doc", "usr").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        trigger_sources, pattern_lock_coupling, pattern_conditional_write, pattern_class_member, pattern_guarded_callee, registered_flags, data_paths, data_reach, data_breaks,
        pattern_setter_readers, pattern_changed_default, pattern_new_enum_value, log_only, changed_extents,
    )
}

_Q = lambda rx: "'" + rx.replace("'", "''") + "'"
_ST = rf"""{L}, lh as (select *, max(case when regexp_matches(text, {_Q(HEAD)}) then no end) over (partition by file order by no rows unbounded preceding) fn from l),
st as (select s.file || ':' || s.fn usr, regexp_extract(h.text, {_Q(HEAD)}, 1) cls, regexp_extract(h.text, {_Q(HEAD)}, 2) short, s.file, s.no, case when regexp_matches(s.text, {_Q(ASSIGN)}) then 'assign' when regexp_matches(s.text, {_Q(GUARD)}) then 'guard' when regexp_matches(s.text, {_Q(LOCK)}) then 'lock' end kind,
  regexp_replace(case when regexp_matches(s.text, {_Q(ASSIGN)}) then regexp_extract(s.text, {_Q(ASSIGN)}, 1) when regexp_matches(s.text, {_Q(GUARD)}) then regexp_extract(s.text, {_Q(GUARD)}, 1) else regexp_extract(s.text, {_Q(LOCK)}, 1) end, {_Q(NOUN)}, '\1\2') as name,
  nullif(regexp_extract(s.text, {_Q(ASSIGN)}, 2), '') callee, regexp_replace(nullif(regexp_extract(s.text, {_Q(ASSIGN)}, 3), ''), {_Q(NOUN)}, '\1\2') source
  from lh s join l h on h.file = s.file and h.no = s.fn where regexp_matches(s.text, {_Q(ASSIGN)}) or regexp_matches(s.text, {_Q(GUARD)}) or regexp_matches(s.text, {_Q(LOCK)})),
cf as (select distinct usr from st where short in (select spelling from symbol)),
us as (select *, case when regexp_matches(nm, '^m_|_$') then cls else '' end sc from (select usr, cls, no, name as nm, 'write' how from st where kind = 'assign' union all select usr, cls, no, source, 'read' from st where kind = 'assign' union all select usr, cls, no, name, 'read' from st where kind = 'guard'))"""
_PRE = f"with {VERSIONS}, {H}, {_ST}"


def _others(wanted: str, used: str, most: int) -> str:
    """The first names of `wanted` (usr, nm, sc, no) and who else uses them."""
    return f"""w0 as (select usr, nm, sc, min(no) as no from ({wanted}) group by 1, 2, 3), w1 as (select *, row_number() over (partition by usr order by no, nm) i from w0),
      o1 as (select w1.usr, w1.nm, o.usr other, row_number() over (partition by w1.usr, w1.nm order by o.usr) k from w1 join (select distinct nm, sc, usr from ({used})) o on o.nm = w1.nm and o.sc = w1.sc and o.usr <> w1.usr where i <= 2)
      select usr, nm as name, other from o1 where k <= {most}"""


_SHARED = "regexp_matches(nm, '^(m_|g_|s_)|_$')"
_TRIGGER = """ca as (select usr, file, callee, min(no) as no from st where kind = 'assign' group by 1, 2, 3), gu as (select usr, name as id, no as g from st where kind = 'guard'),
bf as (select distinct callee, ca.usr, id from ca join gu on gu.usr = ca.usr where g < no), cv as (select * from bf where usr in (select usr from cf)),
pr as (select distinct callee, usr from bf where (callee, id) in (select callee, id from cv)),
sr as (select ca.callee, ca.usr, file, (ca.callee, ca.usr) in (select callee, usr from cv) covered, case when (ca.callee, ca.usr) in (select callee, usr from pr) then 'present' else 'absent' end guard from ca where callee in (select callee from cv)),
ts as (select *, row_number() over (partition by callee order by (not covered)::int, (guard <> 'absent')::int, file, usr) place, count(*) over (partition by callee) sources from sr)"""
_FLOW = f"""a as (select *, usr || '|' || name t, usr || '|' || source s from st where kind = 'assign'), fs as (select distinct usr, short from st),
sh as (select usr, 'store|' || case when regexp_matches(name, '^m_|_$') then cls else '' end || '|' || name c, t node from a where regexp_matches(name, '^(m_|g_|s_)|_$')),
ex as (select node, c from sh union select s, 'arg|' || callee from a union select usr || '|return', 'result|' || short from fs),
en as (select 'store|' || case when regexp_matches(source, '^m_|_$') then cls else '' end || '|' || source c, s node from a where regexp_matches(source, '^(m_|g_|s_)|_$') union select 'arg|' || short, usr || '|n' from fs union select 'result|' || callee, t from a),
st0 as (select distinct usr root, t node from a where usr in (select usr from cf)),
wk(root, node, depth) as (select root, node, 0 from st0 union select root, x.dst, depth + x.w from wk join (select s src, t dst, 0 w from a union select ex.node, en.node, 1 from ex join en on en.c = ex.c) x on x.src = wk.node where depth + x.w <= {DEPTH}),
re as (select root, node, min(depth) depth from wk group by 1, 2)"""
_REC = _PRE.replace("with ", "with recursive ", 1)
_WORDS = "list_transform(regexp_extract_all(callee, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda q: lower(q))"
_PAIRS = ", ".join(f"('{s}', '{g}')" for s, gs in VERBS.items() for g in gs)
_NAMES = "regexp_matches(nm, '^[A-Za-z_]\\w{3,}$')"
_KEYS = "(" + ", ".join(f"'{k}'" for k in KEYWORDS) + ")"

ORACLE = {
    "trigger_sources": f"{_PRE}, {_TRIGGER} select callee, usr, covered, guard, cast(place as integer) place, sources from ts where place <= 8",
    "pattern_lock_coupling": f"{_PRE}, {_others(f'''select * from us where {_SHARED} and usr in (select usr from cf) and usr in (select usr from st where kind = 'lock')''', 'select * from us', 2)}",
    "pattern_conditional_write": f"{_PRE}, cn as (select usr, min(no) a from st where kind = 'guard' and usr in (select usr from cf) group by 1), {_others(f'''select us.* from us join cn on cn.usr = us.usr where how = 'write' and no > a and {_SHARED}''', '''select * from us where how = 'read' ''', 4)}",
    "pattern_class_member": f"{_PRE}, {_others('''select * from us where how = 'write' and regexp_matches(nm, '^m_|_$') and usr in (select usr from cf)''', '''select * from us where how = 'read' ''', 2)}",
    "pattern_guarded_callee": f"""{_PRE}, cn as (select usr, min(no) a from st where kind = 'guard' and usr in (select usr from cf) group by 1), c as (select st.usr, callee, min(no) as no from st join cn on cn.usr = st.usr where kind = 'assign' and no > a group by 1, 2),
      k as (select *, row_number() over (partition by usr order by no, callee) i from c) select usr, callee from k where i <= 3""",
    "registered_flags": f"""{_PRE}, {_TRIGGER}, sc as (select file || ':' || no u from l where regexp_matches(text, '^static auto [A-Za-z]+::')) select callee root, 'dynamic_runtime_dependency' category, 'callback ' || count(distinct usr) detail from ts where place <= 8 and usr in (select u from sc) group by 1""",
    "data_paths": f"{_REC}, {_FLOW} select root, usr, callee, cast(min(depth) as integer) depth from re join a on a.s = re.node where depth > 0 and root <> usr and (regexp_matches(callee, '^(encode|route|flush|commit|stage)') or not list_has_any({_WORDS}, ['log', 'logger', 'trace', 'debug', 'print', 'printf', 'dump', 'assert']) and list_has_any({_WORDS}, ['send', 'write', 'publish', 'post', 'notify', 'emit', 'transmit', 'enqueue', 'serialize', 'deliver', 'output', 'upload', 'broadcast', 'reply', 'respond'])) group by 1, 2, 3",
    "data_reach": f"{_REC}, {_FLOW} select root, cast(depth as integer) depth, count(*) vals from re group by 1, 2",
    "data_breaks": f"""{_REC}, {_FLOW}, bx as (select distinct root, ex.c, case when ex.c in (select c from en) then 'depth limit' else 'no one takes it' end why, depth from re join ex on ex.node = re.node),
      bk as (select distinct root, why || ': ' || c p from bx where (why = 'depth limit' and depth = {DEPTH}) or (why <> 'depth limit' and depth < {DEPTH})), g as (select root, list(p order by p) ps from bk group by 1)
      select root, 'dynamic_runtime_dependency' category, array_to_string(ps[1:5], '; ') || case when len(ps) > 5 then ' and ' || (len(ps) - 5) || ' more' else '' end detail from g""",
    "pattern_setter_readers": f"""with {_DIFF}, {_ST.split(', lh as')[1].join(['lh as', '']).split('cf as')[0].rstrip().rstrip(',')}, dc as (select distinct file || '#' || path root, side, regexp_extract(text, {_Q(ASSIGN)}, 2) callee from df where regexp_matches(text, {_Q(ASSIGN)})),
      rm as (select root, callee from dc where side = 'old' and (root, callee) not in (select root, callee from dc where side = 'new')), vb(v, g) as (values {_PAIRS}),
      wn as (select root, callee setter, g || regexp_extract(callee, '^[a-z]+(.+)$', 1) want from rm join vb on v = regexp_extract(callee, '^([a-z]+)[A-Z]', 1)),
      hh as (select distinct root, setter, usr other from wn join st on st.callee = want), k as (select *, row_number() over (partition by root, setter order by other) i from hh) select root, setter, other from k where i <= 4""",
    "pattern_changed_default": f"""with {VERSIONS}, {H}, tk as (select snap_no, usr, unnest(tokens) nm, generate_subscripts(tokens, 1) i, tokens from v where kind not in ('function', 'method')),
      vl as (select snap_no, usr, nm, case when tokens[i + 1] in ('=', '{{') then tokens[i + 2] else tokens[i + 1] end x from tk where {_NAMES} and nm not in ('return', 'case', 'while', 'const', 'auto', 'static', 'true', 'false', 'break', 'nullptr')),
      ag as (select snap_no, usr, nm, list(distinct x order by x) xs from vl where regexp_matches(x, '^(0[xX][0-9a-fA-F]+|[0-9]+(\\.[0-9]+)?)[uUlLfF]*$') group by 1, 2, 3),
      cg as (select distinct b.usr, b.nm from ag a join np on np.s = a.snap_no join ag b on a.usr = b.usr and a.nm = b.nm and b.snap_no = np.nx where a.xs <> b.xs),
      id as (select distinct usr, unnest(tokens) nm from n), k as (select cg.usr, cg.nm, id.usr other, row_number() over (partition by cg.usr, cg.nm order by id.usr) i from cg join id on id.nm = cg.nm and id.usr <> cg.usr) select usr, nm as name, other from k where i <= 4""",
    "pattern_new_enum_value": f"""with {VERSIONS}, {H}, io as (select distinct k usr, unnest(tokens) nm from ha where kind in ('class', 'struct')), jn as (select distinct k usr, unnest(tokens) nm from hb where kind in ('class', 'struct')), fu as (select distinct usr, unnest(tokens) nm from n where kind in ('function', 'method')),
      fo as (select * from io where {_NAMES} and nm not in {_KEYS}), fn as (select * from jn where {_NAMES} and nm not in {_KEYS}), fv as (select * from fu where {_NAMES} and nm not in {_KEYS}),
      ad as (select usr, min(nm) added from fn where (usr, nm) not in (select usr, nm from fo) and usr in (select usr from fo) group by 1),
      wh as (select distinct fn.usr, fv.usr other from fn join fv on fv.nm = fn.nm where (fn.usr, fn.nm) in (select usr, nm from fo)),
      k as (select wh.usr, added, other, row_number() over (partition by wh.usr order by other) i from wh join ad on ad.usr = wh.usr where not exists (select 1 from fv where fv.usr = other and fv.nm = added)) select usr, added, other from k where i <= 8""",
    "log_only": f"""with {_DIFF}, s as (select file, path, regexp_matches(text, {_Q(LOGGING)}) lg, regexp_matches(text, '^\\s*(<<|"[^"]*"\\s*[,;)]*\\s*$|[)}};,]+\\s*$|$)') ct from df) select file, path, cast(count(*) as integer) changed, bool_and(lg or ct) and bool_or(lg or not ct) log_only from s group by 1, 2""",
    "changed_extents": f"""with {_DIFF}, {VERSIONS}, pl as (select distinct file doc, regexp_extract(path, '([^/]+)$', 1) f, cast(line as int) line from df where side = 'new'), xn as (select regexp_replace(regexp_extract(file, '([^/]+)$', 1), '_[0-9]+(\\.[a-z]+)$', '\\1') f, usr, start_line, end_line from n),
      i as (select doc, line, (select x.usr from xn x where x.f = p.f and p.line between x.start_line and x.end_line order by x.end_line - x.start_line, x.usr limit 1) usr from pl p) select doc, usr, count(*) lines, min(line) "first" from i group by 1, 2""",
}
