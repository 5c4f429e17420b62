"""Queries of the detectors, over the token facts of the last two snapshots and the diffs among the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions import text as X
from ripplemark.operators import patterns as P
from ripplemark.operators.changes import changed_symbols
from ripplemark.operators.ranking import first_k
from ripplemark.plans import bindings as B
from ripplemark.plans.bindings import CH, E, H, L, S, V
from ripplemark.plans.text_queries import _DIFF, _PAIRS


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Token facts of the old and the new version of what changed in place, from each snapshot to the next."""
    old, new = B.history(spark, d)
    mod = changed_symbols(old, new).where("change_kind = 'modified'").select("usr")
    return P.token_facts(old.join(mod, "usr", "left_semi")), P.token_facts(new.join(mod, "usr", "left_semi"))


def _all(spark: SparkSession, d: str) -> DataFrame:
    return P.token_facts(B.last_two(spark, d)[1])


def _files(spark: SparkSession, d: str) -> DataFrame:
    return B.last_two(spark, d)[1].select("usr", "file")


def _now(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """(usr, name) of any time, with the file the symbol is in now; what is gone is left out."""
    return rows.select(B.plain().alias("usr"), "name").distinct().join(_files(spark, d), "usr")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return B.edges(spark, d).where("relation = 'call' and dependency is not null and dependent is not null").select(F.col("dependency").alias("callee"), F.col("dependent").alias("caller")).distinct()


def pattern_shared_state(spark: SparkSession, d: str) -> DataFrame:
    old, new = _facts(spark, d)
    return P.readers(_all(spark, d), _now(P.newly(new, old, "write"), spark, d))


def pattern_removed_write(spark: SparkSession, d: str) -> DataFrame:
    old, new = _facts(spark, d)
    return P.readers(_all(spark, d), _now(P.newly(old, new, "write"), spark, d))


def pattern_class_consumer(spark: SparkSession, d: str) -> DataFrame:
    """Readers, in the same file, of names a modified symbol writes."""
    _, new = _facts(spark, d)
    w = first_k(new.where("role = 'write'").groupBy("usr", "file", "name").agg(F.min("at").alias("at")), ["usr"], [F.col("at"), F.col("name")], 2)
    return P.readers(_all(spark, d), _now(w, spark, d), 2, True)


def pattern_config_reader(spark: SparkSession, d: str) -> DataFrame:
    """Readers of at most two longer names a modified symbol newly reads."""
    old, new = _facts(spark, d)
    n = _now(P.newly(new.where("length(name) >= 8"), old, "read", 2), spark, d)
    return P.readers(_all(spark, d), n)


def pattern_return_meaning(spark: SparkSession, d: str) -> DataFrame:
    """Callers, at most 40, of functions that return something they did not."""
    old, new = _facts(spark, d)
    r = P.newly(new, old, "return").groupBy(B.plain().alias("usr")).agg(F.min("name").alias("name"))
    j = r.join(_calls(spark, d), F.col("usr") == F.col("callee")).where("usr <> caller")
    return first_k(j, ["usr"], [F.col("caller")], 40).select("usr", "name", "caller")


def pattern_guard_removed(spark: SparkSession, d: str) -> DataFrame:
    """Names a modified symbol called while it had more conditions than now, at most three."""
    old, new = B.last_two(spark, d)
    ifs = lambda c: F.size(F.filter(c, lambda t: t == "if"))
    o, n = old.select("usr", ifs(F.col("tokens")).alias("a")), new.select("usr", ifs(F.col("tokens")).alias("b"))
    fewer = o.join(n, "usr").where("b < a").select("usr")
    calls = P.token_facts(old.join(fewer, "usr", "left_semi")).where("role in ('call', 'read')").groupBy("usr", "name").agg(F.min("at").alias("at"))
    return first_k(calls, ["usr"], [F.col("at"), F.col("name")], 3).select("usr", "name")


def pattern_new_early_exit(spark: SparkSession, d: str) -> DataFrame:
    """Modified symbols with more returns than before, and how many names they take before the first."""
    old, new = B.last_two(spark, d)
    rets = lambda c: F.size(F.filter(c, lambda t: t == "return"))
    o, n = old.select("usr", F.col("tokens").alias("a")), new.select("usr", F.col("tokens").alias("b"))
    j = o.join(n, "usr").where(rets(F.col("b")) > rets(F.col("a")))
    first = F.array_position("b", F.lit("return"))
    before = F.filter("b", lambda t, i: (i < first - 1) & t.rlike("^(acquire|latch|arm|subscribe|park)[A-Z]"))
    return j.where(first < F.size("b")).select("usr", first.cast("bigint").alias("at"), F.size(F.array_distinct(before)).alias("taken"))


def pattern_symmetric_counterpart(spark: SparkSession, d: str) -> DataFrame:
    s = B.symbols(spark, d).where("kind in ('function', 'method') and spelling is not null and name is not null")
    s = s.select("id", F.regexp_replace("name", "(::)?[^:]*$", "").alias("scope"), "file", "spelling")
    pairs = X.counterparts(s.select("id", F.col("spelling").alias("name"))).select("id", "counterpart")
    c = changed_symbols(*B.last_two(spark, d)).select("usr")
    # every symbol of a changed file counts as touched, as its neighbours were rebuilt with it
    touched = s.join(changed_symbols(*B.last_two(spark, d)).select("file").distinct(), "file", "left_semi").select(F.col("id").alias("usr"))
    return P.counterpart_unchanged(touched, pairs, s).unionByName(P.counterpart_unchanged(c, pairs, s)).distinct()


def pattern_same_code(spark: SparkSession, d: str) -> DataFrame:
    lines = B.lines(spark, d)
    gone = X.parse_diff(lines).where("side = 'old'").select("file", "line", "text")
    kept = lines.select("file", "no", F.regexp_replace("text", "^[-+]", "").alias("text"))
    return P.same_code(gone, kept)


def pattern_sibling_source(spark: SparkSession, d: str) -> DataFrame:
    c = _calls(spark, d).select(F.col("callee").alias("target"), F.col("caller").alias("source"))
    changed = changed_symbols(*B.last_two(spark, d)).select(F.col("usr").alias("source"))
    return P.sibling_sources(c, c.join(changed, "source", "left_semi").select("target", "source"))


def accessor_callers(spark: SparkSession, d: str) -> DataFrame:
    """Users of one-return functions, through those that merely pass on."""
    v = B.last_two(spark, d)[1]
    acc = v.where(F.size("tokens").between(1, 12) & F.array_contains("tokens", "return")).select(F.col("usr").alias("id"))
    return P.accessor_callers(_calls(spark, d), acc)


def definition_site(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of what a header declares; here a declaration's own stem stands for the header's."""
    s = B.symbols(spark, d).where("name is not null")
    decls = s.select(F.col("id").alias("usr"), "name", F.regexp_replace("file", r"\.(c|cc|cpp|cxx)$", ".h").alias("file"))
    return P.definition_sites(decls, s)


def external_signals(spark: SparkSession, d: str) -> DataFrame:
    """Calls from code into the base library by what the callee's name tells about failure and ownership."""
    s = B.symbols(spark, d).where("name like 'base::%'").select(F.col("id").alias("callee"), X.name_words(F.col("name")).alias("w"))
    sign = F.when(F.arrays_overlap("w", F.lit(["acquire", "latch", "subscribe", "adopt"])), "must be given back").when(F.arrays_overlap("w", F.lit(["publish", "notify", "encode", "flush"])), "may fail").otherwise("none")
    own = s.select(F.col("callee").alias("caller"))
    return _calls(spark, d).join(s, "callee").join(own, "caller", "left_anti").groupBy(sign.alias("signal")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("callee").alias("callees"))


QUERIES = {
    f.__name__: f
    for f in (
        pattern_shared_state, pattern_removed_write, pattern_class_consumer, pattern_config_reader, pattern_return_meaning, pattern_guard_removed, pattern_new_early_exit, pattern_symmetric_counterpart,
        pattern_same_code, pattern_sibling_source, accessor_callers, definition_site, external_signals,
    )
}

_NOISE = ", ".join(f"'{w}'" for w in X.NOISE)


def _role(src: str) -> str:
    return f"""(select usr, file, ps, name, case when nx = '=' then 'write' when nx = '(' then 'call' when pv = 'return' then 'return' else 'read' end "role"
  from (select usr, file, tokens[k] as name, k - 1 ps, tokens[k + 1] nx, case when k > 1 then tokens[k - 1] end pv from (select usr, file, tokens, unnest(range(1, len(tokens) + 1)) k from {src}))
  where regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') and name not in ({_NOISE}))"""


_TF = f"""{V}, {H}, mo as (select ha.k from ha join hb on ha.k = hb.k where ha.tokens <> hb.tokens or ha.decl_tokens <> hb.decl_tokens), fo as {_role('(select k usr, file, tokens from ha where k in (select k from mo))')}, fn as {_role('(select k usr, file, tokens from hb where k in (select k from mo))')}, fa as {_role('n')},
rd as (select distinct name, usr reader, file r_file from fa where "role" not in ('write', 'call'))"""


_PLAIN = "regexp_replace(usr, '^[0-9]+@', '')"


def _new(a: str, b: str, role: str, most: int, where: str = "true") -> str:
    return f"""(select distinct {_PLAIN} usr, name from (select usr, name, row_number() over (partition by usr order by min(ps), name) k from {a} x where "role" = '{role}' and {where}
      and not exists (select 1 from {b} y where y.usr = x.usr and y.name = x.name and y."role" = '{role}') group by usr, name) where k <= {most})"""


_DIRS = "case when w.file = r_file then 0 when regexp_extract(w.file, '^(.*)/[^/]*$', 1) = regexp_extract(r_file, '^(.*)/[^/]*$', 1) then 1 else 2 end"


def _read(w: str, most: int = P.READERS, same: str = "true") -> str:
    return f"""select usr, name, reader from (select w.usr, w.name, reader, row_number() over (partition by w.usr, w.name order by {_DIRS}, reader) k
      from (select q.usr, q.name, n.file from {w} q join n on n.usr = q.usr) w join rd on rd.name = w.name where w.usr <> reader and {same}) where k <= {most}"""


_CALLS = "c as (select distinct dependency callee, dependent caller from e where relation = 'call' and dependency is not null and dependent is not null)"

ORACLE = {
    "pattern_shared_state": f"with {_TF} {_read(_new('fn', 'fo', 'write', P.NAMES))}",
    "pattern_removed_write": f"with {_TF} {_read(_new('fo', 'fn', 'write', P.NAMES))}",
    "pattern_class_consumer": f"""with {_TF} {_read('(select distinct ' + _PLAIN + ' usr, name from (select usr, name, row_number() over (partition by usr order by min(ps), name) k from fn where "role" = ' + "'write'" + ' group by usr, name) where k <= 2)', 2, 'w.file = r_file')}""",
    "pattern_config_reader": f"with {_TF} {_read(_new('fn', 'fo', 'read', 2, 'length(name) >= 8'))}",
    "pattern_return_meaning": f"""with {E}, {_TF}, {_CALLS}, r as (select usr, min(name) as name from {_new('fn', 'fo', 'return', P.NAMES)} group by usr)
      select usr, name, caller from (select r.*, caller, row_number() over (partition by usr order by caller) k from r join c on callee = usr where usr <> caller) where k <= 40""",
    "pattern_guard_removed": f"""with {V}, fw as (select o.usr from o join n on o.usr = n.usr where len(list_filter(n.tokens, lambda t: t = 'if')) < len(list_filter(o.tokens, lambda t: t = 'if'))), f as {_role('o where usr in (select usr from fw)')}
      select usr, name from (select usr, name, row_number() over (partition by usr order by min(ps), name) k from f where "role" in ('call', 'read') group by usr, name) where k <= 3""",
    "pattern_new_early_exit": f"""with {V}, j as (select o.usr, o.tokens a, n.tokens b from o join n on o.usr = n.usr where len(list_filter(n.tokens, lambda t: t = 'return')) > len(list_filter(o.tokens, lambda t: t = 'return')))
      select usr, cast(list_position(b, 'return') as bigint) "at", cast(len(list_distinct(list_filter(b[1:list_position(b, 'return') - 1], lambda t: regexp_matches(t, '^(acquire|latch|arm|subscribe|park)[A-Z]')))) as integer) taken from j where list_position(b, 'return') < len(b)""",
    "pattern_symmetric_counterpart": f"""with {S}, {V}, {CH}, {_PAIRS}, f as (select id, regexp_replace(name, '(::)?[^:]*$', '') scope, file, spelling, regexp_extract_all(spelling, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|_') parts from s where kind in ('function', 'method') and spelling is not null and name is not null),
      e as (select *, unnest(parts) part, generate_subscripts(parts, 1) k from f),
      cp as (select distinct id, array_to_string(list_concat(list_append(parts[1:k - 1], case when regexp_matches(part, '^[A-Z]') then upper(other[1]) || other[2:] else other end), parts[k + 1:]), '') counterpart from e join pr on word = lower(part)),
      t1 as (select id usr from f where file in (select file from ch)), t2 as (select usr from ch),
      g as (select 1 t, t1.usr, a.scope, a.file, cp.counterpart from t1 join f a on a.id = t1.usr join cp on cp.id = t1.usr union all select 2, t2.usr, a.scope, a.file, cp.counterpart from t2 join f a on a.id = t2.usr join cp on cp.id = t2.usr),
      h as (select g.t, g.usr, b.id other, row_number() over (partition by g.t, g.usr order by (g.scope <> b.scope)::int, b.id) k from g join f b on b.spelling = g.counterpart and (b.scope = g.scope or b.file = g.file)
        where (g.t = 1 and b.id not in (select usr from t1)) or (g.t = 2 and b.id not in (select usr from t2))) select distinct usr, other from h where k = 1""",
    "pattern_same_code": f"""with {_DIFF}, r as (select file, trim(text, ' ' || chr(9) || chr(13)) code, row_number() over (partition by file order by line, trim(text, ' ' || chr(9) || chr(13))) k from df where side = 'old' and length(regexp_replace(text, '[ \t\r]', '', 'g')) >= 25 and regexp_matches(text, '[(=<>]')),
      a as (select file o_file, no o_no, regexp_replace(text, '^[-+]', '') tx from l), b as (select o_file, o_no, trim(tx, ' ' || chr(9) || chr(13)) code from a where length(regexp_replace(tx, '[ \t\r]', '', 'g')) >= 25 and regexp_matches(tx, '[(=<>]')),
      j as (select r.file, r.code, o_file, o_no, row_number() over (partition by r.file, r.code order by o_file, o_no) k from (select distinct file, code from r where k <= 3) r join b on b.code = r.code where r.file <> o_file) select file, code, o_file, o_no from j where k = 1""",
    "pattern_sibling_source": f"""with {E}, {V}, {CH}, {_CALLS}, cv as (select * from c where caller in (select usr from ch)), r as (select callee target, caller source, count(*) over (partition by callee) n, row_number() over (partition by callee order by caller) k
        from c where callee in (select callee from cv) and caller not in (select usr from ch))
      select target, source, null::bigint others from r where n <= 12 and k <= 8 union all select target, null, case when n > 12 then n else n - 8 end from r where k = 1 and n > 8""",
    "accessor_callers": f"""with {E}, {V}, {_CALLS}, ac as (select usr from n where len(tokens) between 1 and 12 and list_contains(tokens, 'return')),
      s1 as (select distinct usr start, caller from ac join c on callee = usr), f1 as (select * from s1 where caller in (select usr from ac) and caller <> start),
      s2 as (select distinct start, c.caller from f1 join c on callee = f1.caller), f2 as (select * from s2 where caller in (select usr from ac) and caller <> start and not exists (select 1 from f1 where f1.start = s2.start and f1.caller = s2.caller)),
      s3 as (select distinct start, c.caller from f2 join c on callee = f2.caller), u as (select start, caller from (select * from s1 union select * from s2 union select * from s3) where caller not in (select usr from ac)),
      k as (select *, row_number() over (partition by start order by caller) k from u) select start, caller from k where k <= 4""",
    "definition_site": f"""with {S}, d as (select id usr, name, regexp_replace(file, '\\.(c|cc|cpp|cxx)$', '.h') file from s where name is not null), x as (select usr, name, regexp_extract(file, '([^/]+)\\.[a-z]+$', 1) stem from d where regexp_matches(file, '\\.(h|hh|hpp|hxx)$')),
      y as (select name, regexp_extract(file, '([^/]+)\\.[a-z]+$', 1) stem, file, line from s where name is not null and regexp_matches(file, '\\.(c|cc|cpp|cxx)$') and coalesce(is_def, false)),
      z as (select usr, file, line, row_number() over (partition by usr order by line, file) k from x join y on y.name = x.name and y.stem = x.stem) select usr, file, line from z where k = 1""",
    "external_signals": f"""with {E}, {S}, {_CALLS}, b as (select id, list_transform(regexp_extract_all(string_split(name, '::')[-1], '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda q: lower(q)) w from s where name like 'base::%')
      select case when list_has_any(w, ['acquire', 'latch', 'subscribe', 'adopt']) then 'must be given back' when list_has_any(w, ['publish', 'notify', 'encode', 'flush']) then 'may fail' else 'none' end signal, count(*) calls, count(distinct callee) callees
      from c join b on b.id = callee where caller not in (select id from b) group by 1""",
}
