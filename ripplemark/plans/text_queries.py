"""Queries over source text: documents' lines and code listings, and names of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions import text as X
from ripplemark.operators import flow, rules
from ripplemark.operators.results import Lesson, match_lessons
from ripplemark.plans import bindings as B
from ripplemark.plans.bindings import E, L, S, V
from ripplemark.plans.case_queries import _HISTORY
from ripplemark.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    t = X.strip_comments(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, "\n")).alias("digest"))


def name_words(spark: SparkSession, d: str) -> DataFrame:
    s = B.symbols(spark, d).where("name is not null")
    return s.select(F.explode(X.name_words(F.col("name"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are equal once normalised, in more than one document."""
    n = B.lines(spark, d).select("file", X.normal_line(F.col("text")).alias("line")).where(F.length("line") >= 25)
    return n.groupBy("line").agg(F.countDistinct("file").alias("docs")).where("docs > 1").select(F.md5("line").alias("digest"), "docs")


def boundary_values(spark: SparkSession, d: str) -> DataFrame:
    return X.boundaries(B.lines(spark, d))


def counterparts(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose counterpart by name exists, and where."""
    s = B.symbols(spark, d).where("kind in ('function', 'method')").select("id", F.col("spelling").alias("name"))
    c = X.counterparts(s.where("name is not null"))
    return c.join(s.select(F.col("name").alias("counterpart"), F.col("id").alias("other")), "counterpart").groupBy("id", "counterpart").agg(F.min("other").alias("other"))


def guard_ids(spark: SparkSession, d: str) -> DataFrame:
    return X.guard_names(B.lines(spark, d)).select("file", "no", F.array_join("names", " ").alias("names"))


def token_search(spark: SparkSession, d: str) -> DataFrame:
    w = B.symbols(spark, d).where("length(spelling) >= 6").select(F.col("spelling").alias("token"))
    return X.search(B.lines(spark, d), w)


def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    return X.parse_diff(B.lines(spark, d))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.statements(B.lines(spark, d), r"^ *std::lock_guard<").select("file", "no")


def code_window(spark: SparkSession, d: str) -> DataFrame:
    lines = B.lines(spark, d)
    return X.window_end(lines, lines.where(F.col("text").rlike(r"^[a-z ]+[A-Za-z]+::[A-Za-z_]+\([^)]*\) \{")).select("file", F.col("no").alias("start")))


def negate_condition(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of code lines with the one that holds when they do not."""
    rx = r"\bif \(([A-Za-z_][A-Za-z0-9_]*) (<=|>=|==|!=|<|>) ([A-Za-z0-9_]+)\)"
    g = lambda i: F.regexp_extract("text", rx, i)
    x = B.lines(spark, d).where(F.col("text").rlike(rx)).select(g(1).alias("a"), g(2).alias("op"), g(3).alias("b"))
    return x.select(F.concat_ws(" ", "a", "op", "b").alias("condition"), F.concat_ws(" ", "a", X.negated(F.col("op")), "b").alias("otherwise")).distinct()


def lock_order(spark: SparkSession, d: str) -> DataFrame:
    """Versions of one file, in diffs, that take the same locks in another order; else listings by their lock lists."""
    seq = F.regexp_extract_all("text", F.lit(r"lock_guard<[^>]*> [a-z]+\(([A-Za-z_]+)\)"), F.lit(1))
    x = _docs(spark, d).select("doc_id", seq.alias("seq")).where("size(seq) > 1")
    k = x.groupBy(F.array_join(F.array_sort("seq"), " ").alias("locks")).agg(F.countDistinct(F.array_join("seq", " ")).alias("orders"), F.count(F.lit(1)).alias("docs"))
    return k


def evidence_resolves(spark: SparkSession, d: str) -> DataFrame:
    """Places of edges by whether the file is known and long enough."""
    n = B.symbols(spark, d).where("file is not null").groupBy("file").agg(F.max(F.coalesce("end_line", "line")).alias("length"))
    p = B.edges(spark, d).where("file is not null and line is not null").select("ord", "file", "line").join(n, "file", "left")
    ok = F.coalesce((F.col("line") >= 1) & (F.col("line") <= F.col("length")), F.lit(False))
    return p.groupBy(ok.alias("resolves"), F.col("length").isNotNull().alias("file_known")).agg(F.count(F.lit(1)).alias("places"))


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first string member of the first JSON object embedded in a text."""
    rx = r'\{"([a-z]+)": "([^"]*)"\}'
    return _docs(spark, d).where(F.col("text").rlike(rx)).select("doc_id", F.regexp_extract("text", rx, 1).alias("name"), F.length(F.regexp_extract("text", rx, 2)).alias("n"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text holds one JSON object from its first brace to its last."""
    r = table(spark, d, "report_raw").where("body is not null").select("record_id", F.regexp_extract("body", r"(?s)(\{.*\})", 1).alias("js")).distinct()
    # within brackets, so that nothing may follow the object
    v = F.try_parse_json(F.concat(F.lit("["), "js", F.lit("]")))
    return r.select("record_id", F.coalesce((F.col("js") != "") & (F.size(F.try_variant_get(v, "$", "array<variant>")) == 1), F.lit(False)).alias("ok"))


def is_standard(spark: SparkSession, d: str) -> DataFrame:
    s = B.symbols(spark, d).select("id", F.coalesce(F.regexp_replace("name", "^base::", "std::"), F.lit("")).alias("name"), "file")
    return s.groupBy(X.is_standard(F.col("name"), F.col("file")).alias("standard")).agg(F.count(F.lit(1)).alias("symbols"))


def test_path_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files by whether their name is a test's, with the watchdog files renamed to be some."""
    p = F.regexp_replace("file", r"/watchdog_", "/test_")
    return B.symbols(spark, d).where("file is not null").select(p.alias("path")).distinct().where(X.test_path(F.col("path")))


def norm_kind(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind").isin("method", "function"), "callable").when(F.col("kind").isin("class", "struct"), "type").otherwise(F.col("kind"))
    name = F.regexp_replace("name", r"(::)?lambda$", "")
    return B.symbols(spark, d).groupBy(kind.alias("kind"), (name != F.col("name")).alias("anonymous")).agg(F.count(F.lit(1)).alias("symbols"))


def emitters(spark: SparkSession, d: str) -> DataFrame:
    """Calls by whether the callee gives data away; the base library is foreign."""
    s = B.symbols(spark, d).where("name is not null").select(F.col("id").alias("dependency"), flow.is_emitter(F.col("name"), F.col("name").startswith("base::") & F.col("name").contains("publish"), ["*::route*"]).alias("emits"))
    c = B.edges(spark, d).where("relation = 'call'").join(s, "dependency")
    return c.groupBy("emits").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("dependency").alias("callees"))


LESSONS = [
    Lesson("queues", name_glob="*Queue::*", path_glob="src/*"),
    Lesson("guards", name_glob="*Guard*", path_glob="*.h"),
    Lesson("loops", tokens_any=("while", "for"), path_glob="src/*"),
    Lesson("renamed", name_glob="rebind*", sub_reason="signature_change"),
    Lesson("signatures", sub_reason="signature_change", path_glob="*.h*"),
]


def lessons(spark: SparkSession, d: str) -> DataFrame:
    """Risks of changed symbols that lessons apply to."""
    c = rules.changes_of(*B.history(spark, d))
    words = F.array_distinct(F.concat(F.coalesce("old_tokens", F.array()), F.coalesce("new_tokens", F.array())))
    rows = rules.risk_rows(c).join(c.select("root", "name", "file", words.alias("tokens")), "root").where("name is not null and file is not null")
    return match_lessons(rows, LESSONS).select("root", "risk_group", "sub_reason", "lesson")


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Hints of all contracts whose pattern matches a callee's full or short name."""
    known = [("publish*", "retries"), ("*::acquire*", "must be released"), ("acquire*", "may block"), ("base::*", "foreign")]
    co = spark.createDataFrame([(X.glob_regex(n), h) for n, h in known], "rx string, hint string")
    s = B.symbols(spark, d).where("name is not null").select("id", "name", F.element_at(F.split("name", "::"), -1).alias("short"))
    return s.join(F.broadcast(co), F.expr("name rlike rx or short rlike rx")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("hint")), "; ").alias("hints"))


def build_configs(spark: SparkSession, d: str) -> DataFrame:
    """Release or debug build of each folder, by whether it expands a batch macro."""
    e = B.edges(spark, d).where("relation = 'macro_expand' and file is not null")
    release = F.max((F.col("dependency").contains("BATCH")).cast("int"))
    return e.groupBy(F.regexp_extract("file", r"^([^/]+/[^/]+)/", 1).alias("folder")).agg(release.alias("r")).select("folder", F.when(F.col("r") == 1, "Release").otherwise("Debug").alias("config"))


QUERIES = {
    f.__name__: f
    for f in (
        strip_comments, tokenize, name_words, normalize_lines, boundary_values, counterparts, guard_ids, token_search, diff_parse, log_lines, code_window, negate_condition, lock_order,
        evidence_resolves, html_extract, json_extract, is_standard, test_path_filter, norm_kind, emitters, lessons, contracts, build_configs,
    )
}


def _sql(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


_DIFF = rf"""{L}, x as (select file, no, regexp_replace(text, '\r$', '') t from l),
x1 as (select *, regexp_matches(t, '^@@ -[0-9]+(,[0-9]+)? \+[0-9]+(,[0-9]+)? @@') head, regexp_matches(t, '^(---|\+\+\+) (a/|b/|/dev/null)') nm from x),
x2 as (select *, not head and not nm and regexp_matches(t, '^[-+ ]') body, case when head then cast(regexp_extract(t, '^@@ -([0-9]+)', 1) as int) end a, case when head then cast(regexp_extract(t, '\+([0-9]+)', 1) as int) end b,
  case when starts_with(t, '--- a/') then t[7:] when starts_with(t, '--- /dev/null') then '' end op, case when starts_with(t, '+++ b/') then t[7:] when starts_with(t, '+++ /dev/null') then '' end np from x1),
y as (select file, no, t, body, head, last_value(a ignore nulls) over w a, last_value(b ignore nulls) over w b, last_value(op ignore nulls) over w op, last_value(np ignore nulls) over w np,
  sum(head::int) over w hunk, sum((not body and not head)::int) over w breaks from x2 window w as (partition by file order by no rows unbounded preceding)),
z as (select *, breaks > first_value(breaks) over h broken, a + sum((body and t[1] in (' ', '-'))::int) over h - 1 o, b + sum((body and t[1] in (' ', '+'))::int) over h - 1 n from y where hunk > 0
  window h as (partition by file, hunk order by no rows unbounded preceding)),
df as (select file, nullif(case when t[1] = '-' then op else np end, '') path, case when t[1] = '-' then 'old' else 'new' end side, cast(case when t[1] = '-' then o else n end as bigint) line, t[2:] as text
  from z where body and not broken and t[1] in ('-', '+') and nullif(case when t[1] = '-' then op else np end, '') is not null)"""
_NAME_WORD = "'[A-Z]?[a-z]+|[A-Z]+|[0-9]+'"
_IDS = "array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*')), lambda q: length(q) > 1 and not list_contains([" + ", ".join(f"'{w}'" for w in X.NOISE) + "], q))), ' ')"
_PAIRS = "pr(word, other) as (select distinct * from (values " + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in X.PAIRS) + ") q(word, other))"

ORACLE = {
    "strip_comments": f"select doc_id, length(regexp_replace(text, {_sql(X.COMMENT)}, '', 'g')) n, md5(regexp_replace(text, {_sql(X.COMMENT)}, '', 'g')) digest from documents where text is not null",
    "tokenize": f"select doc_id, cast(len(regexp_extract_all(text, {_sql(X.TOKEN)})) as integer) n, md5(array_to_string(regexp_extract_all(text, {_sql(X.TOKEN)}), chr(10))) digest from documents where text is not null",
    "name_words": f"with {S} select word, count(*) n from (select lower(unnest(regexp_extract_all(string_split(name, '::')[-1], {_NAME_WORD}))) word from s where name is not null) group by word",
    "normalize_lines": f"""with {L}, x as (select file, substr(trim(regexp_replace(regexp_replace(text, {_sql(X.COMMENT)}, '', 'g'), '{X.WS}+', ' ', 'g'), ' '), 1, 400) line from l)
      select md5(line) digest, count(distinct file) docs from x where length(line) >= 25 group by line having count(distinct file) > 1""",
    "boundary_values": f"""with {L}, z as (select file, no, unnest(regexp_extract_all(text, {_sql(X.COMPARISON)}, 1)) var, unnest(regexp_extract_all(text, {_sql(X.COMPARISON)}, 2)) op, unnest(regexp_extract_all(text, {_sql(X.COMPARISON)}, 3)) lit from l)
      select distinct file, no, var, op, try_cast(lit as bigint) "value", try_cast(lit as bigint) - 1 below, try_cast(lit as bigint) + 1 above from z where try_cast(lit as bigint) is not null""",
    "counterparts": f"""with {S}, {_PAIRS}, f as (select id, spelling as name, regexp_extract_all(spelling, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|_') parts from s where kind in ('function', 'method') and spelling is not null),
      e as (select *, unnest(parts) part, generate_subscripts(parts, 1) k from f),
      c as (select distinct id, name, array_to_string(list_concat(list_append(parts[1:k - 1], case when regexp_matches(part, '^[A-Z]') then upper(other[1]) || other[2:] else other end), parts[k + 1:]), '') counterpart from e join pr on word = lower(part))
      select c.id, counterpart, min(f.id) other from c join f on f.name = counterpart group by 1, 2""",
    "guard_ids": f"""with {L}, c as (select file, no, regexp_replace(text, {_sql(X.COMMENT)}, '', 'g') code from l) select file, no, {_IDS.format('code')} "names" from c where regexp_matches(code, {_sql(X.CONDITION)})""",
    "token_search": f"""with {L}, {S}, w as (select distinct spelling token from s where length(spelling) >= 6), t as (select file, no, unnest(list_distinct(regexp_extract_all(text, '{X.IDENT}'))) token from l),
      x as (select t.*, row_number() over (partition by token order by file, no) k from t where token in (select token from w)) select token, file, no from x where k <= 5""",
    "diff_parse": f"with {_DIFF} select * from df",
    "log_lines": f"""with {L}, x as (select file, no, max(case when regexp_matches(text, '^ *std::lock_guard<') then no end) over (partition by file order by no rows unbounded preceding) b,
      max(case when contains(text, ';') then no end) over (partition by file order by no rows between unbounded preceding and 1 preceding) e from l) select file, no from x where b is not null and (e is null or e < b)""",
    "code_window": f"""with {L}, st as (select file, no start from l where regexp_matches(text, '^[a-z ]+[A-Za-z]+::[A-Za-z_]+\\([^)]*\\) \\{{')),
      j as (select st.file, start, no, sum(length(regexp_replace(text, '[^{{]', '', 'g')) - length(regexp_replace(text, '[^}}]', '', 'g'))) over w sm, max(contains(text, '{{')::int) over w seen
        from st join l on l.file = st.file and no between start and start + 39 window w as (partition by st.file, start order by no rows unbounded preceding))
      select file, start, coalesce(min(case when seen = 1 and sm <= 0 then no end), max(no)) "end" from j group by 1, 2""",
    "negate_condition": rf"""with {L}, x as (select regexp_extract(text, '\bif \(([A-Za-z_][A-Za-z0-9_]*) (<=|>=|==|!=|<|>) ([A-Za-z0-9_]+)\)', ['a', 'op', 'b']) m from l where regexp_matches(text, '\bif \(([A-Za-z_][A-Za-z0-9_]*) (<=|>=|==|!=|<|>) ([A-Za-z0-9_]+)\)'))
      select distinct m.a || ' ' || m.op || ' ' || m.b "condition", m.a || ' ' || case m.op when '<' then '>=' when '<=' then '>' when '>' then '<=' when '>=' then '<' when '==' then '!=' else '==' end || ' ' || m.b "otherwise" from x""",
    "lock_order": r"""with x as (select doc_id, regexp_extract_all(text, 'lock_guard<[^>]*> [a-z]+\(([A-Za-z_]+)\)', 1) q from documents where text is not null)
      select array_to_string(list_sort(q), ' ') locks, count(distinct array_to_string(q, ' ')) orders, count(*) docs from x where len(q) > 1 group by 1""",
    "evidence_resolves": f"""with {E}, {S}, n as (select file, max(coalesce(end_line, line)) len from s where file is not null group by file)
      select coalesce(e.line >= 1 and e.line <= len, false) resolves, len is not null file_known, count(*) places from e left join n on n.file = e.file where e.file is not null and e.line is not null group by 1, 2""",
    "html_extract": r"""select doc_id, regexp_extract(text, '\{"([a-z]+)": "([^"]*)"\}', 1) as name, cast(length(regexp_extract(text, '\{"([a-z]+)": "([^"]*)"\}', 2)) as integer) n from documents where regexp_matches(text, '\{"([a-z]+)": "([^"]*)"\}')""",
    "json_extract": r"""select record_id, js <> '' and json_valid(js) ok from (select distinct record_id, regexp_extract(body, '(?s)(\{.*\})', 1) js from report_raw where body is not null)""",
    "is_standard": f"""with {S}, x as (select regexp_replace(coalesce(name, ''), '^base::', 'std::') as name, file from s) select starts_with(name, 'std::') or starts_with(name, '__') or coalesce(contains(file, '/bits/'), false) standard, count(*) symbols from x group by 1""",
    "test_path_filter": f"""with {S}, x as (select distinct regexp_replace(file, '/watchdog_', '/test_', 'g') path from s where file is not null) select path from x
      where regexp_matches(path, '(^|/)([Tt]ests?|[Uu]nit_?[Tt]ests?|gtest|testing)(/|$)|(^|/)[Tt]est_[^/]*$|_(unit)?tests?\\.[^/]+$|[a-z0-9]Tests?\\.[^/]+$')""",
    "norm_kind": f"""with {S} select case when kind in ('method', 'function') then 'callable' when kind in ('class', 'struct') then 'type' else kind end kind, regexp_replace(name, '(::)?lambda$', '') <> name anonymous, count(*) symbols from s group by 1, 2""",
    "emitters": f"""with {E}, {S}, w as (select id, name, list_transform(regexp_extract_all(string_split(name, '::')[-1], {_NAME_WORD}), lambda q: lower(q)) w from s where name is not null),
      em as (select id, name glob '*::route*' or string_split(name, '::')[-1] glob '*::route*' or (not starts_with(name, 'std::') and not starts_with(name, '__') and not list_has_any(w, ['log','logger','trace','debug','print','printf','dump','assert'])
        and ((starts_with(name, 'base::') and contains(name, 'publish')) or list_has_any(w, ['send','write','publish','post','notify','emit','transmit','enqueue','serialize','deliver','output','upload','broadcast','reply','respond']))) emits from w)
      select emits, count(*) calls, count(distinct dependency) callees from e join em on em.id = e.dependency where relation = 'call' group by 1""",
    "lessons": f"""with {V}, {_HISTORY}, y as (select k.*, coalesce(n.name, o.name) as name, coalesce(n.file, o.file) file, list_concat(coalesce(o.tokens, []), coalesce(n.tokens, [])) tk from k join dl on dl.root = k.root),
      z as (select *, string_split(name, '::')[-1] sh from y where name is not null and file is not null)
      select root, risk_group, sub_reason, 'queues' lesson from z where (name glob '*Queue::*' or sh glob '*Queue::*') and file glob 'src/*' union all select root, risk_group, sub_reason, 'guards' from z where (name glob '*Guard*' or sh glob '*Guard*') and file glob '*.h'
      union all select root, risk_group, sub_reason, 'loops' from z where list_has_any(tk, ['while', 'for']) and file glob 'src/*' union all select root, risk_group, sub_reason, 'renamed' from z where (name glob 'rebind*' or sh glob 'rebind*') and sub_reason = 'signature_change'
      union all select root, risk_group, sub_reason, 'signatures' from z where sub_reason = 'signature_change' and file glob '*.h*'""",
    "contracts": f"""with {S}, co(g, hint) as (values ('publish*', 'retries'), ('*::acquire*', 'must be released'), ('acquire*', 'may block'), ('base::*', 'foreign'))
      select id, string_agg(distinct hint, '; ' order by hint) hints from s join co on s.name glob g or string_split(s.name, '::')[-1] glob g group by id""",
    "build_configs": f"with {E} select regexp_extract(file, '^([^/]+/[^/]+)/', 1) folder, case when bool_or(contains(dependency, 'BATCH')) then 'Release' else 'Debug' end config from e where relation = 'macro_expand' and file is not null group by 1",
}
