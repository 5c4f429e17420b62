"""The engine's fact tables, bound to the tables of a data folder, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.ids import clean_id
from ripplemark.sources import tables as T


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Each dep edge once."""
    return T.dep_edges(spark, d).select("ord", "dependency", "dependent", "relation", "file", "line").distinct()


def provider(spark: SparkSession, d: str) -> DataFrame:
    return T.provider_edges(spark, d).select("edge_id", "run_id", "dependency", "dependent", "relation", "file", "line").distinct()


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return T.symbols(spark, d)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """One row a usr and snapshot: the latest loaded one. Null token lists are empty."""
    empty = F.expr("cast(array() as array<string>)")
    rows = T.table(spark, d, "symbol_version").withColumn("usr", clean_id("usr")).where("usr is not null")
    cols = [c for c in rows.columns if c not in ("snap_no", "usr", "loaded_at")]
    one = rows.groupBy("snap_no", "usr").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", F.xxhash64(*cols))).alias("s")).select("snap_no", "usr", "s.*")
    for c in ("tokens", "decl_tokens", "bases"):
        one = one.withColumn(c, F.coalesce(c, empty))
    return one


def last_two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Versions of the last snapshot but one and of the last."""
    v = versions(spark, d)
    nos = [r[0] for r in T.table(spark, d, "symbol_version").select("snap_no").where("snap_no is not null").distinct().orderBy(F.desc("snap_no")).limit(2).collect()]
    new, old = (nos + [-1, -1])[:2]
    return v.where(F.col("snap_no") == old), v.where(F.col("snap_no") == new)


def history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Versions before and after, for each snapshot and the next: usr has the later snapshot in front, as in 3@usr."""
    v = versions(spark, d)
    nos = [r[0] for r in T.table(spark, d, "symbol_version").select("snap_no").where("snap_no is not null").distinct().orderBy("snap_no").collect()]  # one row a delivery
    pairs = F.broadcast(spark.createDataFrame(list(zip(nos, nos[1:])), "a int, b int"))
    side = lambda c: v.join(pairs, F.col("snap_no") == F.col(c)).withColumn("usr", F.concat_ws("@", "b", "usr")).drop("a", "b")
    return side("a"), side("b")


def plain(usr: str = "usr") -> F.Column:
    """The id without the snapshot in front."""
    return F.regexp_replace(usr, "^[0-9]+@", "")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(file, no, text): every line of every document; no from 1."""
    docs = T.table(spark, d, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("no"), "text")


# --- the same in SQL: with-clauses to put before a query

E = "e as (select distinct ord, nullif(trim(dependency), '') dependency, nullif(trim(dependent), '') dependent, lower(trim(relation)) relation, file, line from dep)"
PE = "pe as (select distinct edge_id, run_id, nullif(trim(dependency), '') dependency, nullif(trim(dependent), '') dependent, lower(trim(relation)) relation, file, line from provider_edge)"
S = """s as (select * from (select *, row_number() over (partition by id order by first_seen desc nulls last, file desc nulls last, line desc nulls last, name desc nulls last) rn from (
  select trim(id) id, name, spelling, kind, file, line, end_line, first_seen, is_def, is_virtual, parent, display from symbol
  union all select trim(id), name, spelling, kind, file, line, end_line, first_seen, null, null, null, null from core_symbol)) where rn = 1)"""
V = """v as (select snap_no, usr, any_value(x).name as name, any_value(x).kind kind, any_value(x).file file, any_value(x).start_line start_line, any_value(x).end_line end_line,
  coalesce(any_value(x).tokens, []) tokens, coalesce(any_value(x).decl_tokens, []) decl_tokens, coalesce(any_value(x).bases, []) bases, any_value(x).is_virtual is_virtual, any_value(x).noexcept_spec noexcept_spec
  from (select snap_no, trim(usr) usr, arg_max(symbol_version, loaded_at) x from symbol_version where trim(usr) <> '' group by 1, 2) group by 1, 2),
o as (select * from v where snap_no = (select max(snap_no) - 1 from v)), n as (select * from v where snap_no = (select max(snap_no) from v))"""
CH = """ch as (select coalesce(o.usr, n.usr) usr, coalesce(n.file, o.file) file, coalesce(n.kind, o.kind) kind,
  case when o.usr is null then 'added' when n.usr is null then 'removed' else 'modified' end change_kind,
  coalesce(n.end_line - n.start_line + 1, o.end_line - o.start_line + 1) lines, coalesce(n.name, o.name) as name
  from o full join n on o.usr = n.usr where o.usr is null or n.usr is null or o.tokens <> n.tokens or o.decl_tokens <> n.decl_tokens)"""
#: H: ha and hb are the versions before and after, by the same id k; hc the ids and names that changed at any time.
H = """np as (select s, lead(s) over (order by s) nx from (select distinct snap_no s from v)),
ha as (select nx || '@' || usr k, v.* from v join np on s = snap_no where nx is not null), hb as (select snap_no || '@' || usr k, v.* from v where snap_no in (select nx from np)),
hc as (select coalesce(ha.usr, hb.usr) usr, coalesce(hb.name, ha.name) as name, ha.k is not null and hb.k is not null modified from ha full join hb on ha.k = hb.k where ha.k is null or hb.k is null or ha.tokens <> hb.tokens or ha.decl_tokens <> hb.decl_tokens)"""
L = "l as (select doc_id file, generate_subscripts(string_split(text, chr(10)), 1) as no, unnest(string_split(text, chr(10))) as text from documents where text is not null)"
