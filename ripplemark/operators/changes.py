"""From two versions of the facts to changed symbols: full joins by id, interval joins of lines and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(usr, file, kind, name, change_kind, lines, same_shape) of symbols whose tokens or declaration differ.

    A full outer join by usr; rows on both sides with equal lists are dropped null-safely. lines is the length of the
    new extent, or of the old one of a removed symbol; same_shape tells that bases and declaration are as before."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.usr") == F.col("n.usr"), "full")
    same = F.col("o.tokens").eqNullSafe(F.col("n.tokens")) & F.col("o.decl_tokens").eqNullSafe(F.col("n.decl_tokens"))
    both = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    span = lambda s: F.col(f"{s}.end_line") - F.col(f"{s}.start_line") + 1
    return j.where(F.col("o.usr").isNull() | F.col("n.usr").isNull() | ~same).select(
        both("usr").alias("usr"),
        both("file").alias("file"),
        both("kind").alias("kind"),
        both("name").alias("name"),
        F.when(F.col("o.usr").isNull(), "added").when(F.col("n.usr").isNull(), "removed").otherwise("modified").alias("change_kind"),
        F.coalesce(span("n"), span("o")).alias("lines"),
        (F.col("o.bases").eqNullSafe(F.col("n.bases")) & F.col("o.decl_tokens").eqNullSafe(F.col("n.decl_tokens"))).alias("same_shape"),
    )


def innermost(points: DataFrame, extents: DataFrame, spread: int = 64) -> DataFrame:
    """The smallest extent around each point: (point columns, usr); usr is null where there is none.

    points: file, line and others; extents: file, usr, start_line, end_line. Extents are cut into cells of `spread`
    lines, so the join is on (file, cell) and a file with very many of either does not meet itself as a whole. Equal
    spans: the smallest usr."""
    cell = lambda c: F.floor(c / F.lit(spread)).cast("int")
    e = extents.where("start_line <= end_line").select(
        F.col("file"), "usr", "start_line", "end_line", F.explode(F.sequence(cell(F.col("start_line")), cell(F.col("end_line")))).alias("_cell")
    )
    p = points.withColumn("_cell", cell(F.col("line")))
    keys = points.columns
    j = p.alias("p").join(e.alias("e"), (F.col("p.file") == F.col("e.file")) & (F.col("p._cell") == F.col("e._cell")) & F.col("p.line").between(F.col("e.start_line"), F.col("e.end_line")), "left")
    return j.groupBy(*[F.col(f"p.{k}").alias(k) for k in keys]).agg(F.min(F.when(F.col("e.usr").isNotNull(), F.struct((F.col("e.end_line") - F.col("e.start_line")).alias("span"), F.col("e.usr").alias("usr")))).alias("m")).select(*keys, F.col("m.usr").alias("usr"))


def residual(points: DataFrame, extents: DataFrame, spread: int = 64) -> DataFrame:
    """Points that no extent covers: an anti join by interval, on (file, cell)."""
    cell = lambda c: F.floor(c / F.lit(spread)).cast("int")
    e = extents.where("start_line <= end_line").select(
        F.col("file").alias("e_file"), "start_line", "end_line", F.explode(F.sequence(cell(F.col("start_line")), cell(F.col("end_line")))).alias("e_cell")
    )
    return points.join(e, (F.col("file") == F.col("e_file")) & (cell(F.col("line")) == F.col("e_cell")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")


def qualify_names(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Full names for short ones: the symbol of that spelling in the file, where there is exactly one name."""
    s = symbols.groupBy("file", "spelling").agg(F.countDistinct("name").alias("k"), F.min("name").alias("full_name")).where("k = 1").drop("k")
    return found.join(s, ["file", "spelling"], "left").withColumn("full_name", F.coalesce("full_name", "spelling"))


def merge_facts(facts: DataFrame, key: str, first: list[str], declared_in: str) -> DataFrame:
    """One row a key out of many units: a definition before a declaration, then the order of `first`; the files of the
    others are kept as decl_files."""
    cols = [c for c in facts.columns if c != key]
    order = [F.when(F.coalesce(F.col("is_def"), F.lit(False)), 0).otherwise(1).alias("d"), *[F.col(c) for c in first]]
    g = facts.groupBy(key).agg(F.min(F.struct(*order, *[F.col(c).alias(f"c_{c}") for c in cols])).alias("m"), F.array_sort(F.collect_set(declared_in)).alias("files"))
    chosen = F.col(f"m.c_{declared_in}")
    return g.select(key, *[F.col(f"m.c_{c}").alias(c) for c in cols], F.filter("files", lambda f: ~f.eqNullSafe(chosen)).alias("decl_files"))


def _numbered(x: Column) -> Column:
    """The elements sorted, each with how many equal ones stand before it, so that bags become sets."""
    s = F.array_sort(x)
    return F.transform(s, lambda t, i: F.struct(t.alias("t"), (i - F.array_position(s, t)).alias("k")))


def bag_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) elements of two arrays as bags, sorted: what remains of one when the other's are taken out."""
    a, b = _numbered(old), _numbered(new)
    rest = lambda x, y: F.array_sort(F.transform(F.array_except(x, y), lambda s: s["t"]))
    return rest(b, a), rest(a, b)


def changed_tokens(old: Column, new: Column) -> Column:
    """The elements that one list has more often than the other; a null list is an empty one."""
    empty = F.expr("cast(array() as array<string>)")
    added, removed = bag_delta(F.coalesce(old, empty), F.coalesce(new, empty))
    return F.array_union(added, removed)


def fix_counts(commits: DataFrame, until: Column, days: int = 360, subject: str = r"(?i)\b(fix(e[sd])?|bug|regression|crash)\b") -> DataFrame:
    """(file, fixes): commits of the window of `days` that ends at `until` whose subject looks like a fix."""
    hit = (F.col("at") > until - F.make_dt_interval(F.lit(days))) & (F.col("at") <= until) & F.col("subject").rlike(subject)
    return commits.where(hit).groupBy("file").agg(F.countDistinct("commit").alias("fixes"))


def szz_vote(blamed: DataFrame) -> DataFrame:
    """(fix, intro, votes): the commit that most changed lines of a fix are blamed on; ties go to the smallest."""
    n = blamed.groupBy("fix", "intro").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("fix").orderBy(F.desc("votes"), "intro")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
