"""Detectors over statements of functions: what a change under a lock, a condition or a guard means for other functions.

Statements: usr (the function), cls (its class), file, no, kind (assign, guard, lock), name (target, variable or lock),
callee and source (of an assignment from a call). A member (`member` matches its name) is looked for in functions of the
same class only, any other name everywhere; joins go by (name, place) so that a name no class shares stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.operators.ranking import first_k
from ripplemark.runtime import Staged

MEMBER = "^m_|_$"
SHARED = "^(m_|g_|s_)|_$"
#: Names a function gives, and readers a name gives.
NAMES, READERS, COUPLED = 2, 4, 2
SHOWN, MANY = 8, 12


def place(name: Column, cls: Column, member: str = MEMBER) -> Column:
    """Where a name is known: within its class, or everywhere ('')."""
    return F.when(name.rlike(member), F.coalesce(cls, F.lit("?"))).otherwise(F.lit(""))


def uses(statements: DataFrame, member: str = MEMBER) -> DataFrame:
    """(usr, name, scope, how): what functions read (an argument or a condition) and write."""
    s = statements
    both = F.array(
        F.when(F.col("kind") == "assign", F.struct(F.col("name").alias("name"), F.lit("write").alias("how"))),
        F.when(F.col("kind") == "assign", F.struct(F.col("source").alias("name"), F.lit("read").alias("how"))),
        F.when(F.col("kind") == "guard", F.struct(F.col("name").alias("name"), F.lit("read").alias("how"))),
    )
    e = s.select("usr", "cls", "no", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("u")).select("usr", "cls", "no", "u.*")
    return e.where(F.col("name").isNotNull()).select("usr", "no", "name", place(F.col("name"), F.col("cls"), member).alias("scope"), "how")


def _others(wanted: DataFrame, used: DataFrame, most: int) -> DataFrame:
    """(usr, name, other): other functions that use a name, the first `most`. wanted: usr, name, scope; used: as of uses."""
    o = used.select("name", "scope", F.col("usr").alias("other")).distinct()
    return first_k(wanted.join(o, ["name", "scope"]).where("usr <> other"), ["usr", "name"], [F.col("other")], most).select("usr", "name", "other")


def _first_names(rows: DataFrame, most: int = NAMES) -> DataFrame:
    one = rows.groupBy("usr", "name", "scope").agg(F.min("no").alias("no"))
    return first_k(one, ["usr"], [F.col("no"), F.col("name")], most).select("usr", "name", "scope")


def lock_coupling(statements: DataFrame, changed: DataFrame) -> DataFrame:
    """(usr, name, other): shared names that a changed function uses with a lock, and who else touches them, writers too.
    changed: usr."""
    locked = statements.where("kind = 'lock'").select("usr").distinct().join(changed.select("usr").distinct(), "usr", "left_semi")
    u = uses(statements)
    mine = u.where(F.col("name").rlike(SHARED)).join(locked, "usr", "left_semi")
    return _others(_first_names(mine), u, COUPLED)


def conditional_write(statements: DataFrame, conditions: DataFrame) -> DataFrame:
    """(usr, name, other): shared names written behind a changed condition, and who reads them. conditions: usr, no: a
    condition that leaves the function, so that all that follows is in its scope."""
    u = uses(statements)
    c = conditions.groupBy("usr").agg(F.min("no").alias("at"))
    w = u.where("how = 'write'").where(F.col("name").rlike(SHARED)).join(c, "usr").where("no > at")
    return _others(_first_names(w), u.where("how = 'read'"), READERS)


def class_consumer(statements: DataFrame, changed: DataFrame) -> DataFrame:
    """(usr, name, other): members a changed function writes, and the first functions of its class that read them."""
    u = uses(statements)
    w = u.where("how = 'write'").where(F.col("name").rlike(MEMBER)).join(changed.select("usr").distinct(), "usr", "left_semi")
    return _others(_first_names(w), u.where("how = 'read'"), COUPLED)


def guard_removed_callee(statements: DataFrame, guards: DataFrame, most: int = 3) -> DataFrame:
    """(usr, callee): what is called behind a guard that was taken away or weakened, the first few. guards: usr, no."""
    g = guards.groupBy("usr").agg(F.min("no").alias("at"))
    c = statements.where("kind = 'assign'").join(g, "usr").where("no > at").groupBy("usr", "callee").agg(F.min("no").alias("no"))
    return first_k(c, ["usr"], [F.col("no"), F.col("callee")], most).select("usr", "callee")


def trigger_sources(statements: DataFrame, changed: DataFrame, shown: int = SHOWN, many: int = MANY) -> DataFrame:
    """(callee, usr, covered, guard, place, sources): for functions that a changed one calls behind a condition, who calls
    them: those covered by the change first, then those without such a condition before their call, by file and name;
    the first `shown`, and how many there are. guard: present if a condition on one of the same names stands before the
    call, else absent; callers the change covers count as present."""
    calls = statements.where("kind = 'assign'").groupBy("usr", "file", "callee").agg(F.min("no").alias("no"))
    guards = statements.where("kind = 'guard'").select("usr", F.col("name").alias("id"), F.col("no").alias("g_no"))
    before = calls.join(guards, "usr").where("g_no < no").select("callee", "usr", "id").distinct()
    covered = before.join(changed.select("usr").distinct(), "usr", "left_semi")
    ids = covered.select("callee", "id").distinct()
    present = before.join(ids, ["callee", "id"], "left_semi").select("callee", "usr", F.lit(True).alias("p")).distinct()
    mine = covered.select("callee", "usr", F.lit(True).alias("c")).distinct()
    src = calls.join(ids.select("callee").distinct(), "callee", "left_semi").join(present, ["callee", "usr"], "left").join(mine, ["callee", "usr"], "left")
    rows = src.select("callee", "usr", "file", F.coalesce("c", F.lit(False)).alias("covered"), F.when(F.col("c") | F.col("p"), "present").otherwise("absent").alias("guard"))
    order = [F.when(F.col("covered"), 0).otherwise(1), F.when(F.col("guard") == "absent", 0).otherwise(1), F.col("file"), F.col("usr")]
    n = rows.groupBy("callee").agg(F.count(F.lit(1)).alias("sources"))
    k = rows.withColumn("place", F.row_number().over(Window.partitionBy("callee").orderBy(*order))).where(F.col("place") <= shown)
    return k.join(n, "callee").select("callee", "usr", "covered", "guard", "place", "sources")


def setter_readers(removed: DataFrame, calls: DataFrame, verbs: dict[str, list[str]] | None = None, most: int = READERS) -> DataFrame:
    """(root, setter, other): who calls a getter of what a removed call set. A getter is the setter's name with one of the
    getting verbs, or none, in place of the setting one, in its case style; with an owner, of the same class.

    removed: root, callee, owner (may be null); calls: usr, callee, owner."""
    verbs = verbs or {v: ["get", "is", ""] for v in ("set", "update", "increment", "inc", "mark")}
    spark = removed.sparkSession
    pairs = spark.createDataFrame([(s, g) for s, gs in verbs.items() for g in gs], "verb string, getter string")
    split = removed.select("root", "callee", "owner", F.lower(F.regexp_extract("callee", r"^([A-Z]?[a-z]+)(?:_|(?=[A-Z]))", 1)).alias("verb"), F.regexp_extract("callee", r"^[A-Z]?[a-z]+_?(.+)$", 1).alias("base"), F.col("callee").rlike("^[A-Z]").alias("upper"), F.col("callee").contains("_").alias("snake"))
    j = split.where("verb <> '' and base <> ''").join(F.broadcast(pairs), "verb")
    lead = F.when(F.col("upper"), F.initcap("getter")).otherwise(F.col("getter"))
    bare = F.when(F.col("upper"), F.col("base")).otherwise(F.concat(F.lower(F.substring("base", 1, 1)), F.expr("substring(base, 2)")))
    name = F.when(F.col("getter") == "", bare).when(F.col("snake"), F.concat_ws("_", lead, "base")).otherwise(F.concat(lead, F.col("base")))
    want = j.select("root", F.col("callee").alias("setter"), F.col("owner").alias("s_owner"), name.alias("callee")).distinct()
    c = calls.select("callee", F.col("owner").alias("c_owner"), F.col("usr").alias("other")).distinct()
    hit = want.join(c, "callee").where("other <> root and (s_owner is null or c_owner is null or s_owner = c_owner)")
    return first_k(hit.select("root", "setter", "other").distinct(), ["root", "setter"], [F.col("other")], most)


def _defaults(versions: DataFrame) -> DataFrame:
    """(usr, name, value): a number that stands behind a name, or behind its '='."""
    t = versions.where("kind not in ('function', 'method')").select("usr", "tokens", F.posexplode("tokens").alias("at", "name"))
    nxt, after = F.get("tokens", F.col("at") + 1), F.get("tokens", F.col("at") + 2)
    value = F.when(nxt.isin("=", "{"), after).otherwise(nxt)
    return t.select("usr", "name", value.alias("value")).where(F.col("name").rlike(r"^[A-Za-z_]\w{3,}$") & F.col("value").rlike(r"^(0[xX][0-9a-fA-F]+|[0-9]+(\.[0-9]+)?)[uUlLfF]*$") & ~F.col("name").isin("return", "case", "while", "const", "auto", "static", "true", "false", "break", "nullptr"))


def changed_defaults(old: DataFrame, new: DataFrame) -> DataFrame:
    """(usr, name): names of types and constants that had one value before and have another. old, new: usr, kind, tokens."""
    a, b = (_defaults(v).groupBy("usr", "name").agg(F.array_sort(F.collect_set("value")).alias(c)) for v, c in ((old, "a"), (new, "b")))
    return a.join(b, ["usr", "name"]).where("a <> b").select("usr", "name")


def readers_of(wanted: DataFrame, facts: DataFrame, most: int = READERS) -> DataFrame:
    """(usr, name, other): who holds a name, the first few. wanted: usr, name; facts: usr, name (every identifier of a
    symbol)."""
    r = facts.select("name", F.col("usr").alias("other")).distinct()
    return first_k(wanted.join(r, "name").where("usr <> other"), ["usr", "name"], [F.col("other")], most).select("usr", "name", "other")


def new_enum_value(old: DataFrame, new: DataFrame, users: DataFrame, most: int = SHOWN) -> DataFrame:
    """(usr, added, other): functions that tell known enumerators apart but not a new one. old, new: usr, name (each
    enumerator); users: usr, name (each enumerator a function has a case for)."""
    # names by number within types and users: a name half the code holds is looked at as far as is needed, not whole
    old, new = old.distinct(), new.distinct()
    added = new.join(old, ["usr", "name"], "left_anti").join(old.select("usr").distinct(), "usr", "left_semi")
    first = Staged(added.groupBy("usr").agg(F.min("name").alias("added")), "added").df
    known = Staged(new.join(first, "usr").join(old, ["usr", "name"], "left_semi").select("usr", "name", "added"), "known").df
    asked = known.select("name").unionByName(first.select(F.col("added").alias("name"))).distinct()
    held = users.select("name", F.col("usr").alias("other")).distinct().join(asked, "name", "left_semi")
    held = Staged(held.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("other"))), "held").df
    sizes = held.groupBy("name").agg(F.max("at").alias("n"))
    # the first users of a name that do not hold another one: `most` and one more, as a type may be its own user
    open_ = Staged(known.select("name", "added").distinct().join(sizes, "name").withColumn("have", F.lit(0)), "open").df
    few, lo, hi = None, 0, 4 * most
    while True:
        seen = open_.select("name", "added", "have").join(held.where((F.col("at") > lo) & (F.col("at") <= hi)).select("name", "other"), "name")
        without = seen.join(held.select(F.col("name").alias("added"), "other"), ["added", "other"], "left_anti")
        part = Staged(first_k(without, ["name", "added"], [F.col("other")], most + 1).select("name", "added", "other"), "users").df
        few = part if few is None else few.unionByName(part)
        n = part.groupBy("name", "added").agg(F.count(F.lit(1)).alias("k"))
        left = open_.join(n, ["name", "added"], "left").withColumn("have", F.col("have") + F.coalesce("k", F.lit(0))).drop("k")
        open_ = Staged(left.where((F.col("have") <= most) & (F.col("n") > hi)), "open").df
        if open_.limit(1).count() == 0:
            break
        lo, hi = hi, 4 * hi
    who = known.join(few, ["name", "added"]).where("usr <> other").select("usr", "added", "other").distinct()
    return first_k(who, ["usr"], [F.col("other")], most).select("usr", "added", "other")
