"""What a change may have broken elsewhere: detectors over one table of token facts of two versions.

A detector is a join of what changed with who reads, calls or resembles it, cut to the first few by nearness. All work on
the same facts: per symbol version the names it writes, reads, calls and returns, with their place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.text import IDENT, NOISE
from ripplemark.operators.ranking import first_k

#: Names a root may add, readers a name may have, cases of one detector a root may give.
NAMES, READERS, A_ROOT = 3, 4, 8
#: Sources beyond this many are one summary.
MANY, SHOWN = 12, 8


def token_facts(versions: DataFrame) -> DataFrame:
    """(usr, file, at, name, role) of every identifier: written before '=', called before '(', returned after 'return',
    else read. A returned name is read as well. versions: usr, file, tokens."""
    t = versions.select("usr", "file", "tokens", F.posexplode("tokens").alias("at", "name"))
    nxt, prev = F.get("tokens", F.col("at") + 1), F.when(F.col("at") > 0, F.get("tokens", F.col("at") - 1))
    role = F.when(nxt == "=", "write").when(nxt == "(", "call").when(prev == "return", "return").otherwise("read")
    ident = F.col("name").rlike(f"^{IDENT}$") & ~F.col("name").isin(*NOISE)
    return t.where(ident).select("usr", "file", "at", "name", role.alias("role"))


def newly(new: DataFrame, old: DataFrame, role: str, most: int = NAMES) -> DataFrame:
    """(usr, name): names a symbol has in a role in `new` and had not in `old`, the first `most` by place. Swapped, what it
    has no longer."""
    n = new.where(F.col("role") == role).groupBy("usr", "name").agg(F.min("at").alias("at"))
    o = old.where(F.col("role") == role).select("usr", "name").distinct()
    return first_k(n.join(o, ["usr", "name"], "left_anti"), ["usr"], [F.col("at"), F.col("name")], most).select("usr", "name")


def _folder(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def readers(facts: DataFrame, wanted: DataFrame, most: int = READERS, same_file: bool = False) -> DataFrame:
    """(usr, name, reader): who reads a name some symbol's change is about, the nearest first: same file, same folder.

    Symbols that only write the name are no readers, nor is the changed one. wanted: usr, file, name. The readers of a
    name are cut to the first of each file, folder and of all before they meet those who ask, one more than asked for as
    one may be the asker: a name that everyone reads stays small, and none of the nearest is lost."""
    r = facts.where("role <> 'write' and role <> 'call'").select("name", F.col("usr").alias("reader"), "file", _folder(F.col("file")).alias("folder")).distinct()
    w = wanted.select("usr", "name", "file", _folder(F.col("file")).alias("folder")).distinct()
    parts = []
    for far, by in enumerate((["name", "file"], ["name", "folder"], ["name"])):
        few = first_k(r.select(*by, "reader").distinct(), by, [F.col("reader")], most + 1)
        parts.append(w.join(few, by).where("usr <> reader").select("usr", "name", "reader", F.lit(far).alias("far")))
        if same_file:
            break
    near = reduce(DataFrame.unionByName, parts).groupBy("usr", "name", "reader").agg(F.min("far").alias("far"))
    return first_k(near, ["usr", "name"], [F.col("far"), F.col("reader")], most).select("usr", "name", "reader")


def counterpart_unchanged(changed: DataFrame, pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(usr, other): for a changed function the one whose name undoes it and that did not change: in the same scope
    before the same file. pairs: id, counterpart; symbols: id, scope, file, spelling."""
    s = symbols.select(F.col("id").alias("other"), F.col("scope").alias("o_scope"), F.col("file").alias("o_file"), F.col("spelling").alias("counterpart"))
    c = changed.join(pairs.withColumnRenamed("id", "usr"), "usr").join(symbols.select(F.col("id").alias("usr"), "scope", F.col("file").alias("s_file")), "usr")
    j = c.join(s, "counterpart").where((F.col("scope") == F.col("o_scope")) | (F.col("s_file") == F.col("o_file"))).join(changed.select(F.col("usr").alias("other")), "other", "left_anti")
    return first_k(j, ["usr"], [(F.col("scope") != F.col("o_scope")).cast("int"), F.col("other")], 1).select("usr", "other")


def same_code(removed: DataFrame, lines: DataFrame, shortest: int = 25, most: int = NAMES) -> DataFrame:
    """(file, text, o_file, o_no): where a removed line still stands in another text, the first place each.

    Only lines of some length with a call or a comparison; at most `most` a file. removed: file, line, text."""
    code = F.btrim("text", F.lit(" \t\r"))
    tell = (F.length(F.regexp_replace("text", "[ \t\r]", "")) >= shortest) & F.col("text").rlike("[(=<>]")
    r = first_k(removed.where(tell).select("file", "line", code.alias("code")), ["file"], [F.col("line"), F.col("code")], most)
    at = lines.where(tell).select(F.col("file").alias("o_file"), F.col("no").alias("o_no"), code.alias("code"))
    j = r.select("file", "code").distinct().join(at, "code").where("file <> o_file")
    return first_k(j, ["file", "code"], [F.col("o_file"), F.col("o_no")], 1).select("file", "code", "o_file", "o_no")


def sibling_sources(sources: DataFrame, covered: DataFrame) -> DataFrame:
    """(target, source, others): other callers of a function some changed caller now guards: the first SHOWN, and a row
    without source that counts the rest; beyond MANY only that row. sources: target, source; covered: target, source."""
    rest = sources.distinct().join(covered.select("target").distinct(), "target", "left_semi").join(covered.distinct(), ["target", "source"], "left_anti")
    n = F.count(F.lit(1)).over(Window.partitionBy("target"))
    k = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    r = rest.withColumn("n", n).withColumn("k", k)
    shown = r.where((F.col("n") <= MANY) & (F.col("k") <= SHOWN)).select("target", "source", F.lit(None).cast("bigint").alias("others"))
    over = r.where("k = 1").where(F.col("n") > SHOWN).select("target", F.lit(None).cast("string").alias("source"), F.when(F.col("n") > MANY, F.col("n")).otherwise(F.col("n") - SHOWN).alias("others"))
    return shown.unionByName(over)


def accessor_callers(calls: DataFrame, accessors: DataFrame, levels: int = 3, most: int = 4) -> DataFrame:
    """(start, caller): who really uses an accessor: its callers, where those that merely forward are replaced by theirs,
    up to `levels` times; the first `most`. calls: callee, caller; accessors: id, which are also the forwarders."""
    fw = accessors.select(F.col("id").alias("caller")).distinct()
    front, out = accessors.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct(), None
    seen = front
    for _ in range(levels):
        step = front.join(calls, F.col("node") == F.col("callee")).select("start", "caller").distinct()
        real = step.join(fw, "caller", "left_anti")
        out = real if out is None else out.unionByName(real)
        nxt = step.join(fw, "caller", "left_semi").select("start", F.col("caller").alias("node"))
        front = nxt.join(seen, ["start", "node"], "left_anti")
        seen = seen.unionByName(front)
    return first_k(out.distinct(), ["start"], [F.col("caller")], most).select("start", "caller")


def definition_sites(decls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(usr, file, line): for what a header declares, its definition in the source of the same stem: the first line."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[a-z]+$", 1)
    header, source = r"\.(h|hh|hpp|hxx)$", r"\.(c|cc|cpp|cxx)$"
    d = decls.where(F.col("file").rlike(header)).select("usr", "name", stem(F.col("file")).alias("stem"))
    s = symbols.where(F.col("file").rlike(source) & F.coalesce("is_def", F.lit(False))).select("name", stem(F.col("file")).alias("stem"), "file", "line")
    return d.join(s, ["name", "stem"]).groupBy("usr").agg(F.min(F.struct("line", "file")).alias("m")).select("usr", "m.file", "m.line")
