"""Impact graph: who depends on what changed, bounded walks with typed edges, closures, joins of graph facts.

Edges are rows (dependency, dependent, relation, file, line, ord): the dependent is affected when the dependency
changes. Every "first k" follows an explicit order column, never the order rows happen to come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.operators import blocks
from ripplemark.operators.ranking import first_k
from ripplemark.operators.skew import plan_counts, plan_loads, skew_join
from ripplemark.runtime import Staged

#: Relations that are followed from a changed symbol only, not from what it reached.
FIRST_HOP_ONLY = ("contains", "uses_type")
#: A relation whose target is noted but not walked on from.
TERMINAL = "called_by_change"
#: What a class whose fields and bases did not change still passes on.
CLASS_LIMIT = ("inherit_override", "include")
EDGES_A_ROOT, EDGES_A_NODE = 6, 12


def edges_resolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges both of whose ends are known symbols (two semi joins on uneven keys, both planned on the edges as given)."""
    ends = ("dependent", "dependency")
    plans = {e: plan_loads(edges.select(e, "ord"), [e], ["ord"]) for e in ends}
    known = symbols.select("id").distinct()
    for e in ends:
        edges = skew_join(edges, known.select(F.col("id").alias(e)), [e], ["ord"], "left_semi", plan=plans[e])
    return edges


def callers(edges: DataFrame) -> DataFrame:
    """(callee, caller): dependents by a call."""
    return edges.where((F.col("relation") == "call") & F.col("dependency").isNotNull() & F.col("dependent").isNotNull()).select(F.col("dependency").alias("callee"), F.col("dependent").alias("caller")).distinct()


def traverse_limit(kind: Column, same_shape: Column, quiet: Column) -> Column:
    """The relations a root's first step may follow: null for all, an empty array for none.

    quiet: the change touches logging or tests only; same_shape: a class whose fields and bases are as before."""
    return (
        F.when(quiet, F.expr("cast(array() as array<string>)"))
        .when(kind.isin("class", "struct", "union") & same_shape, F.array(*map(F.lit, CLASS_LIMIT)))
        .otherwise(F.lit(None).cast("array<string>"))
    )


def reach(edges: DataFrame, roots: DataFrame, max_hop: int = 2, keep: int | None = None, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Bounded walk from every root at once.

    roots: root, limit (see traverse_limit; the column may be absent). Gives (root, node, hop) with the least hop, the
    roots themselves at hop 0, and (root, node, hop, ord, relation, file, line) of the edges that arrive at a node at its
    least hop: all of them, the first `keep` of each root and node, or none at all (keep = 0). Limits hold for a root's own
    edges; FIRST_HOP_ONLY relations are followed from roots only; a walk never enters another root or its own again; what
    only a TERMINAL edge reached is not walked on from.

    seeds: (root, node) that a root reaches at hop 1 without an edge, see header_seeds.

    A hop joins only edges out of what the last one reached, on bins planned by the rows that come out: the edges of a
    node times the roots that reached it.
    """
    if "limit" not in roots.columns:
        roots = roots.withColumn("limit", F.lit(None).cast("array<string>"))
    roots = Staged(roots.groupBy("root").agg(F.first("limit").alias("limit")), "roots").df
    walkable = edges.where(F.col("dependency").isNotNull() & F.col("dependent").isNotNull()).select("dependency", "dependent", "relation", "file", "line", "ord")
    stops = roots.select(F.col("root").alias("dependent"))
    nodes = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    frontier = roots.select("root", F.col("root").alias("dependency"), "limit")
    found, seen = None, None
    for hop in range(1, max_hop + 1):
        from_ = frontier.groupBy("dependency").agg(F.count(F.lit(1)).alias("_roots"))
        # edges that lead nowhere new are left out before they are multiplied by the roots
        mine = walkable.join(from_.select("dependency"), "dependency", "left_semi").join(stops, "dependent", "left_anti").join(from_, "dependency")
        if hop > 1:
            mine = mine.where(~F.col("relation").isin(*FIRST_HOP_ONLY))
        mine = Staged(mine, "hop").df
        load = mine.groupBy("dependency").agg((F.count(F.lit(1)) * F.max("_roots")).alias("n")).persist()
        try:
            plan = plan_counts(load, ["dependency"])
        finally:
            load.unpersist()
        step = skew_join(mine.drop("_roots"), frontier, ["dependency"], ["ord"], "inner", plan=plan)
        if hop == 1:
            step = step.where(F.col("limit").isNull() | F.array_contains("limit", F.col("relation")))
        if seen is not None:
            step = step.join(seen.select("root", F.col("node").alias("dependent")), ["root", "dependent"], "left_anti")
        is_open = (F.col("relation") != TERMINAL).cast("int")
        step = step.select("root", F.col("dependent").alias("node"), F.lit(hop).alias("hop"), "ord", "relation", "file", "line")
        if keep == 0:
            step = step.groupBy("root", "node").agg(F.max(is_open).alias("open"))
        elif keep:
            w = Window.partitionBy("root", "node")
            step = step.withColumn("open", F.max(is_open).over(w)).withColumn("_k", F.row_number().over(w.orderBy("ord"))).where(F.col("_k") <= keep).drop("_k")
        else:
            step = step.withColumn("open", is_open)
        step = Staged(step, "reach").df
        new = step.groupBy("root", "node").agg(F.max("open").alias("open")) if keep != 0 else step
        if seeds is not None and hop == 1:
            sown = seeds.join(roots.select(F.col("root").alias("node")), "node", "left_anti").select("root", "node", F.lit(1).alias("open"))
            new = Staged(new.select("root", "node", "open").unionByName(sown).groupBy("root", "node").agg(F.max("open").alias("open")), "sown").df
        nodes = nodes.unionByName(new.select("root", "node", F.lit(hop).alias("hop")))
        if keep != 0:
            found = step.drop("open") if found is None else found.unionByName(step.drop("open"))
        seen = new.select("root", "node") if seen is None else seen.unionByName(new.select("root", "node"))
        frontier = new.where("open = 1").select("root", F.col("node").alias("dependency"), F.lit(None).cast("array<string>").alias("limit"))
    return nodes, found


def header_seeds(roots: DataFrame, risks: DataFrame, groups: list[str], header: str) -> DataFrame:
    """(root, node): the file node of each header some root of which has a risk of one of the groups, for the first such
    root by id. roots: root, file; risks: root, risk_group."""
    hot = risks.where(F.col("risk_group").isin(*groups)).select("root").distinct()
    mine = roots.where(F.col("file").rlike(header)).join(hot, "root", "left_semi")
    return mine.groupBy("file").agg(F.min("root").alias("root")).select("root", F.concat(F.lit("file:"), "file").alias("node"))


def reach_edges(found: DataFrame, a_root: int = EDGES_A_ROOT, a_node: int = EDGES_A_NODE) -> DataFrame:
    """The first edges that justify a node: at most a_root for each root, then at most a_node for the node."""
    by_root = Window.partitionBy("root", "node").orderBy("ord")
    by_node = Window.partitionBy("node").orderBy("ord", "root")
    few = found.withColumn("_r", F.row_number().over(by_root)).where(F.col("_r") <= a_root).drop("_r")
    return few.withColumn("_n", F.row_number().over(by_node)).where(F.col("_n") <= a_node).drop("_n")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row a node: least hop and the sorted roots that reach it."""
    return nodes.groupBy("node").agg(F.min("hop").alias("hop"), F.array_sort(F.collect_set("root")).alias("roots"))


def closure(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All (a, b) with a path of one or more links, cycle-safe."""
    links = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    g = blocks.graph(links, ends.select("node", F.col("node").alias("name"), F.lit("").alias("label"), F.lit(False).alias("flag")))
    return blocks.named_pairs(g, (a, b), dict(links.dtypes)["a"])


def override_groups(methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(method, overrides): the methods of one display in the transitive bases of a method's class, and in the classes that
    have it as a base; either is virtual.

    methods: id, parent, display, is_virtual; bases: cls, base."""
    links = bases.select(F.col("cls").alias("a"), F.col("base").alias("b")).where("a is not null and b is not null").distinct()
    m = methods.where(F.col("parent").isNotNull() & F.col("display").isNotNull())
    marks = m.select(F.col("parent").alias("node"), F.col("id").alias("name"), F.col("display").alias("label"), F.coalesce("is_virtual", F.lit(False)).alias("flag")).distinct()
    return blocks.related(blocks.graph(links, marks), ("method", "overrides"))


def choose_definition(refs: DataFrame, symbols: DataFrame, near: int = 3) -> DataFrame:
    """Match each reference (ref, name, file, line) to symbols (id, name, spelling, file, line) of its spelling.

    Tiers: same file within `near` lines (the nearest, then the smallest id, only); the same qualified name; the same
    file; the only one there is. The best tier that has a match stands; the others of that tier stay too. Each tier is an
    equi-join of its own, so that a short name that half the code uses does not meet all its bearers."""
    s = symbols.select("id", F.col("name").alias("s_name"), "spelling", F.col("file").alias("s_file"), F.col("line").alias("s_line"))
    r = refs.select("ref", "name", "file", "line", F.element_at(F.split("name", "::"), -1).alias("spelling"))
    gap = F.abs(F.col("line") - F.col("s_line"))
    here = r.join(s, (r.spelling == s.spelling) & (r.file == s.s_file)).select("ref", "id", F.when(gap <= near, 0).otherwise(2).alias("tier"), gap.alias("gap"))
    named = r.join(s, (r.name == s.s_name) & (r.spelling == s.spelling)).select("ref", "id", F.lit(1).alias("tier"), gap.alias("gap"))
    single = s.groupBy("spelling").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1").drop("k")
    only = r.join(single, "spelling").select("ref", "id", F.lit(3).alias("tier"), F.lit(None).cast("int").alias("gap"))
    t = here.unionByName(named).unionByName(only)
    by = Window.partitionBy("ref")
    best = t.withColumn("least", F.min("tier").over(by)).where("tier = least")
    order = by.orderBy(F.when(F.col("tier") == 0, F.col("gap")).otherwise(0), "id")
    return best.withColumn("rn", F.row_number().over(order)).where("tier > 0 or rn = 1").select("ref", "id", "tier")


def resolve_symbols(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(want, id): symbols of exactly that name, else all whose name ends with ::want; id is null where there is none."""
    s = symbols.select("id", "name")
    exact = wanted.join(s, F.col("want") == F.col("name"), "left_semi").join(s, F.col("want") == F.col("name")).select("want", "id")
    rest = wanted.join(exact.select("want").distinct(), "want", "left_anti")
    # every proper suffix of a name is a key, so the fallback is an equi-join as well
    n = F.split("name", "::")
    tails = s.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(n), F.lit(2))), lambda k: F.concat_ws("::", F.slice(n, k, F.greatest(F.size(n) - k + 1, F.lit(0)))))).alias("want")).where("want <> ''")
    return exact.unionByName(rest.join(tails, "want", "left").select("want", "id"))


def first_names(rows: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """(by, names, more): the first k names of each group, in order, and how many more there are. rows are distinct."""
    few = first_k(rows, [by], [F.col(name)], k).groupBy(by).agg(F.array_sort(F.collect_list(name)).alias("names"))
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return few.join(n, by).select(by, "names", F.greatest(F.col("_n") - k, F.lit(0)).cast("int").alias("more"))


def overlay_unknown(edges: DataFrame, symbols: DataFrame, first: int = 3) -> tuple[DataFrame, DataFrame]:
    """Provider edges kept (first of each (dependent, dependency, relation) by edge_id, both ends known) and, per run,
    flags of unknown ends: the first few ids and how many more."""
    one = edges.where("dependent is not null and dependency is not null").groupBy("dependent", "dependency", "relation").agg(F.min("edge_id").alias("edge_id"))
    one = edges.join(one.select("edge_id"), "edge_id", "left_semi").dropDuplicates(["edge_id"])
    known = symbols.select("id").distinct()
    ends = one.select("run_id", F.explode(F.array("dependent", "dependency")).alias("id")).distinct()
    lost = ends.join(known, "id", "left_anti")
    flags = first_names(lost, "run_id", "id", first).select("run_id", F.concat_ws(", ", "names").alias("first_ids"), "more")
    kept = one
    for end in ("dependent", "dependency"):
        kept = kept.join(known.select(F.col("id").alias(end)), end, "left_semi")
    return kept, flags


def entry_points(calls: DataFrame, starts: DataFrame, depth: int = 3, names: int = 5) -> DataFrame:
    """(start, entries, more): the far ends of the callers' chains: nodes without further callers, and where the bound
    stopped the walk. calls: callee, caller; starts: start."""
    cur = starts.select("start", F.col("start").alias("node")).distinct()
    ends, seen = None, cur
    for d in range(depth):
        nxt = cur.join(calls, F.col("node") == F.col("callee")).select("start", F.col("node").alias("from"), F.col("caller").alias("node"))
        fresh = nxt.join(seen, ["start", "node"], "left_anti")
        over = cur.join(fresh.select("start", F.col("from").alias("node")).distinct(), ["start", "node"], "left_anti")
        ends = over if ends is None else ends.unionByName(over)
        cur = fresh.select("start", "node").distinct()
        seen = seen.unionByName(cur)
    ends = ends.unionByName(cur).where("node <> start").distinct()
    return first_names(ends, "start", "node", names).withColumnRenamed("names", "entries")


def affected_targets(touched: DataFrame, target_deps: DataFrame) -> DataFrame:
    """(target, via): targets that hold what was touched (via null), and all that depend on them, over any distance, with
    the smallest of the touched targets they depend on. touched: target; target_deps: target, needs."""
    direct = touched.select("target").distinct()
    links = target_deps.select(F.col("target").alias("a"), F.col("needs").alias("b")).where("a is not null and b is not null").distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("target")).distinct().join(direct.withColumn("flag", F.lit(True)), "target", "left")
    g = blocks.graph(links, ends.select(F.col("target").alias("node"), F.col("target").alias("name"), F.lit("").alias("label"), F.coalesce("flag", F.lit(False)).alias("flag")))
    return direct.select("target", F.lit(None).cast("string").alias("via")).unionByName(blocks.least(g, ("target", "via")))


def test_gaps(roots: DataFrame, nodes: DataFrame, is_test: Column) -> DataFrame:
    """Roots that no test node reaches. nodes: root, node and whatever is_test reads."""
    return roots.join(nodes.where(is_test).select("root").distinct(), "root", "left_anti")


def downstream_edges(calls: DataFrame, changed_lines: DataFrame, a_root: int = 8) -> DataFrame:
    """Edges root -> callee for calls on changed lines: (root, callee, line), the first a_root callees a root by line.

    calls: caller, callee, file, line; changed_lines: file, line. Calls to oneself do not count."""
    hot = calls.join(changed_lines.select("file", "line").distinct(), ["file", "line"], "left_semi").where("callee <> caller")
    first = hot.groupBy(F.col("caller").alias("root"), "callee").agg(F.min("line").alias("line"))
    w = Window.partitionBy("root").orderBy("line", "callee")
    return first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= a_root).select("root", "callee", "line")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, wanted, found): an include by the tail of a path: the file in the same folder if there is one, else the
    shortest path, then the smallest. includes: file, wanted; files: path."""
    p = F.split("path", "/")
    tails = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.concat_ws("/", F.slice(p, k, F.size(p) - k + 1)))).alias("wanted"))
    j = includes.join(tails, "wanted")
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    key = F.struct((folder(F.col("file")) != folder(F.col("path"))).cast("int").alias("a"), F.length("path").alias("b"), F.col("path").alias("c"))
    return j.groupBy("file", "wanted").agg(F.min(key).alias("k")).select("file", "wanted", F.col("k.c").alias("found"))
