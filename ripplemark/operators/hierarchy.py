"""Hierarchies out of parent links, of any depth and with loops: splitters and a reduced pointer graph.

Every node points at its parent. Some nodes, chosen by a hash of their id, are splitters. Each node walks up to its next
splitter (or root) by pointer doubling; only then are the splitters, a fixed fraction of the nodes, solved among
themselves by doubling; at last every node takes its splitter's answer and adds its own stretch. Nodes that find no
root lie in or under a loop, whether a splitter is on it or not; they are few as a rule and solved by themselves.

Each round is one join over rows still under way, and only these are written; rounds grow with the logarithm of the depth.
Once a round ends no walk, those still under way are looping. Joins are on parents, of which one may hold many nodes: the
other side has one row a node, so that adaptive execution can split such a parent's rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.runtime import Staged

#: One node in so many is a splitter.
ONE_IN = 8
#: Where fewer than one row in so many is under way, what they point at is picked out before the join.
FEW = 8


def one_parent(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, up): one parent a node. Edges lacking an end do not count; of several parents the smallest id stands."""
    return (
        edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull())
        .groupBy(F.col(child).alias("node"))
        .agg(F.min(parent).alias("up"))
    )


def _double(active: DataFrame, known: DataFrame, seg: bool) -> DataFrame:
    """One doubling of the rows under way. done: 0 under way, 1 at a stop, 2 at a root. known: all rows there are, or at
    least those that the active ones point at."""
    n = known.select(F.col("node").alias("n_node"), F.col("ptr").alias("n_ptr"), F.col("dist").alias("n_dist"), F.col("done").alias("n_done"), *([F.col("seg").alias("n_seg")] if seg else []))
    j = active.join(n, F.col("ptr") == F.col("n_node"), "left")
    lost = F.col("n_node").isNull()  # the pointer has no row: it is a root
    cols = [
        F.col("node"),
        F.when(lost, F.col("ptr")).otherwise(F.col("n_ptr")).alias("ptr"),
        F.when(lost, F.col("dist")).otherwise(F.col("dist") + F.col("n_dist")).alias("dist"),
        F.when(lost, F.lit(2)).otherwise(F.col("n_done")).alias("done"),
    ]
    if seg:
        cols.append(F.when(lost, F.col("seg")).otherwise(F.concat("seg", F.array("ptr"), "n_seg")).alias("seg"))
    return j.select(*cols)


def _walk(start: DataFrame, seg: bool, tag: str) -> DataFrame:
    """Double until all rows are done or those that are not must be looping. A round writes only the rows under way; those
    that are done stay where they were written. How many are left is counted while they are written."""
    count = {"left": F.count_if(F.col("done") == 0), "rows": F.count(F.lit(1))}
    held = Staged(start, tag, count)
    finished, active, left, total = [held.df.where("done <> 0")], held.df.where("done = 0"), held.seen["left"], held.seen["rows"]
    before = None
    # if a round ends no walk, all pointers of rows under way lead to rows under way, and so will theirs: they are looping
    while left and left != before:
        known = reduce(DataFrame.unionByName, [*finished, active])
        if left * FEW < total:
            known = known.join(active.select(F.col("ptr").alias("node")).distinct(), "node", "left_semi")
        held = Staged(_double(active, known, seg), tag, count)
        finished.append(held.df.where("done <> 0"))
        active, before, left = held.df.where("done = 0"), left, held.seen["left"]
    return reduce(DataFrame.unionByName, [*finished, active])


def _loops(links: DataFrame) -> DataFrame:
    """links: (node, up) of nodes in or under loops, none of which leads to a root. Gives (node, status, root)."""
    now = Staged(links.select("node", F.col("up").alias("ptr"), F.least("node", "up").alias("least")), "loop")
    ends = None
    while True:
        a = now.df
        b = a.select(F.col("node").alias("b_node"), F.col("ptr").alias("b_ptr"), F.col("least").alias("b_least"))
        step = a.join(b, a.ptr == b.b_node).select("node", F.col("b_ptr").alias("ptr"), F.least("least", "b_least").alias("least"), (F.col("b_least") < F.col("least")).alias("new"))
        nxt = Staged(step, "loop", {"new": F.count_if("new")})
        now.drop()
        now, before = nxt, ends
        # no smaller id came in: what lies around each loop is known; as many ends as before: they are the loops' nodes
        ends = None if nxt.seen["new"] else now.df.select("ptr").distinct().count()
        if ends is not None and ends == before:
            break
    on = now.df.select(F.col("ptr").alias("c_node")).distinct()
    label = now.df.join(on, F.col("node") == F.col("c_node"), "left_semi").select(F.col("node").alias("c_node"), F.col("least").alias("root"))
    flags = label.select(F.col("c_node").alias("node"), F.lit("on_cycle").alias("status"), "root")
    below = now.df.join(on, F.col("node") == F.col("c_node"), "left_anti").join(label, F.col("ptr") == F.col("c_node")).select("node", F.lit("below_cycle").alias("status"), "root")
    return flags.unionByName(below)


@dataclass
class Forest:
    nodes: DataFrame  # node, root, depth, status
    links: DataFrame  # node, up
    paths: DataFrame | None  # node, path (from the root to the node), of trees only


def solve(links: DataFrame, with_paths: bool = False, one_in: int = ONE_IN) -> Forest:
    """links: (node, up), one row a node, from one_parent.

    nodes has one row for each node at either end of a link. status tree: root is the topmost one, depth 0 at the root;
    on_cycle and below_cycle: root is the smallest id on the loop, depth -1, no path. An empty table gives empty ones.
    """
    links = Staged(links, "links").df
    is_stop = F.pmod(F.xxhash64("ptr"), F.lit(one_in)) == 0
    tops = links.select(F.col("up").alias("node")).distinct().join(links, "node", "left_anti")
    start = links.join(tops.select(F.col("node").alias("t_node")), F.col("up") == F.col("t_node"), "left").select(
        "node", F.col("up").alias("ptr"), F.lit(1).alias("dist"), F.col("t_node").isNotNull().alias("top")
    )
    start = start.select("node", "ptr", "dist", F.when(F.col("top"), 2).when(is_stop, 1).otherwise(0).alias("done"), *([F.expr("cast(array() as array<string>)").alias("seg")] if with_paths else []))
    walk = _walk(start, with_paths, "walk")
    # the reduced graph: splitters only, each pointing at its next stop
    splitters = walk.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0)
    reduced = _walk(splitters.withColumn("done", F.when(F.col("done") == 1, 0).when(F.col("done") == 0, 3).otherwise(2)), with_paths, "reduced")
    # done = 3: the splitter itself walks into a loop without splitters; 0: it goes round a loop with some
    r = reduced.select(F.col("node").alias("s_node"), F.col("ptr").alias("s_ptr"), F.col("dist").alias("s_dist"), F.col("done").alias("s_done"), *([F.col("seg").alias("s_seg")] if with_paths else []))
    j = walk.join(r, (F.col("ptr") == F.col("s_node")) & (F.col("done") == 1), "left")
    direct = F.col("done") == 2
    found = direct | ((F.col("done") == 1) & (F.col("s_done") == 2))
    cols = [
        F.col("node"),
        F.when(direct, F.col("ptr")).otherwise(F.col("s_ptr")).alias("root"),
        F.when(direct, F.col("dist")).otherwise(F.col("dist") + F.col("s_dist")).cast("int").alias("depth"),
    ]
    if with_paths:
        up = F.when(direct, F.concat("seg", F.array("ptr"))).otherwise(F.concat("seg", F.array("ptr"), "s_seg", F.array("s_ptr")))
        cols.append(F.concat(F.reverse(up), F.array("node")).alias("path"))
    solved = j.withColumn("found", F.coalesce(found, F.lit(False)))
    tree = solved.where("found").select(*cols)
    astray = Staged(solved.where("not found").select("node").join(links, "node"), "astray", {"rows": F.count(F.lit(1))})
    tree_nodes = tree.select("node", "root", "depth", F.lit("tree").alias("status"))
    top_nodes = tops.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit("tree").alias("status"))
    nodes = tree_nodes.unionByName(top_nodes)
    if astray.seen["rows"]:
        loops = _loops(astray.df)
        nodes = nodes.unionByName(loops.select("node", "root", F.lit(-1).alias("depth"), "status"))
    paths = None
    if with_paths:
        paths = tree.select("node", "path").unionByName(tops.select("node", F.array("node").alias("path")))
    return Forest(nodes, links, paths)


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, distance) of every pair of a node and one below it, out of the exact paths."""
    e = paths.where(F.size("path") > 1).select(F.col("node").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "node"))
    return e.where(F.col("pos") < F.col("n") - 1).select("node", "descendant", (F.col("n") - 1 - F.col("pos")).cast("int").alias("distance"))
