"""What can be reached in a graph, a block of columns at a time.

The pairs of nodes with a path between them are too many to be shuffled or kept: they grow with the square of the nodes, and
joins meet each of them once for every node on the way. So one task numbers the nodes and folds what lies on loops
into one (it holds the links as integers, and the names once), and its result, one row, goes to all tasks. Each of them then
takes blocks of WIDTH targets, goes over the links once with a bit for each target, and writes what it finds. Pairs meet
no shuffle, no join and no intermediate table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.runtime import Staged, partitions

#: Targets of a block, and rows of a batch.
WIDTH = 4096
ROWS = 1 << 17


def packed(rows: DataFrame, build: Callable[[pa.Table], object], tag: str) -> DataFrame:
    """One row with what build makes of all rows, in one task; none if there are no rows."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            made = pickle.dumps(build(pa.Table.from_batches(kept)), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])

    return Staged(rows.repartition(1).mapInArrow(one, "made binary"), tag).df


def spread(made: DataFrame, work: Callable[[object, int, int], Iterator[list]], schema: str) -> DataFrame:
    """What work(made, i, n) yields, for each i of n tasks: lists of columns."""
    n = max(partitions(made.sparkSession), made.sparkSession.sparkContext.defaultParallelism)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in zip(b.column(0), b.column(1)):
                for columns in work(pickle.loads(m.as_buffer()), i.as_py(), n):
                    yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    return made.sparkSession.range(0, n, 1, n).crossJoin(F.broadcast(made)).mapInArrow(one, schema)


def numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of some columns in order of coming, and each column as their numbers."""
    d = pa.concat_arrays([pa.array([], columns[0].type), *[c for col in columns for c in col.chunks]]).dictionary_encode()
    cuts = np.cumsum([len(c) for c in columns])[:-1]
    return d.dictionary, np.split(d.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts)


def fold(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strong components of the links a -> b among nodes 0..n-1: the component of each node, whether a component loops,
    and the links between components (first child and children by component). Children have smaller numbers."""
    order = np.argsort(a, kind="stable")
    to, ptr = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    seen, low, comp = [0] * n, [0] * n, [-1] * n
    at, stack, clock, k = ptr[:-1], [], 0, 0
    for r in range(n):
        if seen[r]:
            continue
        clock += 1
        seen[r] = low[r] = clock
        stack.append(r)
        walk = [r]
        while walk:
            v = walk[-1]
            if at[v] < ptr[v + 1]:
                x = to[at[v]]
                at[v] += 1
                if not seen[x]:
                    clock += 1
                    seen[x] = low[x] = clock
                    stack.append(x)
                    walk.append(x)
                elif comp[x] < 0 and seen[x] < low[v]:
                    low[v] = seen[x]
                continue
            walk.pop()
            if low[v] == seen[v]:
                while comp[v] < 0:
                    comp[stack.pop()] = k
                k += 1
            if walk and low[v] < low[walk[-1]]:
                low[walk[-1]] = low[v]
    c = np.array(comp, np.int64)
    ca, cb = c[a], c[b]
    loops = np.bincount(ca[ca == cb], minlength=k) > 0
    links = np.unique(ca[ca != cb] * k + cb[ca != cb])
    return c, loops, np.searchsorted(links, np.arange(k + 1) * k), links % max(k, 1)


def _graph(t: pa.Table) -> dict:
    """Of rows (kind, a, b, label, flag): links from a to b (kind 0), and marks: the label and flag of b, which stands at
    node a (kind 1). Marks come by label, then by name; those at a node without links reach nothing and are left out."""
    links, marks = t.filter(pc.equal(t["kind"], 0)), t.filter(pc.equal(t["kind"], 1))
    _, (a, b, at) = numbered(links["a"], links["b"], marks["a"])
    n = int(max(a.max(), b.max())) + 1 if len(a) else 0
    comp, loops, first, child = fold(n, a, b)
    marks, at = marks.filter(pa.array(at < n)), at[at < n]
    marks = marks.append_column("at", pa.array(at)).sort_by([("label", "ascending"), ("b", "ascending")])
    names, (name,) = numbered(marks["b"])
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    _, (label,) = numbered(marks["label"])
    return {
        "loops": loops, "first": first, "child": child, "comp": comp[marks["at"].to_numpy()], "label": label, "flag": marks["flag"].to_numpy().astype(bool),
        "name": rank[name], "names": names.take(pc.sort_indices(names)),
    }


def graph(links: DataFrame, marks: DataFrame) -> DataFrame:
    """links: a, b; marks: node, name, label, flag."""
    none = F.lit(None)
    rows = links.select(F.lit(0).alias("kind"), "a", "b", none.cast("string").alias("label"), none.cast("boolean").alias("flag"))
    return packed(rows.unionByName(marks.select(F.lit(1).alias("kind"), F.col("node").alias("a"), F.col("name").alias("b"), "label", "flag")), _graph, "graph")


def _below(g: dict, own: dict[int, int]) -> list[int]:
    """For each component the bits that its nodes reach by one link or more, own having the bits of components."""
    below, full = [], []
    loops, first, child = g["loops"].tolist(), g["first"].tolist(), g["child"].tolist()
    for c in range(len(loops)):
        m, o = 0, own.get(c, 0)
        for w in child[first[c] : first[c + 1]]:
            m |= full[w]
        if loops[c]:
            m |= o
        below.append(m)
        full.append(m | o)
    return below


def _ones(m: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(m.to_bytes((m.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


def _pairs(g: dict, i: int, n: int, either: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(from, to) as numbers of names: marks of one label of which one reaches the other. either: only different names, one
    of which at least has its flag set."""
    comp, label, flag, name = g["comp"], g["label"], g["flag"], g["name"]
    ends = np.searchsorted(label, np.arange(label[-1] + 2)) if len(label) else np.zeros(1, np.int64)
    got, size = ([], []), 0
    for lo in range(i * WIDTH, len(comp), n * WIDTH):
        hi = min(lo + WIDTH, len(comp))
        own: dict[int, int] = {}
        for j, c in enumerate(comp[lo:hi].tolist()):
            own[c] = own.get(c, 0) | 1 << j
        below = _below(g, own)
        for x in range(label[lo], label[hi - 1] + 1):
            p, q = max(ends[x], lo) - lo, min(ends[x + 1], hi) - lo
            mine, held = ((1 << int(q)) - 1) & ~((1 << int(p)) - 1), {}
            for s in range(ends[x], ends[x + 1]):
                c = int(comp[s])
                if c not in held:
                    held[c] = _ones(below[c] & mine) + lo
                to = held[c]
                if either:
                    to = to[(flag[to] | flag[s]) & (name[to] != name[s])]
                if len(to):
                    got[0].append(np.full(len(to), name[s]))
                    got[1].append(name[to])
                    size += len(to)
                if size >= ROWS:
                    yield np.concatenate(got[0]), np.concatenate(got[1])
                    got, size = ([], []), 0
    if size:
        yield np.concatenate(got[0]), np.concatenate(got[1])


def named_pairs(g: DataFrame, columns: tuple[str, str], kind: str = "string") -> DataFrame:
    """Pairs of the marks' names: those of one label of which the first reaches the second."""

    def work(made: dict, i: int, n: int) -> Iterator[list]:
        for a, b in _pairs(made, i, n, False):
            yield [made["names"].take(pa.array(x)) for x in (a, b)]

    return spread(g, work, f"c0 {kind}, c1 {kind}").toDF(*columns)


def related(g: DataFrame, columns: tuple[str, str]) -> DataFrame:
    """(name, names in order): what a mark reaches or is reached from, of its label; one of the two has its flag set."""

    def work(made: dict, i: int, n: int) -> Iterator[list]:
        for a, b in _pairs(made, i, n, True):
            yield [pa.array(np.concatenate(x).astype(np.int32)) for x in ((a, b), (b, a))]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for b in batches:
            if names is None and b.num_rows:
                names = pickle.loads(b.column(2)[0].as_buffer())["names"]
            for at in range(0, b.num_rows, 16):
                one, many = b.column(0).slice(at, 16), b.column(1).slice(at, 16)
                cuts = np.cumsum([0, *pc.list_value_length(many).to_pylist()])
                yield pa.RecordBatch.from_arrays([names.take(one), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), names.take(many.flatten()))], ["c0", "c1"])

    sets = spread(g, work, "c0 int, c1 int").groupBy("c0").agg(F.array_sort(F.collect_set("c1")).alias("c1"))
    # the graph comes with the first row of each partition only
    first = sets.withColumn("_first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    return first.join(F.broadcast(g), F.col("_first"), "left").select("c0", "c1", "made").mapInArrow(name, "c0 string, c1 array<string>").toDF(*columns)


def least(g: DataFrame, columns: tuple[str, str]) -> DataFrame:
    """(name, the least flagged name it reaches) of each mark without a flag that reaches one with it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0):
                made = pickle.loads(m.as_buffer())
                far = len(made["names"])
                loops, first, child = made["loops"].tolist(), made["first"].tolist(), made["child"].tolist()
                own, below = np.full(len(loops), far), []
                np.minimum.at(own, made["comp"][made["flag"]], made["name"][made["flag"]])
                for c, o in enumerate(own.tolist()):
                    below.append(min([o if loops[c] else far, *[min(below[w], own[w]) for w in child[first[c] : first[c + 1]]]]))
                got = np.array(below, np.int64)[made["comp"]]
                hit = ~made["flag"] & (got < far)
                yield pa.RecordBatch.from_arrays([made["names"].take(pa.array(x[hit])) for x in (made["name"], got)], ["c0", "c1"])

    return g.mapInArrow(work, "c0 string, c1 string").toDF(*columns)
