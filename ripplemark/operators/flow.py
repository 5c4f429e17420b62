"""Data flow over tables of definitions: taint within functions, paths of values, readers of stores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.text import name_words
from ripplemark.operators.blocks import ROWS, numbered, packed, spread
from ripplemark.operators.ranking import first_k

# Words of a name that tell that a call gives data away, and those that tell it does not.
EMITTER_WORDS = ["send", "write", "publish", "post", "notify", "emit", "transmit", "enqueue", "serialize", "deliver", "output", "upload", "broadcast", "reply", "respond"]
NOT_EMITTER_WORDS = ["log", "logger", "trace", "debug", "print", "printf", "dump", "assert"]


def definitions(lines: DataFrame, head: str, statement: str) -> DataFrame:
    """(file, fn, no, target, callee, source) of assignments from calls; fn is the line of the function's head.

    lines: file, no, text. The head before a line owns it; statements before any head belong to none and are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("no")
    x = lines.withColumn("fn", F.max(F.when(F.col("text").rlike(head), F.col("no"))).over(w))
    g = lambda i: F.regexp_extract("text", statement, i)
    return x.where(F.col("fn").isNotNull() & F.col("text").rlike(statement)).select("file", "fn", "no", g(1).alias("target"), g(2).alias("callee"), g(3).alias("source"))


def taint(defs: DataFrame, hot: DataFrame, passes: int = 2) -> DataFrame:
    """(file, fn, atom): what a function's hot lines flow into. defs: file, fn, no, target, source; hot: file, no.

    Lines are read in order, twice, so that a value defined later in a loop's body reaches what came before it."""
    marked = defs.join(hot.select("file", "no", F.lit(True).alias("hot")).distinct(), ["file", "no"], "left")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["no", "target"])
        seen: set[str] = set()
        for _ in range(passes):
            for h, t, s in zip(rows["hot"], rows["target"], rows["source"]):
                if h is True or s in seen:
                    seen.add(t)
        where = int(rows["file"].iloc[0]), int(rows["fn"].iloc[0])
        return pd.DataFrame([(*where, a) for a in sorted(seen)], columns=["file", "fn", "atom"])

    return marked.select("file", "fn", "no", "target", "source", "hot").groupBy("file", "fn").applyInPandas(one, "file bigint, fn int, atom string")


def is_emitter(name: Column, third_party: Column, sinks: list[str] | None = None) -> Column:
    """Whether a call gives data away: a sink by name (glob patterns on the full or the short one), never the standard
    library or a logger, else foreign code or a name with an emitting word."""
    from ripplemark.functions.text import glob_regex

    words = name_words(name)
    short = F.element_at(F.split(name, "::"), -1)
    sink = F.lit(False)
    for g in sinks or []:
        sink = sink | name.rlike(glob_regex(g)) | short.rlike(glob_regex(g))
    return (
        F.when(sink, True)
        .when(name.startswith("std::") | name.startswith("__"), False)
        .when(F.arrays_overlap(words, F.lit(NOT_EMITTER_WORDS)), False)
        .otherwise(F.coalesce(third_party, F.lit(False)) | F.arrays_overlap(words, F.lit(EMITTER_WORDS)))
    )


#: Roots that are followed at once.
ROOTS_AT_ONCE = 1024


def _flow(t: pa.Table) -> dict:
    """Of rows (kind, a, b, c, emits): within (0: src, dst), exits (1: node, channel), entries (2: channel, node), starts (3: root,
    node), calls (4: node, usr, callee)."""
    part = lambda k: t.filter(pc.equal(t["kind"], k))
    within, exits, entries, starts, calls = map(part, range(5))
    nodes, (src, dst, out, into, at, arg) = numbered(within["a"], within["b"], exits["a"], entries["b"], starts["b"], calls["a"])
    channels, (out_c, in_c) = numbered(exits["b"], entries["a"])
    roots, (root, by) = numbered(starts["a"], calls["b"])
    n_roots = int(root.max()) + 1 if len(root) else 0
    callees, (callee,) = numbered(calls["c"])
    who = np.unique(by * (len(callees) + 1) + callee)
    taken = np.isin(np.arange(len(channels)), in_c)
    why = pc.if_else(pa.array(taken), "depth limit", "no one takes it")
    order = pc.sort_indices(pc.binary_join_element_wise(why, channels, ": ")).to_numpy()
    return {
        "nodes": nodes, "channels": channels, "roots": roots, "callees": callees, "within": (src, dst), "exits": (out, out_c), "entries": (in_c, into), "start": (root, at),
        "calls": (arg, np.searchsorted(who, by * (len(callees) + 1) + callee)), "who": (who // (len(callees) + 1), who % (len(callees) + 1)), "n": n_roots, "taken": taken, "why": why, "order": order,
    }


def _carry(src: np.ndarray, dst: np.ndarray):
    """A function that takes the bits of src's rows to dst's: rows of dst, and their bits."""
    order = np.argsort(dst, kind="stable")
    s, (rows, first) = src[order], np.unique(dst[order], return_index=True)
    return lambda bits: (rows, np.bitwise_or.reduceat(bits[s], first, axis=0) if len(s) else bits[:0])


def _steps(g: dict, i: int, n: int, depth: int):
    """(first root, roots, for each depth the bits of the nodes first reached there), for blocks of roots."""
    within, leave, enter = (_carry(*g[k]) for k in ("within", "exits", "entries"))
    root, at = g["start"]
    for lo in range(i * ROOTS_AT_ONCE, g["n"], n * ROOTS_AT_ONCE):
        wide = min(ROOTS_AT_ONCE, g["n"] - lo)
        known = np.zeros((len(g["nodes"]), (wide + 7) // 8), np.uint8)
        now, levels = np.zeros_like(known), []
        mine = (root >= lo) & (root < lo + wide)
        r = root[mine] - lo
        np.bitwise_or.at(now, (at[mine], r // 8), (1 << (r % 8)).astype(np.uint8))
        for d in range(depth + 1):
            while True:  # along the statements of the functions, until nothing is new
                rows, more = within(now)
                if not (more & ~now[rows]).any():
                    break
                now[rows] |= more
            now &= ~known
            known |= now
            levels.append(now)
            if d < depth:
                across = np.zeros((len(g["channels"]), now.shape[1]), np.uint8)
                rows, more = leave(now)
                across[rows] = more
                rows, more = enter(across)
                now = np.zeros_like(known)
                now[rows] = more
        yield lo, wide, levels


def _set(bits: np.ndarray, wide: int):
    """(row, root) of the bits that are set, some rows at a time."""
    step = max(1, ROWS * 16 // max(wide, 1))
    for at in range(0, len(bits), step):
        rows, roots = np.nonzero(np.unpackbits(bits[at : at + step], axis=1, count=wide, bitorder="little"))
        if len(rows):
            yield rows + at, roots


def _count(bits: np.ndarray, wide: int) -> np.ndarray:
    total = np.zeros(wide, np.int64)
    for at in range(0, len(bits), 4096):
        total += np.unpackbits(bits[at : at + 4096], axis=1, count=wide, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def flow(within: DataFrame, exits: DataFrame, entries: DataFrame, starts: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """The value graph as one row, for the functions below. A node is a value in a function. within: src, dst (a value that
    goes into another of the same function); exits: node, channel (a value handed over: stored in a name others see, passed
    as an argument, returned); entries: channel, node (where it arrives); starts: root, node; calls: node (the argument),
    usr, callee, emits. Between an exit and an entry lies one step of depth."""
    none = F.lit(None).cast("string")
    three = lambda k, df, a, b, c=none: df.select(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), c.alias("c")).where("a is not null and b is not null").distinct()
    rows = three(0, within, "src", "dst").unionByName(three(1, exits, "node", "channel")).unionByName(three(2, entries, "channel", "node")).unionByName(three(3, starts, "root", "node"))
    if calls is not None:
        rows = rows.unionByName(three(4, calls.where("emits"), "node", "usr", F.col("callee")))
    return packed(rows, _flow, "flow")


def reached(g: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth), with the least depth."""

    def work(made: dict, i: int, n: int):
        for lo, wide, levels in _steps(made, i, n, depth):
            for d, bits in enumerate(levels):
                for node, r in _set(bits, wide):
                    yield [made["roots"].take(pa.array(r + lo)), made["nodes"].take(pa.array(node)), pa.array(np.full(len(r), d, np.int32))]

    return spread(g, work, "c0 string, c1 string, c2 int").toDF("root", "node", "depth")


def reach_counts(g: DataFrame, depth: int) -> DataFrame:
    """(root, depth, vals): how many values are first reached at a depth."""

    def work(made: dict, i: int, n: int):
        for lo, wide, levels in _steps(made, i, n, depth):
            for d, bits in enumerate(levels):
                k = _count(bits, wide)
                r = np.flatnonzero(k)
                yield [made["roots"].take(pa.array(r + lo)), pa.array(np.full(len(r), d, np.int32)), pa.array(k[r])]

    return spread(g, work, "c0 string, c1 int, c2 bigint").toDF("root", "depth", "vals")


def breaks(g: DataFrame, depth: int, first: int | None = None) -> DataFrame:
    """(root, channel, why, n): what is handed over at the last depth (depth limit), or before it to no one (no one takes
    it); the first by why and channel, all if first is None, and how many there are."""

    def work(made: dict, i: int, n: int):
        leave, taken, order = _carry(*made["exits"]), made["taken"], made["order"]
        for lo, wide, levels in _steps(made, i, n, depth):
            over = np.zeros((len(taken), levels[0].shape[1]), np.uint8)
            for d, bits in enumerate(levels):
                rows, more = leave(bits)
                keep = taken[rows] == (d == depth)
                over[rows[keep]] |= more[keep]
            over = over[order]
            total, seen = _count(over, wide), np.zeros(wide, np.int64)
            for at, r in _set(over, wide):
                if first is not None:
                    by = np.argsort(r, kind="stable")
                    at, r = at[by], r[by]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    keep = place + seen[r] < first
                    np.add.at(seen, r, 1)
                    at, r = at[keep], r[keep]
                c = pa.array(order[at])
                yield [made["roots"].take(pa.array(r + lo)), made["channels"].take(c), made["why"].take(c), pa.array(total[r])]

    return spread(g, work, "c0 string, c1 string, c2 string, c3 bigint").toDF("root", "channel", "why", "n")


def emitting(g: DataFrame, depth: int) -> DataFrame:
    """(root, usr, callee, depth): calls outside the root itself that give a traced value away; the least depth."""

    def work(made: dict, i: int, n: int):
        give, (usr, callee) = _carry(*made["calls"]), made["who"]
        for lo, wide, levels in _steps(made, i, n, depth):
            known = np.zeros((len(usr), levels[0].shape[1]), np.uint8)
            for d, bits in enumerate(levels[1:], 1):
                rows, more = give(bits)
                more = more & ~known[rows]
                known[rows] |= more
                for at, r in _set(more, wide):
                    w = rows[at]
                    w, r = w[usr[w] != r + lo], r[usr[w] != r + lo]
                    yield [made["roots"].take(pa.array(r + lo)), made["roots"].take(pa.array(usr[w])), made["callees"].take(pa.array(callee[w])), pa.array(np.full(len(r), d, np.int32))]

    return spread(g, work, "c0 string, c1 string, c2 string, c3 int").toDF("root", "usr", "callee", "depth")


def trace(within: DataFrame, exits: DataFrame, entries: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Values followed from function to function: (root, node, depth) and the breaks (root, channel, why), as rows."""
    g = flow(within, exits, entries, starts)
    return reached(g, depth), breaks(g, depth).drop("n")


def emitted(reached: DataFrame, calls: DataFrame) -> DataFrame:
    """(root, usr, callee, depth) of rows of trace, as emitting gives it."""
    j = reached.where("depth > 0").join(calls.where("emits").select("node", "usr", "callee"), "node")
    return j.where("root <> usr").groupBy("root", "usr", "callee").agg(F.min("depth").alias("depth"))


def store_readers(defs: DataFrame, member: str, first: int = 4) -> DataFrame:
    """(file, fn, store, r_file, r_fn): the first functions that read what a function stores in a variable other
    functions see. Members (names that match `member`) are looked for in the same file only, other stores everywhere."""
    w = defs.select("file", "fn", F.col("target").alias("store")).distinct()
    r = defs.select(F.col("file").alias("r_file"), F.col("fn").alias("r_fn"), F.col("source").alias("store")).distinct()
    j = w.join(r, "store").where((F.col("file") != F.col("r_file")) | (F.col("fn") != F.col("r_fn")))
    j = j.where(~F.col("store").rlike(member) | (F.col("file") == F.col("r_file")))
    return first_k(j, ["file", "fn", "store"], [F.col("r_file"), F.col("r_fn")], first).select("file", "fn", "store", "r_file", "r_fn")
