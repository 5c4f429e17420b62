"""From reached symbols to ranked cases: risk rows, case generation, features, order, keys, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.operators.ranking import global_rank, log_bucket

# Risk groups in their order, those that outrank the others, and their severity.
GROUPS = ["logic", "abi_layout", "ownership_lifetime", "thread_safety", "exception_safety", "build_config"]
HIGH = ["abi_layout", "thread_safety", "exception_safety", "ownership_lifetime"]
SEVERITY = {"thread_safety": 3, "ownership_lifetime": 3, "exception_safety": 3, "abi_layout": 2, "logic": 2, "build_config": 1}
FILE_GROUPS = ["abi_layout", "build_config"]
LOW_SUBS = ["header_change", "inline_change", "logging", "test_code"]
IMPACT_LOW_SUBS = ["signature_change"]
READER_SUBS = ["removed_write", "setter_readers", "lock_coupling", "changed_default", "class_consumer", "conditional_write"]


def generate(nodes: DataFrame, risks: DataFrame, is_file: Column) -> DataFrame:
    """(node, hop, risk_group, sub_reason, roots): one case for each risk of a root itself; for a reached node one for
    each risk group of the roots that reach it, from the nearest of them. File nodes carry FILE_GROUPS only, and
    abi_layout where none of their roots has one of these.

    nodes: root, node, hop; is_file tests a node."""
    own = risks.select(F.col("root").alias("node"), F.lit(0).alias("hop"), "risk_group", "sub_reason", F.array("root").alias("roots"))
    far = nodes.where("hop > 0").join(risks, "root")
    near = Window.partitionBy("node", "risk_group")
    far = far.withColumn("least", F.min("hop").over(near)).where("hop = least").withColumn("file_node", is_file)
    kept = far.where(~F.col("file_node") | F.col("risk_group").isin(*FILE_GROUPS))
    bare = far.where("file_node").join(kept.where("file_node").select("node").distinct(), "node", "left_anti")
    bare = bare.withColumn("risk_group", F.lit("abi_layout")).withColumn("sub_reason", F.lit("")).withColumn("least", F.min("hop").over(Window.partitionBy("node"))).where("hop = least")
    g = kept.unionByName(bare.select(*kept.columns)).groupBy("node", "risk_group").agg(F.min("hop").alias("hop"), F.min("sub_reason").alias("sub_reason"), F.array_sort(F.collect_set("root")).alias("roots"))
    return own.unionByName(g.select("node", "hop", "risk_group", "sub_reason", "roots"))


def low(hop: Column, sub: Column) -> Column:
    return sub.isin(*LOW_SUBS) | ((hop > 0) & sub.isin(*IMPACT_LOW_SUBS))


def priority(hop: Column, group: Column, sub: Column) -> Column:
    """P1 to P3 by distance and severity."""
    high = group.isin(*HIGH) & ~low(hop, sub)
    return (
        F.when(sub.isin("logging", "test_code"), "P3")
        .when((sub == "removed_guard") & (hop == 0), "P1")
        .when(sub.isin(*READER_SUBS), F.when(hop <= 1, "P2").otherwise("P3"))
        .when((hop <= 1) & high, "P1")
        .when((hop <= 1) | high, "P2")
        .otherwise("P3")
    )


def features(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, lines, fan_in): changed lines of all roots that reach a node, and how many they are."""
    return nodes.join(weights, "root").groupBy("node").agg(F.sum("lines").cast("bigint").alias("lines"), F.countDistinct("root").alias("fan_in"))


def rank(cases: DataFrame) -> DataFrame:
    """Number the cases and give them their ids TC-0001...

    cases: node, hop, risk_group, sub_reason, lines, fixes, fan_in, file, line. Nearest first; cases of a foreign
    interface last among equals; those of low weight later; then larger changes, more often fixed files, severity,
    fan-in, group order, place and node."""
    sev = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("risk_group"))
    pos = F.array_position(F.lit(GROUPS), F.col("risk_group"))
    keyed = cases.select(
        "*",
        (F.col("sub_reason") == "external_call").alias("_x"),
        low(F.col("hop"), F.col("sub_reason")).alias("_low"),
        log_bucket(F.coalesce("lines", F.lit(0))).alias("_l"),
        log_bucket(F.coalesce("fixes", F.lit(0))).alias("_f"),
        sev.alias("_sev"),
        pos.alias("_pos"),
    )
    order = [F.col("hop"), F.col("_x"), F.col("_low"), F.desc("_l"), F.desc("_f"), F.desc("_sev"), F.desc("fan_in"), F.col("_pos"), F.asc_nulls_first("file"), F.asc_nulls_first("line"), F.col("node"), F.col("sub_reason")]
    ranked = global_rank(keyed, order).drop("_x", "_low", "_l", "_f", "_sev", "_pos")
    return ranked.withColumn("id", F.format_string("TC-%04d", "rank")).withColumn("priority", priority(F.col("hop"), F.col("risk_group"), F.col("sub_reason")))


def keys(cases: DataFrame) -> DataFrame:
    """A stable key of what a case is about; the second and later ones of a key get -2, -3... by rank.

    cases: name, file, risk_group, sub_reason, roots, rank."""
    raw = F.concat_ws("\x1f", F.coalesce("name", F.lit("")), F.coalesce("file", F.lit("")), "risk_group", "sub_reason", F.array_join("roots", ","), F.lit(""), F.lit(""))
    k = cases.withColumn("_k", F.substring(F.sha1(raw), 1, 12))
    n = F.row_number().over(Window.partitionBy("_k").orderBy("rank"))
    return k.withColumn("_n", n).withColumn("key", F.when(F.col("_n") == 1, F.col("_k")).otherwise(F.concat_ws("-", "_k", "_n"))).drop("_k", "_n")


def merge(cases: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Fold cases of one (name, file, group) into the first; the texts of all, each once, in order, joined by '; '."""
    first = Window.partitionBy(*by, text).orderBy(order)
    one = cases.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return one.groupBy(*by).agg(F.min(order).alias(order), F.array_join(texts, "; ").alias(text), F.count(F.lit(1)).alias("merged"))


def evidence_gate(cases: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split cases by whether their evidence (name, file) is a known symbol: (kept, dropped)."""
    known = symbols.select("name", "file").where("name is not null and file is not null").distinct()
    return cases.join(known, ["name", "file"], "left_semi"), cases.join(known, ["name", "file"], "left_anti")


def scope(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes with in_scope: whether their targets and the wanted ones meet; a node without targets stays in.

    nodes: node, targets (array); wanted: target, a short list of names."""
    names = [r["target"] for r in wanted.select("target").distinct().collect()]  # named by hand: few
    return nodes.withColumn("in_scope", (F.size("targets") == 0) | F.arrays_overlap("targets", F.lit(names)))
