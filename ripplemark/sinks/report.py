"""Reports of ranked cases: JSON lines by the executors, and bounded pages (Markdown, HTML, brief, graph) by the driver.

A page shows the first `most` cases; the whole result is in the JSON or Parquet table, which the executors write.
"""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cases on a page, and nodes of a graph.
MOST, NODES = 80, 60
BLOCK = re.compile(r'<script type="application/json" id="results">(.*?)</script>', re.S)


def write_table(cases: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All cases, by the executors; nested columns stay nested."""
    w = cases.write.mode("overwrite")
    (w.json if fmt == "json" else w.parquet)(path)


def _first(cases: DataFrame, most: int) -> list:
    return cases.orderBy("rank").limit(most).collect()


def _plain(x: object) -> str:
    return "" if x is None else re.sub(r"([|`*_<>])", r"\\\1", " ".join(str(x).split()))


def markdown(cases: DataFrame, most: int = MOST) -> str:
    """A page by distance, with the counts of each priority first. cases: rank, id, priority, node, hop, risk_group,
    sub_reason."""
    n = {r["priority"]: r["count"] for r in cases.groupBy("priority").count().collect()}
    out = ["# Cases", "", ", ".join(f"{k}: {n[k]}" for k in sorted(n)) or "none", ""]
    hop = None
    for r in _first(cases, most):
        if r["hop"] != hop:
            hop = r["hop"]
            out += [f"## {hop} hops away" if hop else "## Changed itself", ""]
        out.append(f"- **{r['id']}** {r['priority']} {_plain(r['node'])}: {_plain(r['risk_group'])}" + (f", {_plain(r['sub_reason'])}" if r["sub_reason"] else ""))
    return "\n".join(out) + "\n"


def brief(cases: DataFrame, most: int = MOST) -> str:
    """One tagged line a case."""
    return "".join(f"{r['id']}\t{r['priority']}\thop={r['hop']}\t{r['risk_group']}\t{r['node']}\n" for r in _first(cases, most))


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = NODES) -> str:
    """The first nodes by hop and id, and the edges among them that lead one hop on. nodes: node, hop; edges: dependency,
    dependent."""
    top = nodes.orderBy("hop", "node").limit(most)
    a, b = top.select(F.col("node").alias("dependency"), F.col("hop").alias("h")), top.select(F.col("node").alias("dependent"), F.col("hop").alias("k"))
    e = edges.join(F.broadcast(a), "dependency").join(F.broadcast(b), "dependent").where("h < k").select("dependency", "dependent").distinct()  # both sides have at most `most` rows
    ids = {r["node"]: f"n{i}" for i, r in enumerate(top.orderBy("hop", "node").collect())}
    out = ["graph LR"] + [f'  {i}["{html.escape(n)}"]' for n, i in ids.items()]
    return "\n".join(out + sorted(f"  {ids[r['dependency']]} --> {ids[r['dependent']]}" for r in e.collect())) + "\n"


def page(cases: DataFrame, results: dict, most: int = MOST) -> str:
    """An HTML page with the cases and a block of results that can be filled and read back."""
    rows = "".join(f"<tr><td>{r['id']}</td><td>{r['priority']}</td><td>{html.escape(str(r['node']))}</td><td>{r['risk_group']}</td></tr>\n" for r in _first(cases, most))
    block = json.dumps(results, sort_keys=True).replace("<", "\\u003c")
    return f'<!doctype html>\n<meta charset="utf-8"><title>Cases</title>\n<table>\n{rows}</table>\n<script type="application/json" id="results">{block}</script>\n'


def read_results(text: str) -> dict:
    """The block of results of a page; an error if it is missing or unusable."""
    m = BLOCK.search(text)
    if not m:
        raise ValueError("no results in this page")
    got = json.loads(m[1])
    if not isinstance(got, dict):
        raise ValueError("results are no object")
    return got


def write_pages(cases: DataFrame, folder: str, formats: tuple[str, ...] = ("json", "md", "html", "brief"), results: dict | None = None) -> list[str]:
    """Write the chosen formats; a page someone has filled in is kept beside the new one as .bak."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    out = []
    for fmt in formats:
        if fmt == "json":
            write_table(cases, str(to / "cases.json"), "json")
            out.append(str(to / "cases.json"))
            continue
        f = to / {"md": "cases.md", "html": "cases.html", "brief": "cases.txt"}[fmt]
        if fmt == "html" and f.exists() and read_results(f.read_text()):
            f.rename(f.with_suffix(".html.bak"))
        f.write_text({"md": markdown, "brief": brief}[fmt](cases) if fmt != "html" else page(cases, results or {}))
        out.append(str(f))
    return out


def cached(spark: SparkSession, folder: str, key: DataFrame, make) -> DataFrame:
    """The table `make()` gives, kept under the digest of its inputs: computed once for each content of `key`.

    The digest is a sum over row hashes, so the order of rows does not matter and nothing is collected but one number."""
    cols = [F.col(f"`{c}`") for c in key.columns]
    r = key.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *cols)).alias("b"), F.expr("cast(sum(cast(xxhash64(*) as decimal(38, 0))) as string)").alias("c")).first()
    at = f"{folder}/{r['n']}-{(r['a'] or 0) & (2**64 - 1):016x}{(r['b'] or 0) & (2**64 - 1):016x}-{r['c']}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
