import json
import random

import pytest
from brute_nested import found
from pyspark.sql import functions as F

from ripplemark.operators import nested as N
from ripplemark.plans.data_queries import p3_candidates, p3_checks, p3_found

SYM = {"qualified_name": "a::f", "kind": "method", "file_path": "x.cc", "line": "7"}
EDGE = {"relation": "call", "from_symbol": {"qualified_name": "b::g"}, "to_symbol": SYM}
REPORT = {"run_id": "r", "test_case_candidates": [{"id": "T1", "evidence": [SYM, None, {"symbol": SYM, "edge": None}, EDGE, {"symbol": None, "edge": EDGE}]}, None, {"id": "T2", "evidence": SYM}, {"id": "T3", "evidence": None}, {"id": "T4"}, {"id": "T5", "evidence": []}]}
PILOT = {"intro": "i1", "hits": [{"symbol": "p.cc:f", "hop": 1}, None, {"symbol": {"file_path": "q.h", "function": "g"}, "hop": "2"}]}
VERDICTS = {"cases": {"TC-1": {"verdict": "pass"}}, "additional_checks": [{"check": "c", "evidence": "p.cc:3"}, {"check": "d"}, {"check": "e", "evidence": ["q.h:9"]}, {"check": "f", "evidence": {"file_path": "r.h", "line": 4}}, {"check": "g", "evidence": None}, {"check": "h", "evidence": []}]}


def bodies():
    r, p, v = map(json.dumps, (REPORT, PILOT, VERDICTS))
    rows = [
        (1, "report", r), (1, "report", r), (2, "report", json.dumps({"report": REPORT, "format": 1})), (3, "report", "﻿" + r), (4, "report", f"note: x\n{r}\ndone in 3 s\n"), (5, "report", f"```json\n{json.dumps(REPORT, indent=2)}\n```"),
        (6, "report", json.dumps(r)), (7, "report", r[:-20]), (8, "report", None), (9, "report", ""), (10, "report", "-"), (11, "report", "null"), (12, "report", "[]"), (13, "report", "{}"), (14, "report", json.dumps({"test_case_candidates": REPORT["test_case_candidates"][0]})),
        (15, "pilot", p), (16, "pilot", json.dumps([PILOT, {"intro": "i2"}, {"intro": "i3", "hits": PILOT["hits"][0]}], indent=1)), (17, "pilot", json.dumps([PILOT, PILOT], indent=2)[:-30]), (18, "pilot", json.dumps(json.dumps([PILOT]))), (19, "pilot", "[]"),
        (20, "verdicts", v), (21, "verdicts", json.dumps({"additional_checks": VERDICTS["additional_checks"][0]})), (22, "verdicts", json.dumps({"cases": {}})), (23, "pilot", r), (24, "report", v),
    ]
    return rows


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nested"))
    spark.createDataFrame(bodies(), "record_id bigint, kind string, body string").withColumn("project", F.lit("x")).write.parquet(f"{d}/report_raw.parquet")
    return d


def test_found_is_the_plain_reading(spark, data):
    got = sorted(tuple(r) for r in p3_found(spark, data).select("record_id", "item", "parent", "pos", "val").collect())
    want = found([b for b in bodies() if b[0] not in (12, 24, 23)])
    assert got == want
    assert {r[0] for r in got}.isdisjoint({7, 8, 9, 10, 11, 13, 17, 19, 22})


def test_links_and_places(spark, data):
    c = [r for r in p3_candidates(spark, data).collect() if r["record_id"] == 1]
    assert sorted((r["id"], r["pos"]) for r in c) == [("T1", 0), ("T2", 2), ("T3", 3), ("T4", 4), ("T5", 5)]
    assert all(r["row_key"].endswith(f"/{r['pos']}") for r in c)
    assert sorted((r["pos"], r["val"]) for r in p3_checks(spark, data).where("record_id = 20").collect()) == [(0, "p.cc:3"), (2, "q.h:9"), (3, "r.h:4")]


def read(spark, docs, places=N.PLACES):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id bigint, body string")
    d = N.documents(df.select("id", F.lit("t").alias("kind"), F.col("id").cast("string").alias("doc_key"), "body"), "body")
    tree = N.infer_schema(d, "doc", "kind", places)["t"]
    return tree, N.tables(d, tree, ["id"])


def test_generic_tables(spark):
    docs = [{"a": 1, "x": {"y": [1, 2.5, None]}, "k": [{"n": "p", "z": [{"q": True}]}, {"n": 3}]}, {"k": {"n": "single", "z": {"q": False}}, "w d": "odd"}, {"k": None}, {}, []]
    tree, t = read(spark, docs)
    assert tree.at("k").many and tree.at("k", "z", "q").scalar_type() == "boolean" and tree.at("x", "y").scalar_type() == "double"
    assert set(t) == {"$", "k", "k.z", "x.y"}
    assert sorted((r["id"], r["_pos"], r["n"]) for r in t["k"].df.collect()) == [(0, 0, "p"), (0, 1, "3"), (1, 0, "single")]
    assert sorted((r["id"], r["_parent_pos"], r["q"]) for r in t["k.z"].df.collect()) == [(0, 0, True), (1, 0, False)]
    assert sorted((r["_pos"], r["_value"]) for r in t["x.y"].df.collect()) == [(0, 1.0), (1, 2.5)]
    assert {r[0] for r in t["$"].df.select(t["$"].col("w d")).collect()} == {None, "odd"}


def test_keys_that_are_data_and_arrays_in_arrays(spark):
    docs = [{"id": "a", "sha256": "abc", "line2": 7, "by": {"TC-0001": {"v": 1, "l": ["p", "q"]}, "TC-0002": None}, "m": [[{"x": 1}, {"x": 2}], [{"x": 3}], {"x": 4}]}]
    _, t = read(spark, docs)
    root = t["$"].df.collect()[0]
    assert (root["sha256"], root["line2"], root["id_2"]) == ("abc", 7, "a")
    assert sorted((r["_map_key"], r["v"]) for r in t["by.{}"].df.collect()) == [("TC-0001", 1), ("TC-0002", None)]
    assert sorted(r["_value"] for r in t["by.{}.l"].df.collect()) == ["p", "q"]
    assert sorted((r["_parent_pos"], r["_pos"], r["x"]) for r in t["m.[]"].df.collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 4)]


def test_odd_names(spark):
    docs = [{"it's": 1, "Id": 2, "id": 3, "a_b": 4, "a": {"b": 5}, "pos": 6, "_pos": 7, "row_key": 8, "": 9, "q?": 10, 'say "x"': {"y'\\": 11}, "a.b": 12, "ü": 13}]
    _, t = read(spark, docs)
    row = t["$"].df.collect()[0]  # no name is ambiguous
    want = {("it's",): 1, ("Id",): 2, ("id",): 3, ("a_b",): 4, ("a", "b"): 5, ("pos",): 6, ("_pos",): 7, ("row_key",): 8, ("",): 9, ("q?",): 10, ('say "x"', "y'\\"): 11, ("a.b",): 12, ("ü",): 13}
    assert {p: row[c] for p, c in t["$"].columns.items()} == want
    assert t["$"].df.select(*[f"`{c}`" for c in t["$"].df.columns]).count() == 1


def test_wrapped_many_times(spark):
    x = json.dumps({"a": 1})
    for _ in range(4):
        x = json.dumps(x)
    d = N.documents(spark.createDataFrame([(1, x), (2, json.dumps("no document"))], "id int, body string"), "body")
    assert [r["id"] for r in d.collect()] == [1]


def leaves(x, out, docid):
    if isinstance(x, dict):
        for y in x.values():
            leaves(y, out, docid)
    elif isinstance(x, list):
        for y in x:
            leaves(y, out, docid)
    elif x is not None:
        out.append((docid, str(x).lower() if isinstance(x, bool) else str(x)))


def made(r, depth):
    k = r.random()
    if depth == 0 or k < 0.3:
        return r.choice([None, f"s{r.randint(0, 999)}", r.randint(0, 999), True])
    if k < 0.65:
        names = r.choice([["a", "b", "C", "c"], ["x y", "it's", "a.b", "a_b"], [f"T-{i}" for i in range(9)], [f"free text {r.randint(0, 10**6)}" for _ in range(3)]])
        return {n: made(r, depth - 1) for n in r.sample(names, r.randint(0, 3))}
    return [made(r, depth - 1) for _ in range(r.randint(0, 3))]


def test_no_scalar_is_lost(spark, monkeypatch):
    """Every scalar of random documents is in one row of one table, however maps are told apart."""
    monkeypatch.setattr(N, "FIELDS", 12)
    r = random.Random(4)
    docs = [{"top": made(r, 4), "k": i} for i in range(40)] + [[made(r, 3)] for _ in range(10)]
    want = []
    for i, x in enumerate(docs):
        leaves(x, want, i)
    tree, t = read(spark, docs)
    got = []
    for x in t.values():
        cols = [f"`{c}`" for c in x.columns.values()]
        if cols:
            got += [(row["id"], v) for row in x.df.select("id", F.array(*[F.col(c).cast("string") for c in cols]).alias("vs")).collect() for v in row["vs"] if v is not None]
    assert sorted(got) == sorted(want)
    assert read(spark, docs, places=3)[0] == tree


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "record_id bigint, kind string, body string").write.parquet(f"{tmp_path}/report_raw.parquet")
    assert p3_found(spark, str(tmp_path)).collect() == []
