from pyspark.sql import functions as F

from ripplemark.operators import graph as G
from ripplemark.operators import patterns as P

V = "usr string, file string, tokens array<string>"


def facts(spark, rows):
    return P.token_facts(spark.createDataFrame(rows, V))


def test_roles(spark):
    f = facts(spark, [("u", "f", ["m", "=", "get", "(", "k", ")", ";", "return", "ok", ";", "if", "2"]), ("v", "f", []), ("w", None, None)])
    assert sorted((r["at"], r["name"], r["role"]) for r in f.collect()) == [(0, "m", "write"), (2, "get", "call"), (4, "k", "read"), (8, "ok", "return")]


def test_newly_and_readers(spark):
    old = facts(spark, [("u", "d/a.cc", ["x", "=", "1"])])
    new = facts(spark, [("u", "d/a.cc", ["x", "=", "1", "y", "=", "2", "z", "=", "3", "y", "=", "4"])])
    n = P.newly(new, old, "write", 1)
    assert [tuple(r) for r in n.collect()] == [("u", "y")]
    assert P.newly(old, new, "write").collect() == []
    every = facts(spark, [("u", "d/a.cc", ["y"]), ("r3", "e/z.cc", ["y"]), ("r2", "d/q.cc", ["y", ";"]), ("r1", "d/a.cc", ["return", "y"]), ("w", "d/a.cc", ["y", "=", "1"]), ("r0", "e/z.cc", ["y"])])
    w = n.withColumn("file", F.lit("d/a.cc"))
    assert [r["reader"] for r in P.readers(every, w, 3).orderBy(F.col("reader").desc()).collect()] == ["r2", "r1", "r0"]
    assert P.readers(every, w.limit(0)).collect() == []


def test_siblings(spark):
    src = [("t", f"s{i:02}") for i in range(11)] + [("many", f"m{i:02}") for i in range(20)] + [("few", "a"), ("few", "b"), ("none", "x")]
    cov = [("t", "s00"), ("many", "m00"), ("few", "a")]
    got = {}
    for r in P.sibling_sources(spark.createDataFrame(src, "target string, source string"), spark.createDataFrame(cov, "target string, source string")).collect():
        got.setdefault(r["target"], []).append((r["source"], r["others"]))
    assert got["few"] == [("b", None)] and got["many"] == [(None, 19)]
    assert sorted(got["t"], key=str) == sorted([(f"s{i:02}", None) for i in range(1, 9)] + [(None, 2)], key=str) and "none" not in got


def test_accessors_are_looked_through(spark):
    calls = [("get", "fwd"), ("fwd", "fwd2"), ("fwd2", "user"), ("get", "direct"), ("fwd", "fwd"), ("get", "get")]
    acc = [("get",), ("fwd",), ("fwd2",)]
    got = {(r["start"], r["caller"]) for r in P.accessor_callers(spark.createDataFrame(calls, "callee string, caller string"), spark.createDataFrame(acc, "id string")).collect()}
    assert got == {("get", "direct"), ("get", "user"), ("fwd", "user"), ("fwd2", "user")}


def test_same_code(spark):
    long = "  if (first(value) == second(value)) {"
    removed = spark.createDataFrame([(1, 5, long), (1, 6, "short()"), (1, 7, "// words only words only words only")], "file bigint, line int, text string")
    lines = spark.createDataFrame([(1, 5, long), (3, 9, long + "\r"), (2, 4, long), (2, 8, long)], "file bigint, no int, text string")
    assert [(r["file"], r["o_file"], r["o_no"]) for r in P.same_code(removed, lines).collect()] == [(1, 2, 4)]


def test_definition_in_the_source_of_the_same_stem(spark):
    decls = spark.createDataFrame([("u", "a::f", "inc/x.h"), ("v", "a::g", "inc/x.h"), ("w", "a::f", "src/x.cc")], "usr string, name string, file string")
    s = spark.createDataFrame([("a::f", "src/x.cc", 9, True), ("a::f", "src/x.cc", 4, True), ("a::f", "src/y.cc", 1, True), ("a::g", "src/x.cc", 2, False)], "name string, file string, line int, is_def boolean")
    assert [tuple(r) for r in P.definition_sites(decls, s).collect()] == [("u", "src/x.cc", 4)]


def test_choice_of_definitions(spark):
    s = spark.createDataFrame([("i1", "n::f", "f", "a.cc", 10), ("i2", "m::f", "f", "a.cc", 12), ("i3", "n::f", "f", "b.cc", 90), ("i4", "n::g", "g", "c.cc", 1), ("i5", "n::h", "h", "d.cc", 1), ("i6", "o::h", "h", "e.cc", 1)], "id string, name string, spelling string, file string, line int")
    refs = spark.createDataFrame([("near", "x::f", "a.cc", 11), ("name", "n::f", "z.cc", 1), ("file", "q::f", "b.cc", 1), ("only", "q::g", "z.cc", 1), ("lost", "q::h", "z.cc", 1), ("never", "q::k", "z.cc", 1)], "ref string, name string, file string, line int")
    got = {}
    for r in G.choose_definition(refs, s).collect():
        got.setdefault(r["ref"], set()).add((r["id"], r["tier"]))
    assert got == {"near": {("i1", 0)}, "name": {("i1", 1), ("i3", 1)}, "file": {("i3", 2)}, "only": {("i4", 3)}}


def test_resolution_falls_back_to_suffixes(spark):
    s = spark.createDataFrame([("1", "a::b::f"), ("2", "f"), ("3", "x::f"), ("4", "b::g"), ("5", "c::b::g")], "id string, name string")
    w = spark.createDataFrame([("f",), ("b::g",), ("g",), ("b::f",), ("nope",)], "want string")
    got = {}
    for r in G.resolve_symbols(w, s).collect():
        got.setdefault(r["want"], set()).add(r["id"])
    assert got == {"f": {"2"}, "b::g": {"4"}, "g": {"4", "5"}, "b::f": {"1"}, "nope": {None}}


def test_entry_points(spark):
    calls = spark.createDataFrame([("s", "a"), ("a", "main"), ("s", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "s")], "callee string, caller string")
    starts = spark.createDataFrame([("s",), ("alone",)], "start string")
    assert {r["start"]: (r["entries"], r["more"]) for r in G.entry_points(calls, starts, 3, 2).collect()} == {"s": (["d", "main"], 0)}


def test_targets(spark):
    deps = spark.createDataFrame([("app", "lib"), ("lib", "core"), ("tool", "core"), ("core", "lib")], "target string, needs string")
    touched = spark.createDataFrame([("lib",), ("lib",)], "target string")
    assert {r["target"]: r["via"] for r in G.affected_targets(touched, deps).collect()} == {"lib": None, "app": "lib", "core": "lib", "tool": "lib"}
