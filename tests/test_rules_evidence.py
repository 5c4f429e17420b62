"""Risk rules, flags, reasons to check on the target, detectors and value tracing, each on a few rows by hand."""

import pytest
from pyspark.sql import functions as F

from ripplemark.functions import text as X
from ripplemark.operators import detectors as D
from ripplemark.operators import evidence as V
from ripplemark.operators import flow
from ripplemark.operators import results
from ripplemark.operators import rules as R

SCHEMA = ", ".join(f"{n} {t}" for n, t in {"root": "string", **R.COLUMNS}.items())


def risks(spark, **kw):
    row = {"root": "r", "name": "n::f", "kind": "function", "change_kind": "modified", "file": "a.cc", "old_tokens": ["x"], "new_tokens": ["x"], "old_decl": ["int", "f", "(", ")"], "new_decl": ["int", "f", "(", ")"], **kw}
    df = spark.createDataFrame([tuple(row.get(n) for n in ("root", *R.COLUMNS))], SCHEMA)
    return {(r["risk_group"], r["sub_reason"]) for r in R.risk_rows(df).collect()}


LOCKS = "lock_guard l ( a ) lock_guard m ( b )".split()
CASES = [
    ({"file": "src/tests/a.cc", "new_tokens": ["new"]}, {("logic", "test_code")}),
    ({"is_log": True, "new_tokens": ["new"]}, {("logic", "logging")}),
    ({"kind": "file", "file": "CMakeLists.txt", "new_tokens": ["if"]}, {("build_config", "target")}),
    ({"kind": "macro"}, {("build_config", "macro")}),
    ({"conditions": ["defined(A)"]}, {("build_config", "macro")}),
    ({"directives": ["#include <a>"]}, {("logic", "")}),
    ({"directives": ["#define A"]}, {("build_config", "macro")}),
    ({"new_tokens": ["x", "assert"]}, {("build_config", "debug_release"), ("logic", "")}),
    ({"kind": "class", "old_bases": ["A"], "new_bases": ["B"]}, {("abi_layout", "member_change")}),
    ({"kind": "struct", "old_fields": [("a", "int"), ("b", "T*")], "new_fields": [("b", "T*"), ("a", "int")]}, {("abi_layout", "member_change"), ("ownership_lifetime", "raw_pointer")}),
    ({"kind": "struct", "old_fields": [("a", "int")], "new_fields": [("a", "std::mutex")]}, {("abi_layout", "member_change"), ("thread_safety", "mutex")}),
    ({"kind": "class", "old_virtuals": [], "new_virtuals": ["g() = 0"]}, {("abi_layout", "member_change")}),
    ({"kind": "enum", "new_tokens": ["x", "y"]}, {("abi_layout", "member_change")}),
    ({"new_decl": ["int", "f", "(", "T", "*", "p", ")"]}, {("abi_layout", "signature_change"), ("ownership_lifetime", "raw_pointer")}),
    ({"new_decl": ["int", "f", "(", "T", "&", "p", ")"]}, {("abi_layout", "signature_change"), ("ownership_lifetime", "reference")}),
    ({"new_decl": ["int", "f", "(", "const", "T", "&", "p", ")"]}, {("abi_layout", "signature_change")}),
    ({"new_decl": ["int", "f", "(", "T", "&&", "p", ")"]}, {("abi_layout", "signature_change"), ("ownership_lifetime", "reference"), ("ownership_lifetime", "move_semantics")}),
    ({"change_kind": "removed", "new_tokens": None, "new_decl": None}, {("abi_layout", "signature_change")}),
    ({"file": "a.h", "is_inline": True, "new_tokens": ["y"]}, {("abi_layout", "inline_change"), ("logic", "")}),
    ({"file": "a.h", "is_inline": False, "new_tokens": ["y"]}, {("abi_layout", "header_change"), ("logic", "")}),
    ({"new_tokens": ["x", "unique_ptr"]}, {("ownership_lifetime", "raw_pointer"), ("logic", "")}),
    ({"new_tokens": ["x", "QMutexLocker"]}, {("thread_safety", "mutex"), ("logic", "")}),
    ({"new_tokens": ["x", "memory_order_relaxed"]}, {("thread_safety", "atomic"), ("logic", "")}),
    ({"new_tokens": ["x", "pthread_cond_wait"]}, {("thread_safety", "mutex"), ("logic", "")}),
    ({"old_tokens": LOCKS, "new_tokens": [*LOCKS[5:], *LOCKS[:5]]}, {("thread_safety", "lock_order"), ("logic", "")}),
    ({"shapes": ["lock_removed"]}, {("thread_safety", "mutex")}),
    ({"old_noexcept": "noexcept", "new_noexcept": ""}, {("exception_safety", "noexcept_change")}),
    ({"new_tokens": ["x", "throw"]}, {("exception_safety", "throw_added"), ("logic", "")}),
    ({"shapes": ["removed_guard"], "new_tokens": ["x", "=="]}, {("logic", "removed_guard")}),
    ({"old_tokens": ["if", "if"], "new_tokens": ["if"]}, {("logic", "")}),
    ({"kind": "variable", "new_tokens": ["42"]}, {("logic", "")}),
    ({"kind": "variable", "new_tokens": ["x"]}, {("logic", "")}),
    ({"change_kind": "explicit"}, {("logic", "")}),
    ({"kind": None, "file": None, "old_tokens": None, "new_tokens": None, "old_decl": None, "new_decl": None, "change_kind": None}, {("logic", "")}),
]


@pytest.mark.parametrize("change,want", CASES)
def test_rules(spark, change, want):
    assert risks(spark, **change) == want


def test_foreign_calls(spark):
    rows = [("a", ["T", "*", "get", "(", ")"], "noexcept"), ("b", ["bool", "put", "(", "char", "*", "p", ",", "size_t", "n", ")"], None), ("c", ["void", "on", "(", "Callback", "cb", ")"], "noexcept"), ("d", ["void", "nop", "(", ")"], "noexcept")]
    df = spark.createDataFrame(rows, "root string, decl array<string>, nx string")
    f = R.callee_facts(F.col("decl"), F.col("nx"))
    calls = df.select("root", *[c.alias(n) for n, c in f.items()])
    got = {r["root"]: tuple(r)[1:] for r in calls.collect()}
    assert got == {"a": ("pointer", False, 0, 0, 0), "b": ("status", True, 1, 0, 1), "c": ("none", False, 0, 1, 0), "d": ("none", False, 0, 0, 0)}
    assert {r["root"]: r["risk_group"] for r in R.external_risk(calls).collect()} == {"a": "ownership_lifetime", "b": "exception_safety", "c": "thread_safety", "d": "logic"}


def flags(df):
    return sorted((r["root"], r["category"], r["detail"]) for r in df.collect())


def test_flags(spark):
    mk = spark.createDataFrame
    edges = mk([("t1", "u", "call"), ("t2", "u", "include"), ("t3", None, "call")], "dependency string, dependent string, relation string")
    roots = mk([(f"t{i}", "class", "modified", True, False) for i in (1, 2, 3)] + [("t4", "class", "removed", True, False), ("m1", "method", "modified", False, True), ("m2", "method", "modified", False, False), ("m3", "method", "modified", False, True)], "root string, kind string, change_kind string, is_template boolean, is_virtual boolean")
    assert [r[0] for r in flags(V.template_flags(roots, edges))] == ["t2", "t3"]
    groups = mk([("m2", "base"), ("m3", "other")], "method string, member string")
    assert [r[0] for r in flags(V.routing_flags(roots, groups, mk([("other",)], "callee string")))] == ["m1", "m2"]
    taken = mk([("m1", "b.cc", 3), ("m1", "a.cc", 9), ("t1", "a.cc", 1)], "root string, file string, line int")
    assert flags(V.address_flags(roots, taken)) == [("m1", "dynamic_runtime_dependency", "a.cc:9")]
    code = mk([("a", "function", ["x", "dlsym", "dlopen"], []), ("b", "class", ["dlopen"], []), ("c", "function", ["NDEBUG"], []), ("d", "function", ["x"], ["defined(A) && B > 1"]), ("e", "file", ["x"], ["C"])], "root string, kind string, tokens array<string>, conditions array<string>")
    assert flags(V.loading_flags(code)) == [("a", "dynamic_runtime_dependency", "dlopen, dlsym")]
    builds = mk([(1, ["B", "C"], "Debug"), (2, ["B"], "Debug")], "entry int, names array<string>, build string")
    assert flags(V.macro_flags(code, builds)) == [("c", "build_config_incomplete_macro", "NDEBUG"), ("d", "build_config_incomplete_macro", "A, B"), ("e", "build_config_incomplete_macro", "")]
    none = builds.limit(0)
    assert [r[0] for r in flags(V.macro_flags(code, none))] == ["c", "d", "e"]
    breaks = mk([("r", f"p{i}") for i in range(7)], "root string, place string")
    assert flags(V.break_flags(breaks)) == [("r", "dynamic_runtime_dependency", "p0; p1; p2; p3; p4 and 2 more")]
    kept = V.without_flagged(mk([("m1", "logic"), ("x", "logic")], "root string, risk_group string"), V.routing_flags(roots, groups, mk([], "callee string")))
    assert [r["root"] for r in kept.collect()] == ["x"]


def test_verify_by(spark):
    mk = spark.createDataFrame
    cases = mk([("1", "n", "thread_safety", "", ["r"]), ("2", "n", "logic", "", ["r"]), ("3", "q", "logic", "", ["s"]), ("4", "n", "logic", "logging", ["r"]), ("5", "f", "abi_layout", "signature_change", [])], "case string, node string, risk_group string, sub_reason string, roots array<string>")
    fl = mk([("f", "di_config_routing", "b"), ("f", "dynamic_runtime_dependency", "a"), ("q", "provider_unresolved", "a")], "root string, category string, ord string")
    lines = mk([("r", 4, "x = HAL_Read(y); // volatile"), ("r", 2, "// sleep(1)"), ("n", 1, 'sleep_for(t); htons(3);')], "node string, no int, text string")
    hits = V.target_hits(lines, ["node"])
    assert sorted(tuple(r) for r in hits.collect()) == [("n", "memory layout / byte order", "htons", 1), ("n", "timing", "sleep_for", 1), ("r", "hardware access", "HAL_Read", 4)]
    got = {r["case"]: (r["verify_by"], r["reasons"]) for r in V.verify_by(cases, fl, hits.where("node = 'r'"), hits.where("node = 'n'")).collect()}
    assert got["1"] == ("target", ["group: thread_safety", "changed: hardware access: HAL_Read", "memory layout / byte order: htons", "timing: sleep_for"])
    assert got["2"][1] == got["1"][1][1:] and got["3"] == ("review", []) and got["4"] == ("review", []) and got["5"] == ("target", ["flag: dynamic_runtime_dependency"])


ST = "usr string, cls string, file string, no int, kind string, name string, callee string, source string"
CODE = [
    ("f", "A", "a", 1, "lock", "mu", None, None), ("f", "A", "a", 2, "assign", "m_x", "make", "p"), ("f", "A", "a", 3, "guard", "g_on", None, None), ("f", "A", "a", 4, "assign", "g_out", "send", "m_x"),
    ("g", "A", "b", 1, "assign", "y", "make", "m_x"), ("h", "B", "c", 1, "assign", "y", "make", "m_x"), ("h", "B", "c", 2, "guard", "g_out", None, None), ("i", "B", "d", 1, "guard", "g_on", None, None), ("i", "B", "d", 2, "assign", "z", "send", "g_out"),
]


def test_detectors(spark):
    mk = spark.createDataFrame
    st, changed = mk(CODE, ST), mk([("f",)], "usr string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(D.lock_coupling(st, changed)) == [("f", "g_on", "i"), ("f", "m_x", "g")]
    cond = mk([("f", 3)], "usr string, no int")
    assert rows(D.conditional_write(st, cond)) == [("f", "g_out", "h"), ("f", "g_out", "i")]
    assert rows(D.class_consumer(st, changed)) == [("f", "m_x", "g")]
    assert rows(D.guard_removed_callee(st, cond)) == [("f", "send")]
    assert rows(D.trigger_sources(st, changed)) == [("send", "f", True, "present", 1, 2), ("send", "i", False, "present", 2, 2)]
    removed = mk([("r", "SetLimit", None), ("r", "set_size", None), ("q", "Mark", None), ("s", "SetLimit", "Q")], "root string, callee string, owner string")
    calls = mk([("u", "GetLimit", "P"), ("v", "get_size", None), ("w", "Limit", "Q"), ("x", "size", None)], "usr string, callee string, owner string")
    assert rows(D.setter_readers(removed, calls)) == [("r", "SetLimit", "u"), ("r", "SetLimit", "w"), ("r", "set_size", "v"), ("r", "set_size", "x"), ("s", "SetLimit", "w")]
    v = lambda n: mk([("c", "class", ["limit", "=", n, ";", "rest", "8"]), ("f", "function", ["limit", "=", n])], "usr string, kind string, tokens array<string>")
    assert rows(D.changed_defaults(v("3"), v("4"))) == [("c", "limit")]
    assert rows(D.readers_of(D.changed_defaults(v("3"), v("4")), mk([("f", "limit"), ("c", "limit")], "usr string, name string"))) == [("c", "limit", "f")]
    e = "usr string, name string"
    old, new = mk([("E", "RED"), ("E", "BLUE"), ("G", "X")], e), mk([("E", "RED"), ("E", "BLUE"), ("E", "GREEN"), ("N", "Z")], e)
    assert rows(D.new_enum_value(old, new, mk([("f", "RED"), ("g", "BLUE"), ("g", "GREEN"), ("h", "Z")], e))) == [("E", "GREEN", "f")]


def test_trace(spark):
    mk = spark.createDataFrame
    within = mk([("f|a", "f|b"), ("f|b", "f|c"), ("g|n", "g|t"), ("k|s", "k|z")], "src string, dst string")
    exits = mk([("f|c", "arg|g"), ("g|t", "store||g_s"), ("k|z", "arg|m"), ("f|b", "arg|nobody")], "node string, channel string")
    entries = mk([("arg|g", "g|n"), ("store||g_s", "k|s"), ("arg|m", "m|n")], "channel string, node string")
    reached, lost = flow.trace(within, exits, entries, mk([("f", "f|a")], "root string, node string"), 2)
    assert sorted((r["node"], r["depth"]) for r in reached.collect()) == [("f|a", 0), ("f|b", 0), ("f|c", 0), ("g|n", 1), ("g|t", 1), ("k|s", 2), ("k|z", 2)]
    assert sorted((r["channel"], r["why"]) for r in lost.collect()) == [("arg|m", "depth limit"), ("arg|nobody", "no one takes it")]
    calls = mk([("k|z", "k", "publishAll", True), ("f|a", "f", "publishAll", True), ("g|t", "g", "log", False)], "node string, usr string, callee string, emits boolean")
    assert [tuple(r) for r in flow.emitted(reached, calls).collect()] == [("f", "k", "publishAll", 2)]


def test_emitters_logging_and_lessons(spark):
    names = spark.createDataFrame([("std::send", False), ("a::sendAll", False), ("logSend", True), ("do_it", True), ("plain", False), ("my::sink1", False)], "n string, third boolean")
    got = [r[0] for r in names.select(flow.is_emitter(F.col("n"), F.col("third"), ["sink*"])).collect()]
    assert got == [False, True, False, True, False, True]
    texts = [(['LOG(x) << "a"', '  << "b";', "// c"], True), (["LOG(x);", "y = 1;"], False), ([], False), (["", "  "], False), (["LOG(a", "b);", "}"], True), (["LOG(a", "if (b) {"], False)]
    df = spark.createDataFrame(texts, "lines array<string>, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", X.log_only(F.col("lines"), r"^\s*LOG\(")).collect())
    rows = spark.createDataFrame([("a::Queue::push", "src/a.cc", ["x"], ""), ("b", "src/b.h", ["while"], "signature_change")], "name string, file string, tokens array<string>, sub_reason string")
    ls = [results.Lesson("q", name_glob="*Queue::*"), results.Lesson("p", name_glob="push"), results.Lesson("w", tokens_any=("while",), path_glob="*.h", sub_reason="signature_change"), results.Lesson("no", path_glob="lib/*")]
    assert sorted((r["name"], r["lesson"]) for r in results.match_lessons(rows, ls).collect()) == [("a::Queue::push", "p"), ("a::Queue::push", "q"), ("b", "w")]
    assert results.match_lessons(rows, []).count() == 0


def test_totals(spark):
    u = spark.createDataFrame([("a", 3, None, 2, 0.5), ("a", None, 4, None, None)], "run string, input_tokens bigint, cached_tokens bigint, output_tokens bigint, cost double")
    assert [tuple(r) for r in results.usage_totals(u, ["run"]).collect()] == [("a", 2, 7, 2, 0.5)]
    r = spark.createDataFrame([("a", "pass", None, 3), ("a", " ", True, None), ("a", None, False, 1), ("b", "pass", None, None), ("a", "??", None, None)], "run string, verdict string, needs_recheck boolean, bytes bigint")
    assert sorted(tuple(x) for x in results.summarise(r, ["run"], ["pass"]).collect()) == [("a", 1, 2, 1, 1, 4, False, 4), ("b", 1, 0, 0, 0, 1, True, 0)]


def test_literals_and_labels(spark):
    rows = [("0x1F", 31), ("-12", -12), ("1'000u", 1000), ("010", 8), ("0b101", 5), ("0", 0), ("9223372036854775808", None), ("0xFFFFFFFFFFFFFFFFF", None), ("12UL", 12), ("x", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want bigint")
    assert [(r[0], r[1]) for r in df.select("t", X.integer(F.col("t"))).collect()] == rows
    labels = [("TEST_F(Suite, doesIt) {", "Suite.doesIt"), ("TEST(\n  A,\n  b)", "A.b"), ("LATEST(a, b)", None)]
    df = spark.createDataFrame(labels, "t string, want string")
    assert [(r[0], r[1]) for r in df.select("t", X.test_label(F.col("t"))).collect()] == labels
