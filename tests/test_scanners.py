import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ripplemark.functions import scanners as Z
from ripplemark.functions import text as X
from ripplemark.operators import changes, flow


def test_mask():
    assert Z.mask_literals('a = "x{y\\"z"; c = \'}\'; n = 1\'000;') == 'a = "      "; c = \' \'; n = 1\'000;'
    assert Z.mask_literals('"open\nnext') == '"    \nnext'


def test_template_args():
    assert Z.strip_template_args("std::map<int, list<x>> f(a<b>) p->q") == "std::map f(a) p->q"
    assert Z.strip_template_args("a < b;") == "a < b;" and Z.strip_template_args("a < b > c") == "a < b > c"


CODE = """namespace n {
// void no() {
class C : public B {
  int f(int x) const { return x; }
  std::map<int, int> g(const std::string& s)
  {
    if (s == "}") {
      h();
    }
  }
  int v = 3;
};
void C::late(int a,
             int b) noexcept {
  for (;;) { }
}
}
static int open() {
""".split("\n")


def test_functions():
    assert Z.functions_of(CODE) == [("f", 4, 4), ("g", 5, 10), ("C::late", 13, 16), ("open", 18, 19)]
    assert Z.functions_of([]) == [] and Z.functions_of(["}}}", "{{"]) == []


def test_conditions():
    lines = "#ifndef G_H\n#define G_H\nx\n#ifdef A\ny\n#if B > 1\nz\n#else\nw\n#endif\n#elif C\nq\n#endif\n#endif\nr".split("\n")
    c = Z.conditions_of(lines)
    assert c[2] == [] and c[4] == ["defined(A)"] and c[6] == ["defined(A)", "B > 1"] and c[8] == ["defined(A)", "B > 1 / else"] and c[11][-1].endswith("C") and c[14] == []
    assert Z.conditions_of(["#endif", "#else", "a"]) == [[], [], []]


def test_guard_scope():
    lines = "if (a) return;\nif (b) {\n  x(\"}\");\n  { y(); }\n}\nif (c)\n  z();\nif (d)\n{\n  continue;\n}\nif (e) {".split("\n")
    assert Z.guard_scope(lines, 1) == (1, None)
    assert Z.guard_scope(lines, 2) == (2, 5)
    assert Z.guard_scope(lines, 6) == (6, 7)
    assert Z.guard_scope(lines, 8) == (8, None)
    assert Z.guard_scope(lines, 12) == (12, 12)


def toks(s):
    return Z._TOKENS.findall(s)


def test_signatures():
    assert Z.parameters(toks("int f(map<int, int> m, char *s, int n)"))[0] == ["map", "<", "int", ",", "int", ">", "m"]
    assert Z.passes_by(toks("void f(T *p, const T &c, T &r, int n)")) == (1, 1)
    assert Z.input_classes(toks("void f(bool b, char *s, std::string t, unsigned u, int n)")) == ["b: both values", "s: no object, no text, long text", "t: none, one, many", "u: zero, one, largest"]
    assert Z.input_classes(["int", "x"]) == [] and Z.parameters(toks("void f()")) == []


@pytest.mark.parametrize(
    "old,new,kinds",
    [
        (["if (a < b) x();"], ["if (a <= b) x();"], ["operator_flip"]),
        (["if (a && b) x();"], ["if (a || b) x();"], ["logical_flip"]),
        (["y = a && b;"], ["y = a || b;"], ["logical_flip"]),
        (["n = 30;"], ["n = 40;"], ["constant_change"]),
        (["return ok;"], ["return bad;"], ["return_change"]),
        (["x = ready(p);"], ["x = !ready(p);"], ["negation_flip"]),
        (["if (p && q) use(p);"], ["if (p) use(p);"], ["removed_guard"]),
        (["if (p) {", "use(p);", "}"], ["use(p);"], ["removed_guard"]),
        (["std::lock_guard<std::mutex> l(m);", "n = 1;"], ["n = 1;"], ["lock_removed"]),
        (["n = 1;"], ["std::lock_guard<std::mutex> l(m);", "n = 1;"], ["lock_added"]),
        (["first();", "second();", "third();"], ["second();", "third();", "first();"], ["reorder"]),
        (["count += 1;", "go();"], ["go();"], ["removed_assignment"]),
        (["notify(x);", "go();"], ["go();"], ["removed_call"]),
        (["limit = small(1);"], ["limit = large(2, 3);"], ["value_change"]),
        (["a();"], ["a();  // why"], []),
        ([], [], []),
    ],
)
def test_edit_shapes(old, new, kinds):
    assert [k for k, _, _ in Z.edit_shapes(old, new)] == kinds


def test_edit_shapes_are_few_and_fast():
    old = [f"x{i} = {i};" for i in range(600)]
    assert len(Z.edit_shapes(old, [x.replace("=", "+=") for x in old])) <= Z.MOST


def test_diff_by_hand(spark):
    text = "hello\n--- a/p.cc\n+++ b/p.cc\n@@ -3,2 +3,2 @@ f\n keep\n-old\r\n+new\n+more\n@@ -9 +10 @@\n-- dashed\n\nplain\n+ not in a hunk\n--- a/q.cc\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n+nowhere"
    lines = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(text.split("\n"))], "file bigint, no int, text string")
    got = sorted((r["path"], r["side"], r["line"], r["text"]) for r in X.parse_diff(lines).collect())
    assert got == [("p.cc", "new", 4, "new"), ("p.cc", "new", 5, "more"), ("p.cc", "old", 4, "old"), ("p.cc", "old", 9, "- dashed"), ("q.cc", "old", 1, "gone")]


def test_taint_reads_twice(spark):
    defs = spark.createDataFrame([(1, 1, 2, "a", "src"), (1, 1, 3, "b", "c"), (1, 1, 4, "c", "a"), (1, 9, 10, "a2", "q")], "file bigint, fn int, no int, target string, source string")
    hot = spark.createDataFrame([(1, 2)], "file bigint, no int")
    assert sorted(map(tuple, flow.taint(defs, hot).collect())) == [(1, 1, "a"), (1, 1, "b"), (1, 1, "c")]
    assert flow.taint(defs, hot.limit(0)).collect() == []


def test_innermost_against_brute_force(spark):
    r = random.Random(2)
    ext = [(f"f{r.randint(0, 3)}", f"u{i}", a, a + r.choice([0, 3, 50, 700])) for i in range(80) for a in [r.randint(1, 900)]]
    pts = [(i, r.choice(["f0", "f1", "f9", None]), r.choice([None, r.randint(1, 1500)])) for i in range(300)]
    got = {x["id"]: x["usr"] for x in changes.innermost(spark.createDataFrame(pts, "id int, file string, line int"), spark.createDataFrame(ext, "file string, usr string, start_line int, end_line int")).collect()}
    for i, f, n in pts:
        inside = [(b - a, u) for g, u, a, b in ext if g == f and n is not None and a <= n <= b]
        assert got[i] == (min(inside)[1] if inside else None)
    left = {x["id"] for x in changes.residual(spark.createDataFrame(pts, "id int, file string, line int"), spark.createDataFrame(ext, "file string, usr string, start_line int, end_line int")).collect()}
    assert left == {i for i, *_ in pts if got[i] is None}


def test_bag_delta(spark):
    a, b = ["x", "x", "y"], ["x", "z", "z"]
    add, rem = changes.bag_delta(F.col("a"), F.col("b"))
    r = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(add.alias("add"), rem.alias("rem")).first()
    assert r["add"] == sorted((Counter(b) - Counter(a)).elements()) and r["rem"] == sorted((Counter(a) - Counter(b)).elements())


def test_boundaries_beyond_the_range(spark):
    df = spark.createDataFrame([(1, 1, "if (a.b >= 7 && c == 99999999999999999999) x < -3")], "file bigint, no int, text string")
    assert sorted((r["var"], r["below"], r["value"], r["above"]) for r in X.boundaries(df).collect()) == [("a.b", 6, 7, 8), ("x", -4, -3, -2)]


def test_globs():
    import re

    assert re.search(X.glob_regex("*::a?.h"), "x::ab.h") and not re.search(X.glob_regex("a.h"), "axh")
