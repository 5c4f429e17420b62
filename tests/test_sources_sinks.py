import json
import subprocess

import pytest

from ripplemark.operators.graph import resolve_includes
from ripplemark.sinks import report
from ripplemark.sources import build, gitscan, settings


@pytest.fixture
def repo(tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.cc").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.h").write_text("x\n")
    git("add", ".")
    git("commit", "-qm", "begin")
    (tmp_path / "a.cc").write_text("one\n2\nthree\nfour\n")
    (tmp_path / "b.h").unlink()
    git("add", "-A")
    git("commit", "-qm", "fix the crash")
    (tmp_path / "a.cc").write_text("one\n2\nthree\n")
    (tmp_path / "new.cc").write_text("n1\nn2\n")
    return str(tmp_path)


def rows(df):
    return sorted(tuple(r) for r in df.select("path", "side", "line", "text").collect())


def test_git(spark, repo):
    assert rows(gitscan.diff(spark, repo, "HEAD~1", "HEAD")) == [("a.cc", "new", 2, "2"), ("a.cc", "new", 4, "four"), ("a.cc", "old", 2, "two"), ("b.h", "old", 1, "x")]
    assert rows(gitscan.working_tree(spark, repo)) == [("a.cc", "old", 4, "four"), ("new.cc", "new", 1, "n1"), ("new.cc", "new", 2, "n2")]
    assert gitscan.show(repo, "HEAD~1", "b.h") == "x\n" and gitscan.show(repo, "HEAD", "b.h") is None
    assert {r["file"]: r["fixes"] for r in gitscan.fix_history(spark, repo).collect()} == {"a.cc": 1, "b.h": 1}
    with pytest.raises(ValueError):
        gitscan.diff(spark, repo, "nowhere", "HEAD")


def test_compile_commands(spark, tmp_path):
    entries = [
        {"directory": "/b", "file": "x.cc", "command": "g++ -DNDEBUG -D A=1 -Iinc -o x.o -MD -MF x.d -c x.cc"},
        {"directory": "/b", "file": "x.cc", "command": "g++ -DSECOND -c x.cc"},
        {"directory": "/b", "file": "/s/y.cc", "arguments": ["cc", "-O1", "-c", "/s/y.cc"]},
    ]
    (tmp_path / "c.json").write_text(json.dumps(entries))
    c = build.compile_commands(spark, str(tmp_path / "c.json"))
    assert {r["file"]: r["args"] for r in c.collect()} == {"/b/x.cc": ["-DNDEBUG", "-D", "A=1", "-Iinc"], "/s/y.cc": ["-O1"]}
    assert sorted(map(tuple, build.defines(c).collect())) == [("/b/x.cc", "A", "1"), ("/b/x.cc", "NDEBUG", None)]
    assert {r["config"] for r in build.configurations(c).collect()} == {"Release", "Debug"}
    (tmp_path / "CMakeLists.txt").write_text("")
    assert not build.is_stale(str(tmp_path / "c.json"), str(tmp_path), slack=3600)
    assert build.is_stale(str(tmp_path / "c.json"), str(tmp_path), slack=-3600)


def test_target_model(spark, tmp_path):
    put = lambda n, x: (tmp_path / n).write_text(json.dumps(x))
    put("index-1.json", {"objects": [{"kind": "codemodel", "jsonFile": "m.json"}]})
    put("m.json", {"configurations": [{"targets": [{"jsonFile": "t1.json"}, {"jsonFile": "t2.json"}]}]})
    put("t1.json", {"id": "i1", "name": "lib", "type": "STATIC_LIBRARY", "sources": [{"path": "l.cc"}]})
    put("t2.json", {"id": "i2", "name": "app", "type": "EXECUTABLE", "sources": [{"path": "m.cc"}], "dependencies": [{"id": "i1"}]})
    t, s, n = build.target_model(spark, str(tmp_path))
    assert {r["name"] for r in t.collect()} == {"lib", "app"}
    assert sorted(map(tuple, s.collect())) == [("app", "m.cc"), ("lib", "l.cc")]
    assert [tuple(r) for r in n.collect()] == [("app", "lib")]


def test_includes(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.cc").write_text('#include "a.h"\n # include <x/b.h>\nint i;\n')
    got = build.includes(build.source_files(spark, str(tmp_path)))
    assert {r["wanted"] for r in got.collect()} == {"a.h", "x/b.h"}
    inc = spark.createDataFrame([("p/q/f.cc", "a.h"), ("p/q/f.cc", "b.h"), ("r/f.cc", "a.h"), ("r/f.cc", "zz.h")], "file string, wanted string")
    files = spark.createDataFrame([("p/q/a.h",), ("x/a.h",), ("long/way/b.h",), ("b.h",)], "path string")
    assert {(r["file"], r["wanted"]): r["found"] for r in resolve_includes(inc, files).collect()} == {("p/q/f.cc", "a.h"): "p/q/a.h", ("p/q/f.cc", "b.h"): "b.h", ("r/f.cc", "a.h"): "x/a.h"}


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"max_hop": 3, "test_globs": ["*_mock.h"]}')
    assert settings.load(str(f), max_hop=4).max_hop == 4 and settings.load(str(f)).test_globs == ("*_mock.h",)
    for bad in ('{"nope": 1}', '{"max_hop": "2"}', '{"max_hop": true}'):
        f.write_text(bad)
        with pytest.raises(ValueError):
            settings.load(str(f))
    assert settings.symbol_list("a::b, c ,a::b") == ["a::b", "c"] and settings.symbol_list('["x"]') == ["x"]
    for bad in ("a.cc", "x/y", "", "[]"):
        with pytest.raises(ValueError):
            settings.symbol_list(bad)
    f.write_text('[{"id": "1", "title": "t", "ask": "q", "name_glob": "*"}]')
    assert len(settings.lessons(str(f))) == 1
    f.write_text('[{"id": "1", "title": "t", "ask": "q"}]')
    with pytest.raises(ValueError):
        settings.lessons(str(f))
    f.write_text('{"bus": "("}')
    with pytest.raises(ValueError):
        settings.patterns(str(f))


def test_pages(spark, tmp_path):
    c = spark.createDataFrame([(1, "TC-0001", "P1", "a<b>", 0, "logic", ""), (2, "TC-0002", "P2", "c|d", 1, "abi_layout", "x")], "rank int, id string, priority string, node string, hop int, risk_group string, sub_reason string")
    assert "P1: 1, P2: 1" in report.markdown(c) and "c\\|d" in report.markdown(c)
    assert report.brief(c).count("\n") == 2
    out = report.write_pages(c, str(tmp_path), results={"k": {"verdict": "</script>"}})
    assert len(out) == 4
    text = (tmp_path / "cases.html").read_text()
    assert report.read_results(text) == {"k": {"verdict": "</script>"}} and "a&lt;b&gt;" in text
    report.write_pages(c, str(tmp_path), ("html",))
    assert (tmp_path / "cases.html.bak").exists()
    with pytest.raises(ValueError):
        report.read_results("<html>")
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "node string, hop int")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "a")], "dependency string, dependent string")
    assert report.mermaid(nodes, edges).count("-->") == 1


def test_cached(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    k = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    for key in (k, k.orderBy("x", ascending=False), k.union(k)):
        assert report.cached(spark, str(tmp_path), key, make).count() == 3
    assert len(made) == 2
