import duckdb
import pytest

from ripplemark.llm import quality as Q
from ripplemark.llm import queries

COMMON = {"en": set("a the of and is in it to was when that for not so but with on we they this".split()), "de": set("der die das und ist nicht ein wenn wird von".split()), "vi": set("là và của không một có được trong".split())}
PROSE = "The lock was taken in the wrong order, so that the thread that waits for it is not woken when the timer fires. "


@pytest.fixture(scope="module")
def reader():
    return Q.Reader(COMMON)


@pytest.mark.parametrize(
    "text",
    [
        PROSE * 3,
        PROSE,
        PROSE.lower().replace(".", "").replace(",", ""),
        "The lock was taken in the\nwrong order, so that the\nthread that waits for it is\nnot woken when the timer\nfires and we see it.",
        "> The lock was taken in the wrong order, so that the\n> thread that waits for it is not woken when the timer\n> fires in the pool.",
        "<p>The lock <b>was</b> taken in the wrong order,<br/>so that the thread that waits is not woken.</p>",
        "- The lock was taken in the wrong order, so that the thread that waits for it is not woken.\n- We saw that this is not the case when the timer fires twice in a row, which was odd.",
        "Wenn der Ringpuffer voll ist, wird die Sperre nicht von der Schleife gehalten und das Ende ist offen.",
        PROSE + "\n\n- one\n- two\n- three",
    ],
)
def test_prose(reader, text):
    assert reader.no_prose(text) < 0.6


@pytest.mark.parametrize(
    "text",
    [
        "- one thing\n- two things\n- a third\n- the rest",
        "1) foo;\n2) bar of baz;\n3) qux;\n4) when it stops;",
        "alpha()\nbeta gamma\nsrc/a/b.cc\nwhen the pool is cold\ndelta\nall of the users",
        "a,b,c\n1,2,3\n4,5,6\n7,8,9",
        "| a | b |\n|---|---|\n| 1 | 2 |",
        "hop   rank   file\n12    open   src/a.cc\n7     fail   src/b.cc",
        "int f(int n) {\n  if (n == 3) return 0;\n  x = g(n);\n}\n",
        "2025-01-01 00:00:00 WARN [Pool] x=1 rc=3\n2025-01-01 00:00:01 INFO [Pool] y=2 rc=0",
        "=====\n-----\n*****",
        "kqwsf lzvsj dvlvq wcdl jlsds flzvw ljqj ldxs wjxf lvl wlj kfdzj dxdl",
        "one two three; four five; six; seven eight; nine; ten eleven; twelve",
        '{\n  "a": {\n    "file": "x/y.h",\n    "rank": 3\n  }\n}',
    ],
)
def test_no_prose(reader, text):
    assert reader.no_prose(text) >= Q.NO_PROSE


def test_repetition_by_hand():
    lines, paragraphs, top, dup, _ = Q.repetition("a b c\na b c\n\nx y z")
    assert lines == pytest.approx(5 / 15)
    assert paragraphs == 0
    assert top == pytest.approx(6 / 9)
    assert dup == pytest.approx(6 / 9)
    assert Q.repetition("p q\n\np q\r\n\r\nr") [1] == pytest.approx(3 / 7)
    assert Q.repetition("one") == (0, 0, 0, 0, 0)


def test_null_empty_and_long(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, PROSE), (5, "when it is so " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in Q.measure(df, COMMON).collect()}
    assert len(got) == 5
    assert got[1]["no_prose"] is None and got[2]["no_prose"] is None and got[3]["top_gram"] is None
    assert got[4]["no_prose"] < 0.5 and got[5]["no_prose"] > 0.9
    assert Q.measure(spark.createDataFrame([], "doc_id bigint, text string"), COMMON).collect() == []
    assert Q.measure(df, {}).count() == 5


def test_basic_against_sql(spark, tmp_path):
    from oracle import canon

    rows = [(1, None), (2, ""), (3, " \n"), (4, "The end is  near.\nor not, the\r\n\n 'so' - x!"), (5, "é — x"), (6, PROSE)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("en", "the"), ("en", "is"), (None, "x"), ("de", "So")], "lang string, word string").write.parquet(f"{tmp_path}/common_word.parquet")
    df = queries.p8_basic(spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("documents", "common_word"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'" + (" where lang is not null" if t == "common_word" else ""))
    cur = c.execute(queries.ORACLE["p8_basic"])
    want, names = cur.fetchall(), [x[0] for x in cur.description]
    assert canon(df.collect(), df.columns) == canon(want, names)


def test_paragraphs_repeated_without_end():
    prose = "The worker takes the lock before it reads the queue, and lets go of it once the last frame has been handed over to the sender. "
    long = prose + "Nobody else may touch the buffer in the meantime, which is why the timer waits for as long as it does. "
    reader = Q.Reader({"en": {"the", "of", "it", "in", "for", "as", "is", "has"}})

    def share(t):
        return Q.combined(reader.no_prose(t), *Q.repetition(t))

    assert share(long) < 0.3 and share(long * 2) < Q.NO_PROSE
    for t in (long * 40, (prose + "\n") * 30, (long + "\n\n") * 30):
        assert share(t) >= Q.NO_PROSE
