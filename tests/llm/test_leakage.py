import html
import json
import random
import unicodedata

from ripplemark.llm import leakage as L

WORDS = "alpha bravo carbon delta ember fjord garnet harbor indigo juniper kelp lumen marble nickel onyx pewter quartz raven saffron tundra umber violet willow xenon yarrow zephyr".split()


def passage(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS)[:3] + str(r.randint(1, 99)) for _ in range(n))


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i, **kw).collect()}


def cut(text, a, b):
    return " ".join(text.split()[a:b])


def altered(text, seed):
    """One word in six of it replaced, dropped, cut or with another beside it."""
    r = random.Random(seed)
    w = text.split()
    for at in range(r.randint(0, 5), len(w), 6):
        w[at] = r.choice(["other", "", w[at][: len(w[at]) // 2], w[at] + " also"])
    return " ".join(x for x in w if x)


def test_forms(spark):
    items = [passage(s) for s in range(6)]
    part = cut(items[2], 10, 32)
    docs = [
        f"before {part} after",
        part.upper(),
        part.replace(" ", "\n\n"),
        json.dumps({"note": "Prüfung " + part.replace(" ", "\n")}),
        "<p>" + " ".join(f"<b>{html.escape(w)}</b>&nbsp;" for w in part.split()) + "</p>",
        " ".join(f"**{w}**," for w in part.split()),
        unicodedata.normalize("NFD", part) + "­",
        "".join(c + "​" for c in part),
        "> " + part.replace(" ", "\n> "),
        cut(items[2], 10, 17),
        "nothing of the kind",
        None,
        "",
        " \n ",
    ]
    assert found(spark, docs, items) == {(i, 2) for i in range(9)}
    assert found(spark, docs, items, block=700) == {(i, 2) for i in range(9)}


def test_altered_and_short(spark):
    items = [passage(s) for s in range(30)]
    docs = [altered(cut(items[k], k % 30, k % 30 + 21), k) for k in range(30)]
    docs += [cut(items[k], k, k + 7) + " and " + cut(items[(k + 1) % 30], 3, 10) for k in range(30)]
    assert found(spark, docs, items) == {(k, k) for k in range(30)}


def test_set_phrases_and_twins(spark):
    phrase = passage(77, 14)
    items = [passage(1, 30) + " " + phrase, passage(2, 30) + " " + phrase, phrase + " " + passage(3, 30)]
    assert found(spark, [f"x {phrase} y"], items) == set()
    twin = passage(5, 50)
    assert found(spark, [cut(twin, 5, 30)], [twin, twin + " more", passage(6)]) == {(0, 0), (0, 1)}


def test_brute_force_of_hits():
    r = random.Random(3)
    short = " ".join(r.choice("a an of to in it is we on by the and for".split()) for _ in range(400))
    s = L.Search([*((k, passage(k)) for k in range(5)), (5, cut(short, 40, 90))])
    ls = L.Letters([" ".join(passage(k)[: 80 + k] for k in (3, 1, 9)) + " tail", short, "", passage(2)])
    at, kind, string = s.hits(ls)
    got = {(p, w) for p, k, x in zip(at.tolist(), kind.tolist(), string.tolist()) for w in s.strings[k].of(x).tolist()}
    raw, src, want = ls.c.tobytes(), s.items.c.tobytes(), set()
    for ws, ns in ((s.items.long(), None), s.items.short()):
        for i, w in enumerate(ws.tolist()):
            n = L.WINDOW if ns is None else int(ns[i])
            assert L.SHORT <= n <= L.WINDOW
            p = src[s.items.at[w] :][:n]
            want |= {(x, w) for x in range(len(raw)) if raw.startswith(p, x) and (ns is None or (ls.edge[x] and ls.edge[x + n]))}
    assert len(want) > 100 and got == want


def test_copies_of_an_item(spark):
    text, other = passage(4, 40), passage(9, 40)
    for n in (9, 50, 1000):
        items = [text] * n + [other, text.upper()]
        assert found(spark, [cut(text, 5, 30), cut(other, 5, 30)], items) == {(0, k) for k in (*range(n), n + 1)} | {(1, n)}
    near = [cut(text, 0, 20) + f" {passage(100 + k, 5)} " + cut(text, 20, 40) for k in range(40)]  # one passage in all, other ends
    assert found(spark, [cut(text, 0, 20)], near) == {(0, k) for k in range(40)}


def test_blocks_change_nothing(spark):
    phrase = passage(77, 12)
    items = [passage(k, 30) + " " + phrase for k in range(8)] + [passage(50, 45)] * 3
    docs = [phrase, cut(items[3], 4, 26), cut(items[9], 20, 42), cut(items[1], 25, 42)]
    want = found(spark, docs, items)
    assert want == {(1, 3), (2, 8), (2, 9), (2, 10)} | {x for x in want if x[0] == 3}
    for block in (1, 700, 2000):
        assert found(spark, docs, items, block=block) == want


def test_recall_by_word_length():
    """Twenty words of which each sixth is replaced are found whatever the length of the words."""
    r = random.Random(11)
    for lo, hi in ((1, 3), (2, 4), (3, 6), (5, 11)):
        items = [(k, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(lo, hi))) for _ in range(40))) for k in range(50)]
        s, texts = L.Search(items), []
        for k, text in items:
            for off in range(2, 6):
                part = text.split()[k % 20 : k % 20 + 20]
                part[off::6] = ["other"] * len(part[off::6])
                texts.append("before " + " ".join(part) + " after")
        hit = {(x, k) for x, k, *_ in s.leaks(texts)}
        assert sum((x, x // 4) in hit for x in range(len(texts))) >= 0.97 * len(texts), (lo, hi)
        assert not list(s.leaks(["before " + " ".join(t.split()[k % 30 : k % 30 + 7]) + " after" for k, t in items]))


def test_many_items_are_ready_soon():
    import time

    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    items = [(k, " ".join(r.choice(words) for _ in range(50))) for k in range(20_000)]
    t = time.time()
    s = L.Search(items)
    assert time.time() - t < 20
    assert [x[1] for x in s.leaks([cut(items[777][1], 10, 31)])] == [777]


def test_empty(spark):
    assert found(spark, ["a"], []) == set()
    assert found(spark, [], [passage(1)]) == set()
    assert found(spark, ["a b c"], [None, "", "!!"]) == set()


def test_repeats_without_end():
    item = passage(8)
    s = L.Search([(1, item)])
    assert list(s.leaks([(cut(item, 5, 10) + " ") * 5000])) == []
    assert [x[1] for x in s.leaks([(cut(item, 5, 10) + " ") * 500 + item])] == [1]


def test_shared_strings_and_altered_words_between_hits():
    r = random.Random(5)
    items = []
    for k in range(6):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 4))) for _ in range(44)]
        w[8:12] = w[28:32] = "inside the outer orders".split()
        items.append((k, " ".join(w)))
    s = L.Search(items)
    for k, text in items:
        w = text.split()
        for a in range(len(w) - 19):
            for off in range(2, 6):
                part = w[a : a + 20]
                part[off::6] = ["other"] * 3
                assert [x[1] for x in s.leaks(["before " + " ".join(part) + " after"])] == [k], (k, a, off)
            assert list(s.leaks(["before " + " ".join(w[a : a + 7]) + " after"])) == []
