"""Evaluation passages inside a corpus: Wu-Manber search for many strings, then an alignment around the hits.

Both sides are squeezed to letters and digits, without case, marks, markup, escapes and layout, so that only the sequence
of letters counts. At every word of an item two search strings may begin: WINDOW letters, and, where its next four words
are shorter than that, these words (SHORT letters at least), which must stand between two edges of the text.

The search looks at the block of letters that ends at every S-th place of a text, S being the longest shift. Where that
block is in no string, S places are passed over at once; else the shift table says how far the search may move on, and
where it says nought the hash of the window picks the bucket of strings, which are compared directly. All texts of a
batch are searched together. What stands around a hit is aligned with the item word by word, past a few altered words;
a document leaks an item if the alignment holds enough of PASSAGE words in a row.

Items of equal letters are searched once. Which phrases several items share is found out over all items, before they are
cut into blocks; a block is bounded in letters, each task holds one at a time, and the corpus is read once a block.
Texts are searched whole; nothing but the leaks leaves a task.
"""

from __future__ import annotations

import bisect
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.runtime import Staged, held_last

#: Letters of a search string, and the least of one made of WORDS short words.
WINDOW, SHORT, WORDS = 14, 8, 4
#: Letters of a block of the shift table, by the letters all strings have.
BLOCK = {WINDOW: 7, SHORT: 5}
#: Of PASSAGE words on end, so many must be held around one hit: twenty words of which three are altered keep fourteen
#: even where single words between two altered ones are lost.
PASSAGE, ALIGNED = 20, 14
#: Words of the text and of the item that an alignment may pass over at once.
OVER_TEXT, OVER_ITEM = 4, 3
_SKIPS = sorted(((a, b) for a in range(OVER_TEXT + 1) for b in range(OVER_ITEM + 1) if a + b), key=lambda x: (x[0] + x[1], abs(x[0] - x[1])))
#: A phrase that several items share counts for none of them, unless it is PASSAGE words long. An alignment must hold so
#: many words outside such phrases.
OWN_WORDS = 2
#: Letters of a block of items, and texts of a batch that are searched at once, by letters.
LETTERS_A_BLOCK = 16_000_000
LETTERS_AT_ONCE = 2_000_000
#: Hits compared at once.
HITS_AT_ONCE = 1_000_000

#: Tags: any whose attributes have values, however long, and otherwise what a tag of ordinary length may hold.
_TAG = re.compile(r"""</?[A-Za-z][\w:.-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s<>"']+))*\s*/?>|</?[A-Za-z][^<>]{0,200}>""")
_U = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESC = re.compile(r"\\[nrtbf/\"\\]")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
#: Letters of other scripts that look like Latin ones: a fixed table.
_LOOKS = str.maketrans("асеорхуіјѕԁһӏοαενικρτυχ", "aceopxyijsdhloaevikptux")
#: Codes of what is no letter: dropped, white space, and the mark between texts.
_DROPPED, _BLANK, _MARK = 0, 254, 255


def _codes() -> np.ndarray:
    """Code of every character: 1 to 36 for digits and Latin letters, then other letters by hash."""
    return held_last("codes", 0, _make_codes)


def _make_codes() -> np.ndarray:
    t = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalnum():
            d = unicodedata.normalize("NFKD", c).casefold().translate(_LOOKS)[:1]
            if "0" <= d <= "9":
                t[cp] = 1 + ord(d) - 48
            elif "a" <= d <= "z":
                t[cp] = 11 + ord(d) - 97
            else:
                t[cp] = 37 + (ord(d) if d else cp) * 31 % 211
        elif c.isspace():
            t[cp] = _BLANK
    for a, b in (("đ", "d"), ("ø", "o"), ("ł", "l"), ("ı", "i")):
        t[ord(a)] = t[ord(a.upper()) if len(a.upper()) == 1 else ord(a)] = 11 + ord(b) - 97
    t[0] = _MARK
    return t


def plain(text: str) -> str:
    """A text without escapes, markup, compatibility forms and combining marks."""
    if "\\" in text:
        text = _ESC.sub(" ", _U.sub(lambda m: chr(int(m[1], 16)), text))
    if "%" in text and _PERCENT.search(text):
        text = _PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\0" in text:
        text = text.replace("\0", " ")
    return text if text.isascii() else unicodedata.normalize("NFKD", text)


class Letters:
    """The letters and digits of several texts on end, a mark behind each text."""

    def __init__(self, texts: list[str]):
        big = "".join(f"{plain(t)}\0" for t in texts)
        t = _codes()[np.frombuffer(big.encode("utf-32-le", "replace"), dtype=np.uint32)]
        at = np.flatnonzero((t != _DROPPED) & (t != _BLANK))
        self.c = t[at]
        self.ends = np.flatnonzero(self.c == _MARK)  # of each text
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(texts) else np.zeros(0, np.int64)
        # edge: something was dropped before this place, or a text begins or ends there
        self.edge = np.ones(len(self.c), dtype=bool)
        self.edge[1:] = np.diff(at) > 1
        self.edge[self.starts] = self.edge[self.ends] = True
        self._t, self._at = t, at

    def words(self) -> np.ndarray:
        """Places at which a word begins, words being split at white space; words without letters are none."""
        blanks = np.concatenate([[0], np.cumsum(self._t == _BLANK)])[self._at]
        new = np.ones(len(self.c), dtype=bool)
        new[1:] = np.diff(blanks) > 0
        new[self.starts] = True
        return np.flatnonzero(new & (self.c != _MARK))


def _hashes(c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n letters from each of the places on."""
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ c[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Items:
    """Words of several items, numbered through."""

    def __init__(self, texts: list[str]):
        ls = Letters(texts)
        self.c, self.at = ls.c, ls.words()
        self.item = np.searchsorted(ls.ends, self.at)  # of each word
        self.first = np.searchsorted(self.item, np.arange(len(texts)))  # word of each item
        self.after = np.searchsorted(self.item, np.arange(len(texts)), side="right")
        self.stop = ls.ends[self.item] if len(self.at) else self.at  # where the word's item ends
        self.last = self.after[self.item] if len(self.at) else self.at

    def end(self, word: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Place behind the words from `word` up to, not including, `upto`, which is at most the item's last."""
        return np.where(upto < self.last[word], self.at[np.minimum(upto, len(self.at) - 1)], self.stop[word])

    def long(self) -> np.ndarray:
        """Words at which WINDOW letters begin."""
        return np.flatnonzero(self.at + WINDOW <= self.stop)

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Words at which a string of short words begins, and its letters: WORDS words, or more up to SHORT letters."""
        w = np.arange(len(self.at))
        if not len(w):
            return w, w
        upto = np.maximum(w + WORDS, np.searchsorted(self.at, self.at + SHORT))
        upto = np.where((upto > self.last) & (self.stop - self.at >= SHORT) & (self.stop - self.at < WINDOW), self.last, upto)
        n = self.end(w, np.minimum(upto, self.last)) - self.at
        ok = (upto <= self.last) & (n >= SHORT) & (n < WINDOW)
        return w[ok], n[ok]

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Words at which PASSAGE words of an item begin, and a hash of their letters."""
        w = np.flatnonzero(np.arange(len(self.at)) + PASSAGE <= self.last)
        if not len(w):
            return w, np.zeros(0, np.uint64)
        r = np.random.default_rng(1)
        value = r.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = 0xD6E8FEB86659FD93
        back = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(len(self.c), base, dtype=np.uint64))
            down = np.cumprod(np.full(len(self.c), back, dtype=np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[self.c] * up)])
            a, b = self.at[w], self.end(w, w + PASSAGE)
            return w, (total[b] - total[a]) * down[a]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, kind, hash) of all windows (kind 0) and passages (kind 1)."""
        a, (b, hb) = self.long(), self.passages()
        return np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([_hashes(self.c, self.at[a], WINDOW), hb]).astype(np.uint64)

    def common(self, windows: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """Whether each word lies in a phrase that does not count. windows, passages: words at which one begins that
        another item has too."""
        n = len(self.at)
        spared = np.zeros(n + 1, dtype=np.int64)
        np.add.at(spared, passages, 1)
        np.add.at(spared, np.minimum(passages + PASSAGE, n), -1)
        mine = windows[np.cumsum(spared)[windows] == 0] if n else windows
        held = np.zeros(n + 1, dtype=np.int64)
        upto = np.maximum(np.searchsorted(self.at, self.at[mine] + WINDOW, side="right") - 1, mine + 1) if n else mine
        np.add.at(held, mine, 1)
        np.add.at(held, np.minimum(upto, n), -1)
        return np.cumsum(held)[:n] > 0


def _shared(items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a window, or a passage, begins that another of the items has too."""
    w, kind, h = items.keys()
    f = pd.DataFrame({"w": w, "kind": kind, "h": h, "item": items.item[w] if len(w) else w})
    g = f.groupby(["kind", "h"])["item"]
    f = f[g.transform("min") != g.transform("max")]
    return f.loc[f["kind"] == 0, "w"].to_numpy(), f.loc[f["kind"] == 1, "w"].to_numpy()


class Table:
    """Shift table and buckets of strings that all have `m` letters at least."""

    def __init__(self, c: np.ndarray, at: np.ndarray, m: int):
        self.m, self.b = m, BLOCK[m]
        self.far = m - self.b + 1
        self.bits = min(26, max(16, math.ceil(math.log2(8 * self.far * (len(at) + 1)))))
        self.shift = np.full(1 << self.bits, self.far, dtype=np.uint8)
        for q in range(self.far):  # the nearer to the end, the smaller, and the later written
            self.shift[self._blocks(c, at + q)] = self.far - 1 - q
        h = _hashes(c, at, m)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]

    def _blocks(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Table index of the block that begins at each place."""
        h = np.zeros(len(at), dtype=np.uint32)
        for i in range(self.b):
            h = h * np.uint32(0x01000193) + c[at + i]
        return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def hits(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, string) wherever the first m letters of a string may stand, in pieces."""
        if len(c) < self.m or not len(self.hashes):
            return
        head = self.m - self.b  # from the start of a string to its last block
        probe = np.arange(0, len(c) - self.b + 1, self.far)
        # a string that ends in one of the `far` places from a probe on has the probe's block in it
        found, limit, p = [], probe + self.far, probe
        while len(p):
            s = self.shift[self._blocks(c, p)]
            found.append(p[s == 0])
            p = p + np.maximum(s, 1)
            go = (p < limit) & (p + self.b <= len(c))
            p, limit = p[go], limit[go]
        at = np.sort(np.concatenate(found)) - head
        at = at[at >= 0]
        h = _hashes(c, at, self.m)
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
        some = hi > lo
        at, lo, n = at[some], lo[some], (hi - lo)[some]
        cut = np.flatnonzero(np.diff(np.cumsum(n) // HITS_AT_ONCE, prepend=0)) if len(n) else []
        for a, l, k in zip(np.split(at, cut), np.split(lo, cut), np.split(n, cut)):
            if len(k):
                within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield np.repeat(a, k), self.order[np.repeat(l, k) + within]


def _run(raw: bytes, bounds: list[int], words: list[bytes], p: int, j: int) -> list[tuple[int, int]]:
    """(place, word) of the words from j on that stand on end at place p, the last of them up to an edge."""
    out = []
    while j < len(words) and raw.startswith(words[j], p):
        out.append((p, j))
        p, j = p + len(words[j]), j + 1
    while out:
        end = out[-1][0] + len(words[out[-1][1]])
        if bounds[bisect.bisect_left(bounds, end)] == end:
            break
        out.pop()
    return out


def _walk(raw: bytes, bounds: list[int], words: list[bytes], p: int, j: int) -> list[tuple[int, int]]:
    """(place, word) of the words from j on that the text holds from place p on, past altered, missing and additional
    words as long as two neighbours stand behind them."""
    out = _run(raw, bounds, words, p, j)
    if out:
        p, j = out[-1][0] + len(words[out[-1][1]]), out[-1][1] + 1
    while p < len(raw) and j < len(words):
        first = bisect.bisect_left(bounds, p)
        for a, b in _SKIPS:
            at = first + a - (a > 0 and bounds[first] != p)
            if at >= len(bounds) - 1:
                continue
            more = _run(raw, bounds, words, bounds[at], j + b)
            if len(more) > 1:
                out += more
                p, j = more[-1][0] + len(words[more[-1][1]]), more[-1][1] + 1
                break
        else:
            break
    return out


class Strings:
    """The distinct strings that begin at some words: one of m letters each, or of m and more if lengths are given."""

    def __init__(self, it: Items, words: np.ndarray, m: int, lengths: np.ndarray | None):
        at = it.at[words]
        n = np.full(len(words), m) if lengths is None else lengths
        h = _hashes(it.c, at, m)
        for i in range(m, WINDOW - 1):
            more = i < n
            h[more] = _hashes(it.c, at[more] + i, 1) ^ (h[more] * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= n.astype(np.uint64)
        order = np.lexsort((words, h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = h[order][1:] != h[order][:-1]
        self.cut = np.append(np.flatnonzero(new), len(order))  # the words of each string, in order
        self.words, self.lengths = words[order], n[order][self.cut[:-1]]
        self.first = self.words[self.cut[:-1]]
        self.table, self.varying = Table(it.c, it.at[self.first], m), lengths is not None

    def of(self, string: int) -> np.ndarray:
        return self.words[self.cut[string] : self.cut[string + 1]]


class Search:
    """The strings of a block of items.

    items: (id, text). shared: words, counted within each item, at which a window and a passage begin that other items
    have too; found out among the items themselves if not given.
    """

    def __init__(self, items: list[tuple[int, str]], shared: list[tuple[list[int], list[int]]] | None = None):
        self.ids = [i for i, _ in items]
        self.items = it = Items([t for _, t in items])
        if shared is None:
            windows, passages = _shared(it)
        else:
            windows, passages = (np.array([it.first[k] + w for k, s in enumerate(shared) for w in s[x]], dtype=np.int64) for x in (0, 1))
        self.common = it.common(windows, passages)
        w, n = it.short()
        self.strings = [Strings(it, it.long(), WINDOW, None), Strings(it, w, SHORT, n)]
        self.cache: dict[int, tuple[list[bytes], list[bytes], list[bool]]] = {}

    def hits(self, ls: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, kind of string, string) of every occurrence, compared letter by letter with the first of its words."""
        it, none = self.items, np.zeros(0, np.int64)
        places, kinds, strings = [none], [none], [none]
        for kind, x in enumerate(self.strings):
            m = x.table.m
            for at, s in x.table.hits(ls.c):
                src, ok = it.at[x.first[s]], np.ones(len(at), dtype=bool)
                for i in range(m):
                    ok &= ls.c[at + i] == it.c[src + i]
                if x.varying:  # between edges
                    n = x.lengths[s]
                    end = at + n
                    ok &= (end < len(ls.c)) & ls.edge[at]
                    ok &= ls.edge[np.minimum(end, len(ls.c) - 1)]
                    for i in range(m, WINDOW - 1):
                        ok &= (i >= n) | (ls.c[np.minimum(at + i, len(ls.c) - 1)] == it.c[np.minimum(src + i, len(it.c) - 1)])
                places.append(at[ok])
                kinds.append(np.full(ok.sum(), kind))
                strings.append(s[ok])
        at = np.concatenate(places)
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate(kinds)[order], np.concatenate(strings)[order]

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, words held, first and last word) of the items that the texts leak."""
        ls = Letters(texts)
        at, kind, string = self.hits(ls)
        text = np.searchsorted(ls.ends, at)
        for x, rows in groupby(zip(text.tolist(), at.tolist(), kind.tolist(), string.tolist()), key=lambda r: r[0]):
            a, b = int(ls.starts[x]), int(ls.ends[x])
            by: dict[int, list[tuple[int, np.ndarray]]] = {}  # item: places and the words of the string there
            for _, p, q, s in rows:
                words = self.strings[q].of(s)
                items = self.items.item[words]
                if items[0] == items[-1]:
                    by.setdefault(int(items[0]), []).append((p - a, words))
                else:
                    cut = np.append(np.flatnonzero(np.diff(items, prepend=-1)), len(items)).tolist()
                    for u, v in zip(cut, cut[1:]):
                        by.setdefault(int(items[u]), []).append((p - a, words[u:v]))
            c = ls.c[a:b]
            bounds = np.append(np.flatnonzero(ls.edge[a:b]), len(c))
            both = (c.tobytes(), bounds.tolist(), c[::-1].tobytes(), (len(c) - bounds[::-1]).tolist())
            for k in sorted(by):
                best = self._aligned(k, by[k], both)
                if best:
                    yield x, self.ids[k], *best

    def _of(self, k: int) -> tuple[list[bytes], list[bytes], list[bool]]:
        """The words of an item, the same backwards, and whether each lies in a common phrase."""
        got = self.cache.get(k)
        if got is None:
            if len(self.cache) > 4096:
                self.cache.clear()
            it, a, b = self.items, self.items.first[k], self.items.after[k]
            cuts = [*it.at[a:b].tolist(), int(it.stop[a])]
            words = [it.c[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]
            got = self.cache[k] = words, [w[::-1] for w in reversed(words)], self.common[a:b].tolist()
        return got

    def _aligned(self, k: int, hits: list[tuple[int, np.ndarray]], both: tuple) -> tuple[int, int, int] | None:
        """The first alignment around a hit that holds enough words, some of them outside common phrases."""
        raw, bounds, raw_back, bounds_back = both
        words, back, common = self._of(k)
        n = len(words)
        need = max(1, min(ALIGNED, n * 5 // 6))
        done: set[tuple[int, int]] = set()  # places and words that an alignment went over already
        for p, j in ((p, j) for p, ws in hits for j in (ws - self.items.first[k]).tolist()):
            if (p, j) in done:
                continue
            right = _walk(raw, bounds, words, p, j)
            left = _walk(raw_back, bounds_back, back, len(raw) - p, n - j)
            done.update(right)
            x = sorted({y for _, y in right} | {n - 1 - y for _, y in left})
            dense = any(x[i + need - 1] - x[i] < PASSAGE for i in range(len(x) - need + 1))
            if dense and sum(not common[y] for y in x) >= min(OWN_WORDS, n):
                return len(x), x[0], x[-1]
        return None


def _portions(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Texts in groups that are searched at once."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= LETTERS_AT_ONCE:
            yield ids[a : b + 1], texts[a : b + 1]
            a, size = b + 1, 0
    if a < len(texts):
        yield ids[a:], texts[a:]


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, kind, word, h) of all windows and passages of items."""
    for b in batches:
        it = Items(b["text"].tolist())
        w, kind, h = it.keys()
        k = it.item[w] if len(w) else w
        yield pd.DataFrame({"item": b["item"].to_numpy()[k], "kind": kind, "word": w - it.first[k] if len(w) else w, "h": h.view(np.int64)})


def _letters_of(texts: pd.Series) -> pd.Series:
    """Digest of the words of each text, squeezed."""
    import hashlib

    out = []
    for t in texts:
        it = Items([t])
        cuts = np.zeros(len(it.c), dtype=bool)
        cuts[it.at] = True
        out.append(hashlib.md5(it.c.tobytes() + cuts.tobytes()).hexdigest())
    return pd.Series(out, dtype=object)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = LETTERS_A_BLOCK) -> DataFrame:
    """(doc_id, item_id, words, first_word, last_word): every document that carries a passage of an item.

    Null, empty and blank texts and items leak nothing, nor does an item of under SHORT letters. An item shorter than a
    passage counts if five sixths of it are there. Ids are unique on both sides; repeated documents are reported each,
    and items of equal letters each with what one of them leaks. block: letters of items that a task holds at a time;
    the result does not depend on it.
    """
    spark = docs.sparkSession
    digest = F.pandas_udf(_letters_of, "string")
    items = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), F.col(text).alias("text"))
    keyed = Staged(items.select("item", "text", digest("text").alias("k")), "items").df
    one = keyed.groupBy("k").agg(F.min_by("text", "item").alias("text"), F.min("item").alias("item"))
    marks = one.select("item", "text").mapInPandas(_marks, "item bigint, kind int, word int, h bigint")
    several = marks.groupBy("kind", "h").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi").select("kind", "h")
    # the words of one item at which something shared begins: at most as many as it has words
    starts = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("word")))).alias(f"s{k}")
    common = marks.join(several, ["kind", "h"], "left_semi").groupBy("item").agg(starts(0), starts(1))
    ready = Staged(one.select("item", "text").join(common, "item", "left"), "strings").df
    n, size = ready.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(1, min(n, -(-(size or 0) // block)))
    corpus = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    out = spark.createDataFrame([], "doc bigint, item bigint, words int, first_word int, last_word int")
    for b in range(blocks):
        mine = ready if blocks == 1 else ready.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = mine.orderBy("item").collect()  # about `block` letters
        if not rows:
            continue
        data = spark.sparkContext.broadcast(([(r["item"], r["text"]) for r in rows], [(r["s0"] or [], r["s1"] or []) for r in rows]))

        def run(batches: Iterator[pd.DataFrame], data=data) -> Iterator[pd.DataFrame]:
            search = held_last("search", hash(tuple(data.value[0])), lambda: Search(*data.value))
            for batch in batches:
                for ids, texts in _portions(batch["doc"].tolist(), batch["text"].tolist()):
                    found = [(ids[x], *r) for x, *r in search.leaks(texts)]
                    yield pd.DataFrame(found, columns=["doc", "item", "words", "first_word", "last_word"])

        out = out.unionByName(corpus.mapInPandas(run, out.schema))
    copies = keyed.groupBy("k").agg(F.min("item").alias("item")).join(keyed.select("k", F.col("item").alias(item_id)), "k").drop("k")
    return out.join(copies, "item").select(F.col("doc").alias(doc_id), item_id, "words", "first_word", "last_word")
