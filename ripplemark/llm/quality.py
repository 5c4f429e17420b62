"""Text quality of documents: what share of a text is prose, and what is lists, tables, listings or junk.

Basic statistics (words, mean word length, symbols, punctuated lines, common words) are built-in expressions; the
repetition statistics (duplicate lines and paragraphs, characters covered by the dominant n-grams) and the separation of
prose from the rest read each text once in Arrow batches, whole.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text is no prose if at least this share of its visible characters is not.
NO_PROSE = 0.75
#: Words in a row whose repetition is counted.
GRAM = 3

SPACE = r"[ \t\n\x0B\f\r]"
_TRIM = ".,;:!?()[]{}\"'`*_"
_EDGES = _TRIM + "\u201c\u201d\u201e\u2018\u2019\u00ab\u00bb"
_NO_ALNUM = bytes(c for c in range(128) if not chr(c).isalnum())


def basic(text: Column, common: list[str]) -> dict[str, Column]:
    """Per-document statistics as expressions. Words are runs of characters other than ASCII white space; a symbol is a
    character that is neither letter, digit nor white space (of ASCII), and none of the others; a line ends in
    punctuation if its last visible character is one of . ! ? : ; and blank lines do not count. A null, empty or blank
    text has 0 words and null for the rest."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    n = F.size(words)
    some = text.isNotNull() & (n > 0)
    bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(_TRIM))))
    visible = F.regexp_replace(text, SPACE, "")
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    ends = F.filter(lines, lambda x: x.rlike(r"[.!?:;]" + SPACE + "*$"))
    known = F.lit(sorted(common))
    return {
        "words": F.when(some, n).otherwise(0).cast("bigint"),
        "mean_word_length": F.when(some, F.length(visible) / n),
        "symbol_ratio": F.when(some, F.length(F.regexp_replace(visible, r"[A-Za-z0-9\x{80}-\x{10FFFF}]", "")) / F.length(visible)),
        "punctuated_lines": F.when(some, F.size(ends) / F.size(lines)),
        "common_words": F.when(some, F.size(F.filter(bare, lambda w: F.array_contains(known, w))) / n),
    }


# --- reading one text

_BULLET = re.compile(r"^\s*(?:[-*+•–—·▪◦‣]|\[[ xX]?\]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)])\s+(?=\S)")
_LISTING = re.compile(
    r"""^\s*(?:
      \d{4}-\d\d-\d\d[T ]\d\d:\d\d                      # log line with a time
    | \[\s*\d[\d.:]*\]\s                                # log line with a counter
    | (?:[0-9a-f]{4,16}[: ]\s+)(?:[0-9a-f]{2,4}\s+){4}  # hex dump
    | (?:---|\+\+\+)\s\S+/ | @@\s-\d                    # diff headers
    | diff\s--git\s | index\s[0-9a-f]{7}
    | \#\s*(?:include|define|if|ifdef|ifndef|endif|pragma)\b
    | [A-Za-z_]\w*\s*\([^()]+\)\s*$                     # a call alone, as in build files
    | [{}\[\]()]+[;,]?\s*$                              # brackets only
    | "[^"]*"\s*:\s*\S                                  # JSON member
    | "[^"]*",?\s*$                                     # JSON string
    | (?://|/\*|\*/).*$                                 # comment
    | </?\w[^>]*>\s*$                                   # a tag alone
    | at\s+\S+\(\S*\)$                                  # stack trace
    )""",
    re.X,
)
_CODE_END = re.compile(r"(?:[;{}]|\)\s*\{?|,)\s*$")
_CODE_IN = re.compile(r"\w\s*\([^()]*\)\s*;|\w\s+=\s+\S|\w=\S|[<>=!]=|&&|\|\||->|\breturn\b.*;|std::\w+<|^\s*(?:if|for|while|switch)\s*\(|^[-+ ]\s{2,}\S")
_SENTENCE_END = re.compile(r"[.!?…][\"'”’)\]*_`]*$")
_SENTENCE_IN = re.compile(r"[^\W\d_][.!?][\"'”’)]*\s+\S")
_PIECES = re.compile("[,;|\u2022\u00b7\t]| {3,}")
_PLAIN = re.compile(r"^[(\"'“]?[^\W\d_][^\W\d_A-Z]{0,13}[.,;:!?)\"'”]*$")
_VOWELS = frozenset("aeiouy")
_PREFIX = re.compile(r"^\s*(>+|\*|//+|#|--|;|\|)(?:\s+|$)")
_GAP = re.compile(r"(?<=[^\s.!?:])(?: {2,}|\t+)(?=\S)")
_BARE_COMMA = re.compile(r",(?=[^\s\"']|$)")
_BLOB = re.compile(r"^(?=.*[A-Z0-9+=])[A-Za-z0-9+/=_-]{50,}$")
_BLOB_END = re.compile(r"^[A-Za-z0-9+/=_-]{2,}$")
_SPECIAL = re.compile(r"<\|\w*\|>")
_BREAK = re.compile(r"</?(?:p|br|div|li|tr|h\d)\b[^<>]*>", re.I)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|code|tt|small)\b[^<>]*>", re.I)
_EMPHASIS = re.compile(r"(?<![\w*_])(\*\*|__|\*|_)(?=\S)([^*\n]{1,80}?\S|\S)\1(?![\w*_])")
_WRAPPED_STRING = re.compile(r'^\s*\{?\s*"\w+"\s*:\s*"(.{60,})"\s*\}?,?\s*$')
_MOJIBAKE = re.compile("[\u00c3\u00c2\u00a1\u00a2\u00a3\u00bb\x80-\x9f\ufffd]")


_FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]")


def _tidy(text: str) -> str:
    """Compatibility forms resolved, format characters dropped."""
    return text if text.isascii() else _FORMAT.sub("", unicodedata.normalize("NFKC", text))


def _string(line: str) -> list[str]:
    """The lines of a long text that stands as the only string of a JSON object on a line; else the line itself."""
    m = _WRAPPED_STRING.match(line)
    if m is None or m[1].count(" ") < 12:
        return [line]
    try:
        return json.loads(f'"{m[1]}"').split("\n")
    except ValueError:
        return [line]


def _weight(s: str) -> int:
    return len(s) - sum(map(s.count, " \t\n\r\f\v"))


class Reader:
    """Tells prose from the rest, given the common words of several languages."""

    def __init__(self, common: dict[str, set[str]]):
        # a word's languages as bits, and the same for words as they stand in texts, as far as there is room
        self.bits: dict[str, int] = {}
        for i, ws in enumerate(common.values()):
            for w in ws:
                self.bits[w] = self.bits.get(w, 0) | 1 << i
        self.languages = len(common)
        self.seen: dict[str, int] = {}

    def hits(self, words: list[str]) -> list[int]:
        """The languages, as bits, of those of the words that are common in any."""
        seen, out = self.seen, []
        for w in words:
            m = seen.get(w)
            if m is None:
                if len(seen) > 200_000:
                    seen.clear()
                m = seen[w] = self.bits.get(w.strip(_EDGES).casefold(), 0)
            if m:
                out.append(m)
        return out

    def share_of(self, hits: list[int], words: int) -> float:
        """Share of common words in the language that has most of them."""
        if not hits:
            return 0.0
        return max(sum([m >> i & 1 for m in hits]) for i in range(self.languages)) / words

    def share(self, words: list[str]) -> float:
        return self.share_of(self.hits(words), len(words)) if words else 0.0

    def listing(self, line: str, words: list[str], hits: list[int]) -> bool:
        """A line that no prose has: logs, code, tables, rules. words and hits are the line's own."""
        s = line.strip()
        alnum = len(s.encode().translate(None, _NO_ALNUM)) if s.isascii() else sum(map(str.isalnum, s))
        if alnum < 0.35 * len(s):
            return True
        if _LISTING.match(line) or (s[-1] == "{" and len(s) > 1):
            return True
        if "|" in s and _SPECIAL.sub("", s).count("|") >= 2 or not s.isascii() and (s.count("\u2502") >= 2 or s.count("\u2503") >= 2):
            return True
        gaps = len(_GAP.findall(s)) if "  " in s or "\t" in s else 0
        if s.count(",") >= 2 and len(_BARE_COMMA.findall(s)) >= 2 and len(words) <= 5 * s.count(","):
            return True
        cs = self.share_of(hits, len(words))
        if len(words) >= 9 and cs >= 0.2 and gaps <= 1:
            return False
        if "\t" in s or gaps >= 2 or (gaps and len(words) < 9 and not _SENTENCE_END.search(s)):
            return True
        if _CODE_IN.search(line) and (_CODE_END.search(line) or cs < 0.1):
            return True
        return bool(_BLOB.match(s))

    def paragraph(self, lines: list[str], by_line: list[list[str]], hits: list[int]) -> bool:
        """Whether consecutive lines that are no listing and no bullets are prose. by_line and hits: their words, and the
        common ones among them."""
        text = "\n".join(lines)
        words = [w for x in by_line for w in x]
        n = len(words)
        cs = self.share_of(hits, n)
        sentences = len(_SENTENCE_IN.findall(text)) + bool(_SENTENCE_END.search(text))
        if n >= 8 and cs < 0.13 and not (cs > 0 and self.wordlike(words, 0.4 if sentences > 1 else 0.5) and (6 * sentences <= n <= 30 * sentences or (n >= 7 * len(lines) and text.count(",") + text.count(";") + text.count("|") < n / 6))):
            return False
        odd = 0 if text.isascii() else len(_MOJIBAKE.findall(text)) / len(text)
        if n < 8 and cs == 0 and (_weight(text) > 70 or odd > 0.2):
            return False
        if odd > 0.25:
            return False
        if n >= 12:
            kinds = len(set(map(str.casefold, words)))
            if kinds < 0.25 * n and kinds <= 12:
                return False
        per = [len(x) for x in by_line]
        if len(lines) >= 4 and per[0] <= 6 and _SENTENCE_END.search(lines[0].strip()):  # what leads up to a list
            sentences, lines, n, per = sentences - 1, lines[1:], n - per[0], per[1:]
        mean = n / len(lines)
        runs_on = self.wrapped(lines) and (sentences or max(map(len, lines)) >= 44) and (sentences or mean > 3.6)
        if len(lines) >= 3 and max(per) <= 9 and mean <= 6 and not runs_on and sum(bool(_SENTENCE_END.search(x.strip())) for x in lines) < 0.5 * len(lines):
            return False  # short lines, each for itself
        size = [k for p in _PIECES.split(" ".join(lines)) if (k := len(p.split()))]
        if len(size) >= 4:
            if sum(size) / len(size) <= 4.5 and sorted(size)[len(size) // 2] <= 4 and (sentences <= 1 or sentences * 30 < n):
                return False  # fragments set in one line
        return True

    @staticmethod
    def wordlike(words: list[str], most: float) -> bool:
        """Whether most words are plain ones: letters only, in one case but for the first, with vowels among them."""
        plain = [w for w in words if _PLAIN.match(w)]
        letters = "".join(plain).casefold()
        vowels = sum(c in _VOWELS for c in unicodedata.normalize("NFD", letters))
        return len(plain) >= most * len(words) and vowels >= 0.28 * len(letters)

    @staticmethod
    def wrapped(lines: list[str]) -> bool:
        """Whether the lines look like one paragraph broken at a width: what begins the next would not have fitted."""
        if len(lines) < 2:
            return False
        width = max(map(len, lines))
        fits = sum(len(a) + 1 + len(b.split()[0]) <= width for a, b in zip(lines, lines[1:]))
        return width >= 24 and fits <= 0.34 * (len(lines) - 1)

    def unquoted(self, lines: list[str]) -> list[str]:
        """Lines without the mark that a quoted or commented paragraph has before each of its lines. Items of a list have
        marks too, but do not run on from line to line."""
        out, i = [], 0
        while i < len(lines):
            m = _PREFIX.match(lines[i])
            if not m:
                out.append(lines[i])
                i += 1
                continue
            k = i
            while k < len(lines) and (x := _PREFIX.match(lines[k])) and x[1] == m[1]:
                k += 1
            block = lines[i:k]
            rest = [_PREFIX.sub("", x, count=1) for x in block]
            full = [x for x in rest if x.strip()]
            words = sum(len(x.split()) for x in full)
            if len(full) >= 2 and m[1] != "|" and words >= 5 * len(full) and self.wrapped(full):
                out += rest
            else:
                out += block
            i = k
        return out

    def no_prose(self, text: str, tidy: bool = False) -> float:
        """Share of a text's visible characters that is no prose; 0 for a blank one."""
        t = text if tidy else _tidy(text)
        if "<" in t and (_BREAK.search(t) or _INLINE.search(t)):
            t = html.unescape(_INLINE.sub("", _BREAK.sub("\n", t)))
        if "**" in t or " _" in t or "\n_" in t or " *" in t:
            t = _EMPHASIS.sub(r"\2", t)
        lines = [y for x in t.splitlines() for y in _string(x)]
        total = bad = 0
        blob = False  # whether the line before was one long run of characters
        run: list[str] = []  # consecutive plain lines, their words, and the common ones of all
        by_line: list[list[str]] = []
        run_hits: list[int] = []
        items: list[tuple[int, bool, str]] = []  # short plain paragraphs that may be items: weight, prose, text

        def close() -> None:
            nonlocal bad
            if not run:
                return
            w = sum(map(_weight, run))
            ok = self.paragraph(run, by_line, run_hits)
            if len(run) <= 2 and sum(map(len, by_line)) <= 8 and not _SENTENCE_END.search(run[-1].strip()):
                items.append((w, ok, " ".join(run)))
            else:
                settle()
                if not ok:
                    bad += w
            run.clear()
            by_line.clear()
            run_hits.clear()

        def settle() -> None:
            """Short paragraphs in a row are a list set apart by blank lines; a few are titles."""
            nonlocal bad
            if len(items) >= 4:
                bad += sum(w for w, _, _ in items)
            else:
                bad += sum(w for w, ok, _ in items if not ok)
            items.clear()

        for line in self.unquoted(lines):
            if not line.strip():
                close()
                continue
            w = _weight(line)
            total += w
            m = _BULLET.match(line)
            if m:
                close()
                rest = line[m.end() :]
                words = rest.split()
                hits = self.hits(words)
                prose = len(words) >= 9 and self.share_of(hits, len(words)) >= 0.13 and (len(words) >= 12 or _SENTENCE_END.search(rest.strip()) is not None) and not self.listing(rest, words, hits)
                if not prose:
                    bad += w
                continue
            words = line.split()
            hits = self.hits(words)
            if self.listing(line, words, hits) or (blob and _BLOB_END.match(line.strip())):
                close()
                bad += w
                blob = len(words) == 1 and _BLOB.match(words[0]) is not None
            else:
                run.append(line)
                by_line.append(words)
                run_hits += hits
        close()
        settle()
        return bad / total if total else 0.0


def repetition(text: str, tidy: bool = False) -> tuple[float, float, float, float, float]:
    """Shares of duplicate lines and paragraphs (by visible characters: every copy after the first), of the characters
    covered by the most frequent GRAM-word sequence and of those in any repeated one, and of the sequences that come again
    at one and the same distance, which is that of a sentence or paragraph said over and over."""
    t = text if tidy else _tidy(text)

    def copies(parts: list[str]) -> float:
        parts = [" ".join(p.split()) for p in parts]
        parts = [p for p in parts if p]
        all_ = sum(map(len, parts))
        return 1 - sum(map(len, set(parts))) / all_ if all_ else 0.0

    words = t.casefold().split()
    chars = sum(map(len, words))
    top = dup = period = 0.0
    if len(words) >= GRAM and chars:
        grams = Counter(zip(*[words[i:] for i in range(GRAM)]))
        again = {g: k for g, k in grams.items() if k > 1}
        if again:
            top = min(1.0, max(k * sum(map(len, g)) for g, k in again.items()) / chars)
            hit = bytearray(len(words))
            last: dict[tuple, int] = {}
            gaps: dict[int, int] = {}
            for i, x in enumerate(zip(*[words[i:] for i in range(GRAM)])):
                if x in again:
                    hit[i : i + GRAM] = b"\x01" * GRAM
                    if (before := last.get(x)) is not None:
                        gaps[i - before] = gaps.get(i - before, 0) + 1
                    last[x] = i
            dup = sum(len(w) for w, h in zip(words, hit) if h) / chars
            period = max(gaps.values()) / (len(words) - GRAM + 1)
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    return copies(t.split("\n")), copies(re.split(r"\n[ \t]*\n\s*", t)), top, dup, period


#: A text most of whose characters lie in one short repeated sequence is junk, whatever else it looks like.
DOMINANT = 0.6


def combined(bad: float, dup_lines: float, dup_paragraphs: float, top: float, dup_grams: float, period: float) -> float:
    """The share of a text that is no prose, by all that is known: lines and paragraphs that look like none, one sequence
    that covers most of it, and lines, paragraphs and sentences that are copies after the first. dup_grams alone tells
    nothing: in long prose about one matter most sequences come again somewhere."""
    return max(bad, top if top >= DOMINANT else 0.0, dup_lines, dup_paragraphs, min(period, dup_grams))


SCHEMA = "doc bigint, dup_lines double, dup_paragraphs double, top_gram double, dup_grams double, period double, no_prose double"


def measure(docs: DataFrame, common: dict[str, set[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Repetition statistics and the share that is no prose for every row; null, empty and blank texts have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(common)
        for b in batches:
            rows = []
            for i, t in zip(b["doc"], b["text"]):
                if t is None or not t.strip():
                    rows.append((i, None, None, None, None, None, None))
                    continue
                t = _tidy(t)
                r = repetition(t, True)
                bad = reader.no_prose(t, True)
                rows.append((i, *r, combined(bad, *r)))
            yield pd.DataFrame(rows, columns=["doc", "dup_lines", "dup_paragraphs", "top_gram", "dup_grams", "period", "no_prose"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(run, SCHEMA).withColumnRenamed("doc", doc_id)
