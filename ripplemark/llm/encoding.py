"""Encoding of a corpus by a public byte-level BPE tokenizer, very long texts in overlapping chunks.

A text of up to CHUNK characters is encoded as it is. A longer one is cut into chunks that overlap by OVERLAP characters.
Each chunk is pre-tokenised on its own; a chunk that begins amid a pre-token may begin wrongly, but the pattern looks only
ahead, so from the first boundary that the chunk shares with its predecessor on, both agree. Neighbours are stitched at
the first such boundary that has no white space before it (how a run of white space is split depends on what follows
it, which the piece before the stitch no longer shows), each piece between two stitches is encoded by itself, and the ids are put in order. If two neighbours
share no boundary in their overlap (a run of one class of characters longer than the overlap) the chunks are made
longer, at last the whole text. Pieces of one text are encoded by different tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.runtime import Staged, held

#: Folder of the public tokenizers' files; never copied into the repository.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: The pre-token pattern that belongs to the vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Each time neighbours do not meet, chunks get so many times longer.
GROW = 8


def encoder(folder: str = TOKENIZERS, name: str = NAME):
    """The tokenizer of a rank file, without special tokens."""
    import tiktoken

    def make():
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(("encoder", folder, name), make)


def _pattern():
    import regex

    return held(("pattern", PATTERN), lambda: regex.compile(PATTERN))


def boundaries(text: str, lo: int, hi: int) -> list[int]:
    """Places in [lo, hi) where a pre-token of the text begins; the text is read from its start. The last pre-tokens may
    be cut by the end of the text, so hi should lie before it where the text goes on."""
    out = []
    for m in _pattern().finditer(text):
        if m.start() >= hi:
            break
        if m.start() >= lo:
            out.append(m.start())
    return out


def _encode_batches(folder: str, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(folder, name)
        for b in batches:
            b["ids"] = [[] if not t else e.encode_ordinary(t) for t in b["text"]]
            yield b.drop(columns=["text"])

    return run


def _cut(size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, t in zip(b["doc"], b["text"]):
                n = -(-len(t) // size)
                yield pd.DataFrame({"doc": [doc] * n, "chunk": range(n), "last": [i == n - 1 for i in range(n)], "part": [t[i * size : (i + 1) * size + overlap] for i in range(n)]})

    return run


def _meet(chunk: int, overlap: int):
    """For each chunk the boundaries at its head (shared with the one before) and in its overlap with the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads, tails = [], []
            for i, t, last in zip(b["chunk"], b["part"], b["last"]):
                # the final pre-token of a part may be cut short: leave the last quarter of the overlap out
                safe = overlap - overlap // 4
                heads.append([i * chunk + p for p in boundaries(t[: overlap * 2], 0, safe)] if i else [0])
                tails.append([] if last else [i * chunk + p for p in boundaries(t, chunk, chunk + safe) if not t[p - 1].isspace()])
            yield pd.DataFrame({"doc": b["doc"], "chunk": b["chunk"], "head": heads, "tail": tails})

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs; a null or empty text gives an empty list.

    What looks like a special token is ordinary text. doc_id is unique. Texts beyond `chunk` characters take the chunked
    way, in rounds of growing chunks until all neighbours meet.
    """
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    out = docs.where(~long).mapInPandas(_encode_batches(folder, name), "doc bigint, ids array<int>")
    left, size = docs.where(long), chunk
    while left is not None:
        done, left = _round(left, size, overlap, folder, name)
        if done is not None:
            out = out.unionByName(done)
        size, overlap = size * GROW, overlap * GROW
    return out.select(F.col("doc").alias(doc_id), "ids")


def _round(docs: DataFrame, size: int, overlap: int, folder: str, name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Encode the texts whose neighbours all meet; give back the others, or None if there are none. The parts are written
    once, as they are read three times; a text of one part meets nobody."""
    parts = Staged(docs.mapInPandas(_cut(size, overlap), "doc bigint, chunk int, last boolean, part string").repartition("doc", "chunk"), "parts").df
    if not parts.limit(1).count():
        return None, None
    seen = parts.mapInPandas(_meet(size, overlap), "doc bigint, chunk int, head array<int>, tail array<int>")
    nxt = seen.select("doc", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next_head"))
    j = seen.join(nxt, ["doc", "chunk"], "left")
    # where this chunk's piece ends and the next one's begins; null at the end of the text
    stitch = Staged(j.select("doc", "chunk", F.array_min(F.array_intersect("tail", "next_head")).cast("int").alias("to"), F.col("next_head").isNull().alias("end")), "stitch").df
    stuck = stitch.where("to is null and not end").select("doc").distinct()
    ok = stitch.join(stuck, "doc", "left_anti")
    begins = ok.where("not end").select("doc", (F.col("chunk") + 1).alias("chunk"), F.col("to").alias("begin"))
    spans = ok.join(begins, ["doc", "chunk"], "left").select("doc", "chunk", F.coalesce("begin", F.lit(0)).alias("begin"), "to")
    # a piece lies within its own part: parts overlap, and stitches lie in the overlap
    piece = F.expr(f"case when `to` is null then substring(part, begin - chunk * {size} + 1) else substring(part, begin - chunk * {size} + 1, `to` - begin) end")
    ids = parts.join(spans, ["doc", "chunk"]).select("doc", "chunk", piece.alias("text")).mapInPandas(_encode_batches(folder, name), "doc bigint, chunk int, ids array<int>")
    done = ids.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("p")).select("doc", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"))
    return done, docs.join(stuck, "doc", "left_semi") if stuck.limit(1).count() else None


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, text): the tokens' raw bytes put together; a null list gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(folder, name)
        for b in batches:
            b["text"] = [None if x is None else e.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in b["ids"]]
            yield b.drop(columns=["ids"])

    out = encoded.select(F.col(doc_id).alias("doc"), F.col(ids).alias("ids")).mapInPandas(run, "doc bigint, text string")
    return out.select(F.col("doc").alias(doc_id), "text")
