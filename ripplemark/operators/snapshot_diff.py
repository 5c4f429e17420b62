"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

Rows are cut into hash buckets. Per bucket and snapshot the pairs (key hash, value hash) are summed into a small table
of cells; subtracting the tables of two snapshots cancels all equal pairs, and what differs is peeled out of the rest.
A bucket whose table was too small for its differences is built again with more cells. Each cell holds a digest as well, a
second hash of the values, so that what was peeled accounts for the digest of all rows or the bucket fails. Only buckets'
cells are compared, never whole snapshots side by side; rows are read once more to give the differing hashes their keys.

Keys are hashed to 128 bits, values to 64 bits and a second 64 as digest.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.runtime import Staged, partitions

#: Rows of one snapshot that a bucket holds on average.
ROWS_A_BUCKET = 2048
#: Cells for each row of a bucket in the first round: room for a fifth of the rows to differ (a modified one is two).
CELLS_A_ROW = 0.45
PARTS = 3
GROW = 3
#: After so many enlargements a bucket has more cells than rows and is compared row by row.
ROUNDS = 3

#: What the rows of a cell are summed in: key, value, check of these, digest (a second hash of the value) and the cells of
#: the row, SPOT_BITS for each.
FIELDS = ("k1", "k2", "v", "c", "g", "p")
SPOT_BITS = 21

PEELED = "pair int, bucket int, ok boolean, k1 bigint, k2 bigint, v bigint, sign int"


def list_hash(*lists: str, seed: int = 0) -> Column:
    """64 bits of several array columns: order, repetition, null elements and the bounds between the lists count; a null
    list is an empty one."""
    parts: list[Column] = [F.lit(seed)]
    for c in lists:
        a = F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))
        parts += [F.size(a), F.transform(a, lambda x: F.coalesce(x, F.lit("\u0000null")))]
    return F.xxhash64(*parts)


def latest(rows: DataFrame, snap: str, key: str, order: str, values: list[str], buckets: int) -> DataFrame:
    """(bucket, snap, key, k1, k2, v, d): of several rows of a key in one snapshot the one with the largest `order`; equal
    ones are decided by the hashes. A null order comes first. Rows without key or snapshot count for nothing."""
    h = rows.where(F.col(snap).isNotNull() & F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(F.lit(7), key), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(snap).cast("int").alias("snap"),
        F.col(key).alias("key"),
        F.struct(F.col(order).alias("o"), list_hash(*values).alias("v"), list_hash(*values, seed=1).alias("d")).alias("s"),
    )
    # the bucket alone decides the partition: this and the sums of cells below share it
    placed = h.repartition(F.col("bucket"))
    one = placed.groupBy("bucket", "snap", "key").agg(F.max("s").alias("s"))
    return one.select("bucket", "snap", "key", F.xxhash64(F.lit(11), "key").alias("k1"), F.xxhash64(F.lit(13), "key").alias("k2"), F.col("s.v").alias("v"), F.col("s.d").alias("d"))


def _cells(rows: DataFrame, snaps: DataFrame, size: Column) -> DataFrame:
    """Summed and subtracted cells: n, and the xor of each of FIELDS."""
    # each row counts for the pair that ends at its snapshot (+1) and for the one that begins there (-1)
    pairs = F.broadcast(snaps)
    signed = rows.join(pairs, "snap").select("bucket", "pair", "sign", "k1", "k2", "v", "d", size.alias("m"))
    check = F.xxhash64(F.lit(17), "k1", "k2", "v")
    third = (F.col("m") / PARTS).cast("int")
    spots = F.array(*[(F.pmod(F.xxhash64(F.lit(100 + i), "k1", "v"), third) + third * i).cast("int") for i in range(PARTS)])
    e = signed.select("bucket", "pair", "sign", "m", "k1", "k2", "v", check.alias("c"), F.xxhash64("k2", "d").alias("g"), spots.alias("s"))
    packed = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, SPOT_BITS).bitwiseOR(x.cast("bigint")))
    e = e.select("*", packed.alias("p"), F.explode("s").alias("cell"))
    return e.groupBy("bucket", "pair", "m", "cell").agg(F.sum("sign").alias("n"), *[F.bit_xor(x).alias(x) for x in FIELDS])


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & 0xFFFFFFFFFFFFFFFF


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _xx_long(value: int, seed: int) -> int:
    """xxHash64 of one 8-byte value, as the JVM side hashes a bigint column."""
    m = 0xFFFFFFFFFFFFFFFF
    h = (seed + _P5 + 8) & m
    h ^= (_rotl((value * _P2) & m, 31) * _P1) & m
    h = (_rotl(h, 27) * _P1 + _P4) & m
    h ^= h >> 33
    h = (h * _P2) & m
    h ^= h >> 29
    h = (h * _P3) & m
    return h ^ (h >> 32)


def _xx_int(value: int, seed: int) -> int:
    m = 0xFFFFFFFFFFFFFFFF
    h = (seed + _P5 + 4) & m
    h ^= ((value & 0xFFFFFFFF) * _P1) & m
    h = (_rotl(h, 23) * _P2 + _P3) & m
    h ^= h >> 33
    h = (h * _P2) & m
    h ^= h >> 29
    h = (h * _P3) & m
    return h ^ (h >> 32)


def spark_hash(lead: int, *longs: int) -> int:
    """xxhash64(lit(int), bigint, ...) of the JVM side, as a signed number."""
    h = _xx_int(lead, 42)
    for x in longs:
        h = _xx_long(x & 0xFFFFFFFFFFFFFFFF, h)
    return h - (1 << 64) if h >> 63 else h


def peel(cells: pd.DataFrame) -> pd.DataFrame:
    """Recover the differing pairs of one bucket of one snapshot pair; ok is false if some could not be, or if the digests
    of what was recovered do not account for those of all rows: then some sum is left over."""
    pair, bucket = int(cells["pair"].iloc[0]), int(cells["bucket"].iloc[0])
    low = (1 << SPOT_BITS) - 1
    table = {int(x[0]): [int(y) for y in x[1:]] for x in zip(*[cells[f].tolist() for f in ("cell", "n", *FIELDS)])}
    out = []
    todo = [c for c, t in table.items() if abs(t[0]) == 1]
    while todo:
        t = table.get(todo.pop())
        if t is None or abs(t[0]) != 1 or spark_hash(17, t[1], t[2], t[3]) != t[4]:
            continue
        sign, *row = t
        out.append((*row[:3], sign))
        p = row[-1]
        for at in (p >> SPOT_BITS * i & low for i in range(PARTS)):
            u = table.setdefault(at, [0] * (len(FIELDS) + 1))
            u[0] -= sign
            for i, x in enumerate(row, 1):
                u[i] ^= x
            if abs(u[0]) == 1:
                todo.append(at)
    ok = not any(any(t) for t in table.values())
    if not ok:
        out = []
    rows = [(pair, bucket, ok, *r) for r in out] or [(pair, bucket, ok, None, None, None, None)]
    df = pd.DataFrame(rows, columns=["pair", "bucket", "ok", "k1", "k2", "v", "sign"])
    return df.astype({"k1": "Int64", "k2": "Int64", "v": "Int64", "sign": "Int32"})


def snapshot_changes(rows: DataFrame, snap: str, key: str, order: str, values: list[str], rows_a_bucket: int = ROWS_A_BUCKET, cells_a_row: float = CELLS_A_ROW) -> DataFrame:
    """(snap_no, key, change_kind) between each snapshot and the one before it among those there are.

    change_kind: added, removed, or modified (another list in one of the array columns `values`; null is empty). Repeated
    and reloaded rows are decided by `order` (see latest). Empty tables and single snapshots give no row.
    """
    spark = rows.sparkSession
    snaps = [r[0] for r in rows.select(F.col(snap).cast("int").alias("s")).where("s is not null").distinct().orderBy("s").collect()]  # one row a delivery
    total = rows.count() if snaps else 0
    per = max(1, total // max(1, len(snaps)))
    buckets = max(1, -(-per // rows_a_bucket))
    held = Staged(latest(rows, snap, key, order, values, buckets), "snap")
    signs = [(s, s, 1) for s in snaps[1:]] + [(a, b, -1) for a, b in zip(snaps, snaps[1:])]
    pairs = spark.createDataFrame(signs, "snap int, pair int, sign int")
    m0 = max(PARTS * 8, PARTS * (int(per / buckets * cells_a_row) // PARTS))
    todo, out, m = held.df, [], m0
    bad = None
    for turn in range(ROUNDS):
        some = " or ".join(f"{x} <> 0" for x in ("n", *FIELDS))
        cells = _cells(todo, pairs, F.lit(m)).where(some)
        if bad is not None:
            cells = cells.join(bad, ["pair", "bucket"], "left_semi")
        peeled = Staged(cells.groupBy("bucket", "pair").applyInPandas(peel, PEELED), "peeled")
        out.append(peeled.df.where("ok and k1 is not null"))
        bad = Staged(peeled.df.where("not ok").select("pair", "bucket").distinct(), "bad").df
        if not bad.limit(1).count():
            bad = None
            break
        m = min(m * GROW, (1 << SPOT_BITS) - PARTS)
        todo = held.df.join(bad.select("bucket").distinct(), "bucket", "left_semi")
    found = reduce(DataFrame.unionByName, [o.select("pair", "bucket", "k1", "k2", "sign") for o in out])
    side = held.df.join(F.broadcast(pairs), "snap").select("pair", "bucket", "k1", "k2", "key", "sign")
    # back from hashes to keys: a differing pair names the row of the one or the other snapshot
    named = side.join(found, ["pair", "bucket", "k1", "k2", "sign"], "left_semi").select("pair", "key", "sign")
    if bad is not None:  # tables that did not open even with more cells than rows: these buckets row by row
        rest = held.df.join(F.broadcast(pairs), "snap").join(bad, ["pair", "bucket"], "left_semi")
        named = named.unionByName(
            rest.groupBy("bucket", "pair", "key").agg(F.sum("sign").alias("s"), F.min("v").alias("a"), F.max("v").alias("b"), F.min("d").alias("x"), F.max("d").alias("y"))
            .where("s <> 0 or a <> b or x <> y").select("pair", "key", F.explode(F.when(F.col("s") == 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.col("s").cast("int")))).alias("sign"))
        )
    kind = F.when(F.count(F.lit(1)) == 2, "modified").when(F.max("sign") == 1, "added").otherwise("removed")
    return named.groupBy("pair", "key").agg(kind.alias("change_kind")).select(F.col("pair").alias("snap_no"), "key", "change_kind")

