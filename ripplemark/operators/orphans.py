"""References to records that do not exist: composite keys with partial nulls, and keys that hold for a period only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators.skew import skew_join
from ripplemark.runtime import Staged

#: Distinct periods of one key that are kept as one array; keys with more are joined by their periods instead.
PERIODS_IN_ARRAY = 256


@dataclass(frozen=True)
class Period:
    """A key column that is a time: it matches a row whose period, from `born` up to but not including `gone`, holds it.
    A null born began before all time, a null gone has not ended."""

    key: str
    born: str
    gone: str


def orphans_by_mask(
    refs: DataFrame, keys: list[str], target: DataFrame, target_keys: list[str], match: str = "simple", spread: list[str] | None = None, period: Period | None = None, needs: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of refs whose composite key has no row in target, with the column null_mask ('.' set, '0' null, by key).

    References are grouped by which of their key columns are null; each group is anti-joined on its other columns only.
    match, as in the SQL standard: simple, a key with any null refers to nothing; partial, its non-null columns must
    occur together in some row; full, a key is null altogether or not at all, so a partly null one is an orphan.
    A key that is null altogether refers to nothing in every mode, nor does one that lacks a column of `needs`. refs may
    be uneven in its keys and hold repeated rows.

    period names a key column that is a time (target_keys then has one name fewer). With one, the result also has
    known, whether the other columns occur at all, and first_gone, the first end of a period they had.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"no such match semantics: {match}")
    spread = spread or refs.columns
    equal = [k for k in keys if period is None or k != period.key]
    names = dict(zip(equal, target_keys))
    mask = F.concat(*[F.when(F.col(k).isNull(), "0").otherwise(".") for k in keys])
    out = []
    for bits in product(".0", repeat=len(keys)):
        m = "".join(bits)
        there = [k for k, b in zip(keys, bits) if b == "."]
        if not there or any(k not in there for k in needs) or ("0" in m and match == "simple"):
            continue
        # the mask as conditions on single columns, so that they reach the scan
        mine = reduce(lambda df, kb: df.where(F.col(kb[0]).isNull() if kb[1] == "0" else F.col(kb[0]).isNotNull()), zip(keys, bits), refs).withColumn("null_mask", mask)
        extra = [] if period is None else [F.lit(False).alias("known"), F.lit(None).cast("timestamp_ntz").alias("first_gone")]
        if "0" in m and match == "full":
            out.append(mine.select("*", *extra))
            continue
        on = [k for k in there if k in equal]
        rows = target.where(reduce(lambda a, b: a & b, [F.col(names[k]).isNotNull() for k in on], F.lit(True)))
        if period is not None and period.key in there:
            if not on:
                raise ValueError("a time alone is no key: name the columns a reference needs")
            out.append(_outside(mine, on, rows.select(*[F.col(names[k]).alias(k) for k in on], F.col(period.born).alias("born"), F.col(period.gone).alias("gone")), period.key, spread))
            continue
        t = rows.select(*[F.col(names[k]).alias(k) for k in on]).distinct()
        out.append(skew_join(mine, t, on, spread, "left_anti").select(*mine.columns, *extra))
    return reduce(DataFrame.unionByName, out)


def _outside(refs: DataFrame, on: list[str], periods: DataFrame, at: str, spread: list[str]) -> DataFrame:
    """The anti-join of references whose time no period of their key holds, with known and first_gone."""
    distinct = periods.distinct()
    per_key = distinct.groupBy(*on).agg(F.min("gone").alias("first_gone"), F.count(F.lit(1)).alias("_n"))
    few = distinct.join(per_key.where(F.col("_n") <= PERIODS_IN_ARRAY).select(*on), on, "left_semi")
    arrays = few.groupBy(*on).agg(F.collect_list(F.struct("born", "gone")).alias("_spans"))
    j = skew_join(refs, per_key.join(arrays, on, "left"), on, spread, "left", sample_on=spread)
    t = F.col(at)
    holds = lambda born, gone: (born.isNull() | (born <= t)) & (gone.isNull() | (gone > t))
    known = F.col("_n").isNotNull()
    much = F.coalesce(F.col("_n") > PERIODS_IN_ARRAY, F.lit(False))
    rest = j.where(~F.coalesce(F.exists("_spans", lambda s: holds(s["born"], s["gone"])), F.lit(False)))
    if per_key.where(F.col("_n") > PERIODS_IN_ARRAY).limit(1).count():  # the exact way for keys of very many periods
        held = Staged(rest, "orphans").df
        many = distinct.join(per_key.where(F.col("_n") > PERIODS_IN_ARRAY).select(*on), on, "left_semi").select(*[F.col(k).alias(f"_m_{k}") for k in on], F.col("born").alias("_born"), F.col("gone").alias("_gone"))
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_m_{k}") for k in on])
        rest = held.where(~much).unionByName(held.where(much).join(many, same & holds(F.col("_born"), F.col("_gone")), "left_anti"))
    return rest.select(*refs.columns, known.alias("known"), "first_gone")


def period_orphans(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """References whose id has no life at their time, one row for each distinct (src, row_id, ref_id, at).

    refs: src, row_id, ref_id, at; lives: id, born, gone (see Period). The key is (ref_id, at); by null mask: with both
    the id must be alive at that time; with a null time it need only exist at all; without an id it refers to nothing.
    reason: missing if the id has no life, deleted if one had ended by then (at or before `at`), else late."""
    o = orphans_by_mask(refs, ["ref_id", "at"], lives, ["id"], "partial", ["src", "row_id"], Period("at", "born", "gone"), ("ref_id",))
    reason = F.when(~F.col("known"), "missing").when(F.col("first_gone") <= F.col("at"), "deleted").otherwise("late")
    return o.select("src", "row_id", "ref_id", "at", reason.alias("reason")).distinct()
