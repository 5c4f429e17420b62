"""Deeply nested records into related flat tables.

documents parses every text once into a Spark VARIANT, written to the shared folder. infer_schema walks every document
once and merges what it sees into one tree: at each place the kinds of values there are, the fields of its objects, the
elements of its arrays, and, where the keys of an object are data rather than names, the entries of a map. tables then
follows the tree: each level of arrays and each map becomes a child table, exploded from its parent's rows, with the
parent's surrogate key, the ordinal (and the key of a map entry) and the scalars as columns. A lone element where others
have an array is an array of one, at every level of nesting.

Nothing is left out: every scalar of every document is in one row of one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.runtime import Staged

#: White space and byte-order marks around a document.
AROUND = " \t\r\n\f\v\ufeff\u200b\u00a0"
#: An object is a map, its keys being data, if all keys ever seen at its place look like ids, or if there are more than
#: FIELDS of them.
ID_KEY = r"^([A-Za-z]*[-_:#])?[0-9]+$"
FIELDS = 256
#: Distinct (place, kind) pairs up to which maps are told apart on the driver; beyond, by joins, one a level. After that
#: more than this cannot be tables and is an error.
PLACES = 20_000
#: How steps are written: into an array, into a map, into a field.
ITEM, ENTRY, NAMED = "[]", "{}", "."


def document(body: Column) -> Column:
    """The VARIANT of the one JSON document in a text, or null.

    Accepted around it: blanks, byte-order marks, a code fence, lines of other text before and after. A document that was
    itself encoded as a JSON string comes out as that string. A truncated or otherwise unusable one gives null, never a
    part of it."""

    def tries(s: Column) -> Column:
        framed = F.regexp_extract(s, r'(?ms)^[ \t\x{FEFF}]*([\[{"].*[\]}"])', 1)  # from the first line that begins with an opener
        braces = F.regexp_extract(s, r"(?ms)^(\{.*\})", 1)
        inline = F.regexp_extract(s, r"(?s)^[^\[{]*(\{.*\}|\[.*\])", 1)
        bare = ~s.rlike(r'^[\[{"]')
        return F.coalesce(
            F.try_parse_json(s),
            F.try_parse_json(framed),
            F.when(bare, F.try_parse_json(braces)),
            F.when(bare & ~s.rlike(r'(?m)^[ \t\x{FEFF}]*[\[{"]'), F.try_parse_json(inline)),
        )

    return bind(F.btrim(body, F.lit(AROUND)), tries)


def documents(rows: DataFrame, body: str, doc: str = "doc", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with the column body replaced by its document; rows without a usable one are left out. Texts encoded as JSON
    strings are unwrapped as often as that was done, one pass over those that are left for each time. by: columns of few
    values that the documents are read by later."""
    others = [c for c in rows.columns if c != body]
    parts, todo = [], rows
    while True:
        parsed = todo.select(*others, document(F.col(body)).alias(doc)).withColumn("_kind", F.schema_of_variant(doc))
        wrapped = F.col("_kind") == "STRING"
        held = Staged(parsed.where(wrapped | F.col("_kind").rlike("^(OBJECT|ARRAY)")).select(*others, doc, wrapped.alias("_wrapped")), "documents", by=("_wrapped", *by)).df
        parts.append(held.where("not _wrapped").drop("_wrapped"))
        todo = held.where("_wrapped").select(*others, F.try_variant_get(doc, "$", "string").alias(body))
        if todo.limit(1).count() == 0:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, wherever f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


@dataclass
class Place:
    """A place in the merged tree. An array place has no fields of its own: lone elements are merged into `item`."""

    kinds: set[str] = field(default_factory=set)  # str int float bool null object array
    below: dict[str, Place] = field(default_factory=dict)
    item: Place | None = None
    entry: Place | None = None

    @property
    def many(self) -> bool:
        return "array" in self.kinds

    def at(self, *names: str) -> Place | None:
        """The place some fields on, arrays and maps on the way being passed through."""
        p = self
        for n in names:
            while p and (p.many or p.entry):
                p = p.item if p.many else p.entry
            p = p.below.get(n) if p else None
        return p

    def scalar_type(self) -> str | None:
        if self.many:
            return self.item.scalar_type()
        k = self.kinds & {"str", "int", "float", "bool"}
        if not k:
            return None
        if k == {"int"}:
            return "bigint"
        if k <= {"int", "float"}:
            return "double"
        return "boolean" if k == {"bool"} else "string"

    def merge(self, other: Place) -> None:
        self.kinds |= other.kinds
        for n, p in other.below.items():
            self.below.setdefault(n, Place()).merge(p)
        for x in ("item", "entry"):
            if theirs := getattr(other, x):
                if getattr(self, x) is None:
                    setattr(self, x, Place())
                getattr(self, x).merge(theirs)

    def settle(self) -> Place:
        """Lone elements become elements; a map's fields become entries."""
        if self.entry is not None:  # what else is known of the same keys
            for p in self.below.values():
                self.entry.merge(p)
            self.below = {}
        if self.many:
            lone = Place(self.kinds - {"array", "null"}, self.below, None, self.entry)
            self.kinds, self.below, self.entry = {"array"}, {}, None
            self.item = self.item or Place()
            self.item.merge(lone)
        for p in [*self.below.values(), self.item, self.entry]:
            if p is not None:
                p.settle()
        return self


_KIND = {str: "str", int: "int", float: "float", bool: "bool", type(None): "null", dict: "object", list: "array"}


def _see(x: object, seen: set[tuple[tuple[str, ...], str]]) -> None:
    todo: list[tuple[object, tuple[str, ...]]] = [(x, ())]
    while todo:
        v, p = todo.pop()
        seen.add((p, _KIND[type(v)]))
        if isinstance(v, dict):
            todo += [(y, (*p, NAMED + k)) for k, y in v.items()]
        elif isinstance(v, list):
            inside = (*p, ITEM)
            todo += [(y, inside) for y in v]


def _fold(rows: set[tuple[str, tuple[str, ...], str]]) -> set[tuple[str, tuple[str, ...], str]]:
    """Keys of maps replaced by ENTRY, level by level from the top."""
    id_key = re.compile(ID_KEY)
    for level in range(max((len(p) for _, p, _ in rows), default=0)):
        names: dict[tuple[str, tuple[str, ...]], set[str]] = {}
        for by, p, _ in rows:
            if len(p) > level and p[level].startswith(NAMED):
                names.setdefault((by, p[:level]), set()).add(p[level][1:])
        maps = {at for at, ns in names.items() if len(ns) > FIELDS or all(id_key.match(n) for n in ns)}
        rows = {(by, (*p[:level], ENTRY, *p[level + 1 :]) if len(p) > level and p[level].startswith(NAMED) and (by, p[:level]) in maps else p, k) for by, p, k in rows}
    return rows


def _fold_wide(found: DataFrame) -> DataFrame:
    """The same over a table (by, path, kind) that may be larger than the driver."""
    now = Staged(found, "places")
    for level in range(now.df.agg(F.max(F.size("path"))).first()[0] or 0):
        here, up = F.get("path", F.lit(level)), F.slice("path", 1, level)
        named = F.col("path").isNotNull() & (F.size("path") > level) & here.startswith(NAMED)
        names = now.df.where(named).select("by", up.alias("up"), F.substring(here, 2, 1 << 30).alias("name")).distinct()
        maps = names.groupBy("by", "up").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("name").rlike(ID_KEY)).alias("ids")).where((F.col("n") > FIELDS) | F.col("ids")).select("by", "up", F.lit(True).alias("is_map"))
        j = now.df.withColumn("up", up).join(maps, ["by", "up"], "left")
        folded = F.concat("up", F.array(F.lit(ENTRY)), F.slice("path", level + 2, F.greatest(F.size("path") - level - 1, F.lit(0))))
        nxt = Staged(j.select("by", F.when(named & F.col("is_map"), folded).otherwise(F.col("path")).alias("path"), "kind").distinct(), "places")
        now.drop()
        now = nxt
    return now.df


def infer_schema(docs: DataFrame, doc: str, by: str, places: int = PLACES) -> dict[str, Place]:
    """Merged tree of all documents for each value of `by`; one pass, and only distinct (place, kind) leave a task.

    The tree is as large as the variety of fields, not as the data. Free-form keys make their object a map, whose values
    share one place, so names that are data do not reach the driver: what is collected has at most `places` rows."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, set] = {}
            for k, js in zip(b["by"], b["js"]):
                if js is not None and k is not None:
                    _see(json.loads(js), seen.setdefault(k, set()))
            yield pd.DataFrame([(k, list(p), kind) for k, s in seen.items() for p, kind in s], columns=["by", "path", "kind"])

    found = docs.select(F.col(by).alias("by"), F.to_json(doc).alias("js")).mapInPandas(walk, "by string, path array<string>, kind string").distinct()
    found = found.persist()
    try:
        rows = found.limit(places + 1).collect()
        if len(rows) <= places:
            seen = _fold({(r["by"], tuple(r["path"]), r["kind"]) for r in rows})
        else:
            few = _fold_wide(found).limit(PLACES + 1).collect()
            if len(few) > PLACES:
                raise ValueError(f"more than {PLACES} places, maps aside: no set of tables")
            seen = {(r["by"], tuple(r["path"]), r["kind"]) for r in few}
    finally:
        found.unpersist()
    trees: dict[str, Place] = {}
    for k, path, kind in seen:
        p = trees.setdefault(k, Place())
        for step in path:
            if step == ITEM:
                p.item = p = p.item or Place()
            elif step == ENTRY:
                p.entry = p = p.entry or Place()
            else:
                p = p.below.setdefault(step[1:], Place())
        p.kinds.add(kind)
    return {k: p.settle() for k, p in trees.items()}


@dataclass
class At:
    """Where a value is: a JSON path in a variant column."""

    v: Column
    path: str = "$"

    def field(self, name: str) -> At:
        if re.fullmatch(r"[A-Za-z_]\w*", name, re.A):
            return At(self.v, f"{self.path}.{name}")
        if name and not re.search(r"['\\?\[\]]", name):
            return At(self.v, f"{self.path}['{name}']")
        # no path can say this name
        return At(F.try_element_at(F.try_variant_get(self.v, self.path, "map<string,variant>"), F.lit(name)))

    def get(self, t: str = "variant") -> Column:
        return F.try_variant_get(self.v, self.path, t)

    def scalar(self, place: Place) -> Column:
        """The scalar at a place; objects and arrays that share it are none."""
        t = place.scalar_type()
        if not place.kinds & {"object", "array"}:
            return self.get(t)
        return bind(self.get(), lambda x: F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(x, "$", t)))


def elements(v: Column) -> Column:
    """The elements of a variant array; a value that is none is the only element of one; null for absent and null."""
    return bind(v, lambda x: F.when(x.isNotNull() & ~F.is_variant_null(x), F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))


@dataclass
class Table:
    """A flat table.

    df has the kept columns of the document, _parent_key, _parent_pos, _row_key, _pos (from 0), _map_key (of map entries,
    which are in the order of their keys), the scalars, and _v, the value the row is about. columns: the column of each
    path of fields; () is the value itself where it is a scalar. Names are made of the path, with a number where that
    would clash (case does not count, as columns have none)."""

    df: DataFrame
    place: Place
    columns: dict[tuple[str, ...], str]

    def col(self, *path: str) -> Column:
        """The column of a path, or null where no record has it."""
        return F.col(f"`{self.columns[path]}`") if path in self.columns else F.lit(None).cast("string")


ENGINE = ("_parent_key", "_parent_pos", "_row_key", "_pos", "_map_key", "_v")


def _scalars(place: Place, at: At, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Column]]:
    """Scalars that are reached by fields alone."""
    if place.many or place.entry is not None and path:
        return []
    out = [(path, at.scalar(place))] if place.scalar_type() else []
    if place.entry is None:
        for n in sorted(place.below):
            out += _scalars(place.below[n], at.field(n), (*path, n))
    return out


def _table(rows: DataFrame, place: Place, keep: list[str]) -> Table:
    """rows: keep, the engine's columns and those of the parent that are carried."""
    taken = {c.lower() for c in (*rows.columns, *ENGINE)}
    columns, cols = {}, []
    for path, c in _scalars(place, At(F.col("_v"))):
        name = base = re.sub(r"\W", "_", "_".join(path), flags=re.A) if path else "_value"
        base = base or "_"
        name, k = base, 1
        while name.lower() in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name.lower())
        columns[path] = name
        cols.append(c.alias(name))
    front = [c for c in rows.columns if c != "_v"]
    return Table(rows.select(*front, *cols, "_v"), place, columns)


def _child(parent: Table, at: At, place: Place, keep: list[str], carry: dict[str, tuple[str, ...]]) -> Table:
    """The table of the array or map at a place below the parent's rows."""
    up = [parent.col(*p).cast("string").alias(f"_parent_{n}") for n, p in carry.items() if p in parent.columns]
    base = [*keep, F.col("_row_key").alias("_parent_key"), F.col("_pos").alias("_parent_pos"), *up]
    if place.many:
        e = parent.df.select(*base, F.posexplode(elements(at.get())).alias("_pos", "_v")).where(~F.is_variant_null("_v"))
        inner, key = place.item, []
    else:
        e = parent.df.select(*base, F.posexplode(F.map_entries(at.get("map<string,variant>"))).alias("_pos", "_e"))
        e = e.select("*", F.col("_e.key").alias("_map_key"), F.col("_e.value").alias("_v")).drop("_e")
        inner, key = place.entry, ["_map_key"]
    front = [c for c in e.columns if c not in ("_pos", "_v", "_map_key")]
    return _table(e.select(*front, F.concat_ws("/", "_parent_key", "_pos").alias("_row_key"), "_pos", *key, "_v"), inner, keep)


def tables(docs: DataFrame, tree: Place, keep: list[str], doc: str = "doc", key: str = "doc_key", carry: dict[str, tuple[str, ...]] | None = None) -> dict[str, Table]:
    """All tables of a tree: '$' (one row a document, or an element of a document that is an array), and one for each
    level of arrays (named by the dotted path, with '.[]' for each further level) and each map (its path and '.{}').

    keep: columns of docs in every table. carry: scalars of a row, by path, that its children get as _parent_<name>.
    Null array elements keep their place and give no row; a map entry that is null has one."""
    carry = carry or {}
    whole = docs.select(*keep, F.col(key).alias("_row_key"), F.lit(0).alias("_pos"), F.col(doc).alias("_v"))
    lone = tree if tree.many else Place({"array"}, item=tree)
    root = _child(Table(whole, lone, {}), At(F.col("_v")), lone, keep, carry)
    out = {"$": root}

    def go(t: Table, place: Place, at: At, name: str) -> None:
        if place.many:
            name = name if name not in out and name else f"{name or '$'}.{ITEM}"
            out[name] = _child(t, at, place, keep, carry)
            go(out[name], place.item, At(F.col("_v")), name)
            return
        if place.entry is not None:
            name = f"{name or '$'}.{ENTRY}"
            out[name] = _child(t, at, place, keep, carry)
            go(out[name], place.entry, At(F.col("_v")), name)
            return
        for n in sorted(place.below):
            go(t, place.below[n], at.field(n), f"{name}.{n}" if name else n)

    go(root, lone.item, At(F.col("_v")), "")
    return out
