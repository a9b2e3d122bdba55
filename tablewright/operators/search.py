"""Every primitive value of every record as rows, and searches over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..contract import Dataset, TableContract, union_all
from ..functions.scalars import number_text, pack_id
from .recursive import STEP, Shape, leaves_of, opened

LEAF = "array<struct<field_chain:string,type:string,value:string>>"
NOTE = "$note"


def _text(c: Column, kind: str) -> Column:
    return number_text(c) if kind == "float" else c.cast("string")


def _chain(path: Column | None, name) -> Column:
    name = name if isinstance(name, Column) else F.lit(name)
    return name if path is None else F.concat(path, F.lit("."), name)


def _leaf(path: Column, kind: str, value: Column) -> Column:
    return F.array(F.struct(path.alias("field_chain"), F.lit(kind).alias("type"), value.alias("value"))).cast(LEAF)


def _leaves_of(c: Column, kind, path: Column, kinds: frozenset | None) -> Column:
    """Array of leaves of one value; NULL values have none."""
    none = F.array().cast(LEAF)
    if isinstance(kind, str):
        if kinds is not None and kind not in kinds:
            return none
        return F.when(c.isNotNull(), _leaf(path, kind, _text(c, kind))).otherwise(none)
    if isinstance(kind, C.ListOf):
        parts = F.transform(c, lambda e, i: _leaves_of(e, kind.item, _chain(path, i.cast("string")), kinds))
        return F.coalesce(F.flatten(parts), none)
    if isinstance(kind, C.MapOf):
        def entry(e, i):
            n = i.cast("string")
            return F.concat(_leaves_of(e["key"], kind.key, _chain(path, F.concat(n, F.lit("k"))), kinds),
                            _leaves_of(e["value"], kind.value, _chain(path, F.concat(n, F.lit("v"))), kinds))
        return F.coalesce(F.flatten(F.transform(c, entry)), none)
    if isinstance(kind, C.Union) and kind.recursive:
        return none
    if isinstance(kind, C.Union):
        name = _leaf(path, "str", c["type"]) if kinds is None or "str" in kinds else none
        parts = [F.when(c["type"] == i.name, _leaves_of(c[i.name], i, path, kinds)).otherwise(none) for i in kind.impls]
        return F.when(c["type"].isNotNull(), F.concat(name, *parts)).otherwise(none)
    parts = [_leaves_of(c[f.name], f.type, _chain(path, f.name), kinds) for f in kind.fields]
    return F.when(c.isNotNull(), F.concat(*parts)).otherwise(none) if parts else none


def text_leaves(c: Column, field: C.Field) -> Column:
    """Array of the text leaves of one field's value."""
    return _leaves_of(c, field.type, F.lit(field.name), frozenset(("text",)))


def leaves(df: DataFrame, contract: TableContract, kinds: Sequence[str] | None = None) -> DataFrame:
    """``(table, pk, field_chain, type, value)``, one row per primitive leaf.

    One pass without a shuffle: each record explodes its own leaves.  ``kinds`` keeps
    other types from being built.  Recursive values come from `variant_leaves`.
    """
    wanted = None if kinds is None else frozenset(kinds)
    parts = []
    recursive = []
    for f in contract.fields:
        kind = f.type
        if isinstance(kind, str):
            if wanted is None or kind in wanted:
                parts.append(_leaves_of(F.col(f.name), kind, F.lit(f.name), wanted))
        elif isinstance(df.schema[f.name].dataType, T.VariantType):
            recursive.append(f.name)
        else:
            entry = F.map_entries(f.name) if isinstance(df.schema[f.name].dataType, T.MapType) else F.col(f.name)
            parts.append(_leaves_of(entry, kind, F.lit(f.name), wanted))
    if NOTE in df.columns and (wanted is None or "str" in wanted):
        note = F.col(f"`{NOTE}`")
        parts.append(F.when(F.coalesce(note, F.lit("")) != "", _leaf(F.lit(NOTE), "str", note)).otherwise(F.array().cast(LEAF)))
    pk = pack_id(df.schema, contract.key)
    out = []
    if parts:
        out.append(df.select(F.lit(contract.name).alias("table"), pk.alias("pk"),
                             F.explode(F.concat(*parts)).alias("l")).select("table", "pk", "l.*"))
    for name in recursive:
        found = variant_leaves(df.select(pk.alias("pk"), F.col(name).alias("v")), name, contract.field(name).type)
        if wanted is not None:
            found = found.where(F.col("type").isin(*wanted))
        out.append(found.select(F.lit(contract.name).alias("table"), "pk", "field_chain", "type", "value"))
    return union_all(out)


def variant_leaves(df: DataFrame, root: str, kind: C.Union | None = None) -> DataFrame:
    """Leaves of ``v`` (VARIANT) per ``pk``: ``(pk, field_chain, type, value)``, typed by the union where its contract knows them.

    Each round opens one level of all values; the depth of the data bounds the rounds.  ``$type`` becomes a leaf at its
    object's own path.
    """
    levels = opened(df.select("pk", F.col("v").alias("_v")), ["pk"], Shape(kind or C.Union(root, ())), F.lit(root))
    path = F.replace(F.regexp_replace("_at", STEP + r"\$type$", ""), F.lit(STEP), F.lit("."))
    return leaves_of(levels, ["pk"]).select("pk", path.alias("field_chain"), "type", F.try_variant_get("_v", "$", "string").alias("value"))


def visit_leaves(dataset: Dataset, fn: Callable[[DataFrame], DataFrame], tables: Sequence[str] | None = None) -> DataFrame:
    """Run a user expression over all leaves of the dataset."""
    names = list(tables) if tables is not None else dataset.names()
    return fn(union_all(leaves(dataset.frames[n], dataset.contracts[n]) for n in names))


def query_kind(q: str | None) -> str:
    """``qNotSet`` for a blank query, ``number`` for one that reads as an integer, else ``text``."""
    if q is None or not q.strip():
        return "qNotSet"
    text = q.strip()
    try:
        int(text, 16 if text.lower().startswith("0x") else 10)
        return "number"
    except ValueError:
        return "text"


def _top(found: DataFrame, n: int) -> DataFrame:
    """First ``n`` hits in table, record and field order; all of them when ``n`` is 0."""
    found = found.select("table", "pk", "field_chain", "value")
    return found.orderBy("table", "pk", "field_chain").limit(n) if n > 0 else found


def search_text(dataset: Dataset, q: str, n: int = 0, table: str | None = None) -> DataFrame:
    """Case-sensitive substring of text leaves; an integer-looking query searches numbers."""
    kind = query_kind(q)
    if kind == "number":
        return search_number(dataset, int(q.strip(), 16 if q.strip().lower().startswith("0x") else 10), n, table)
    spark = next(iter(dataset.frames.values())).sparkSession
    if kind == "qNotSet":
        return spark.createDataFrame([], "`table` string, pk string, field_chain string, value string")
    return search_strings(dataset, q, n, table)


def search_strings(dataset: Dataset, q: str, n: int = 0, table: str | None = None) -> DataFrame:
    out = []
    for name in [table] if table else dataset.names():
        df, contract = dataset.frames[name], dataset.contracts[name]
        flat = [f.name for f in contract.fields if f.type in ("str", "text")]
        if all(isinstance(f.type, str) for f in contract.fields):
            if not flat:
                continue
            # Only rows with a hit are opened at all.
            any_hit = F.lit(False)
            for c in flat:
                any_hit = any_hit | F.contains(F.col(c).cast("string"), F.lit(q))
            df = df.where(any_hit)
        out.append(leaves(df, contract, ("str", "text")).where(F.contains("value", F.lit(q))))
    return _top(union_all(out), n)


def search_number(dataset: Dataset, value: int, n: int = 0, table: str | None = None) -> DataFrame:
    """Exact match on int and long leaves; never on floats."""
    out = []
    for name in [table] if table else dataset.names():
        df, contract = dataset.frames[name], dataset.contracts[name]
        if all(isinstance(f.type, str) for f in contract.fields):
            any_hit = None
            for f in contract.fields:
                if f.type in ("int", "long"):
                    test = F.col(f.name) == F.lit(value)
                    any_hit = test if any_hit is None else any_hit | test
            if any_hit is None:
                continue
            df = df.where(any_hit)
        out.append(leaves(df, contract, ("int", "long")).where(F.col("value") == str(value)))
    return _top(union_all(out), n)
