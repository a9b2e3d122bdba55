"""Enums, free ids, shared values, dictionaries, bit masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..cluster import cut, with_position
from ..contract import Dataset, TableContract, error_rows, union_all
from ..functions.scalars import pack_id


def declared_enum(spark, values: Sequence[tuple]) -> DataFrame:
    """Enum table from declared ``(name[, number], comment)`` rows."""
    rows = [(v[0], v[1] if len(v) > 2 else i, v[-1]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "name string, number int, comment string")


def encode_enum(df: DataFrame, column: str, enum: DataFrame, contract: TableContract,
                out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the enum number, errors for unknown names); ``enum(name, number)``."""
    codes = enum.select(F.col("name").alias("_name"), F.col("number").alias("_number"))
    joined = df.join(codes, df[column] == codes["_name"], "left")
    encoded = joined.withColumn(out or f"{column}_code", F.col("_number")).drop("_name", "_number")
    unknown = df.join(codes, df[column] == codes["_name"], "left_anti")
    errors = error_rows(unknown, C.REF_NOT_FOUND, contract.name, pack_id(df.schema, contract.key), column, F.col(column))
    return encoded, errors


def table_counts(dataset: Dataset) -> DataFrame:
    """Records per table; Parquet answers from file footers."""
    return union_all(dataset.frames[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
                     for n in dataset.names())


def next_free_id(df: DataFrame, key: str, current: int) -> DataFrame:
    """Smallest unused integer above ``current``: the least id + 1 that is not an id."""
    ids = df.select(F.col(key).cast("long").alias("id")).where(F.col("id") > current).distinct()
    start = df.sparkSession.createDataFrame([(current,)], "id long")
    after = start.unionByName(ids).select((F.col("id") + 1).alias("id"))
    return after.join(ids, "id", "left_anti").agg(F.min("id").alias("next_id"))


def _children(kind, c: Column, dtype: T.DataType):
    """Direct nested values of a value: (kind, column, type, is an array of them)."""
    def one(k, v, t):
        if isinstance(k, str):
            return []
        return [(k, v, t)]
    if isinstance(kind, (C.Struct, TableContract)):
        get = (lambda n: F.col(n)) if c is None else (lambda n: c[n])
        names = dtype.names
        return [(f.type, get(f.name), dtype[f.name].dataType, False) for f in kind.fields
                if not isinstance(f.type, str) and f.name in names]
    if isinstance(kind, C.Union):
        out = []
        for i in kind.impls:
            for k, v, t, many in _children(i, c[i.name], dtype[i.name].dataType):
                out.append((k, v, t, many))
        return out
    if isinstance(kind, C.ListOf):
        return [] if isinstance(kind.item, str) else [(kind.item, c, dtype.elementType, True)]
    out = []
    entry = dtype.elementType
    for part, k in (("key", kind.key), ("value", kind.value)):
        if not isinstance(k, str):
            out.append((k, F.transform(c, lambda e: e[part]), entry[part].dataType, True))
    return out


def _name(kind) -> str:
    if isinstance(kind, C.ListOf):
        return f"list<{kind.item if isinstance(kind.item, str) else _name(kind.item)}>"
    if isinstance(kind, C.MapOf):
        side = lambda k: k if isinstance(k, str) else _name(k)
        return f"map<{side(kind.key)},{side(kind.value)}>"
    return kind.name


def shared_values(df: DataFrame, contract: TableContract) -> DataFrame:
    """``(type, value, n, saved)`` of nested values that occur more than once.

    Level by level: the values of all records first, then those inside each distinct
    value, which is opened once however often it occurs.  Empty lists and maps do not
    count.  The depth of the contract bounds the levels.
    """
    level: dict[str, list] = {}
    for k, v, t, many in _children(contract, None, df.schema):
        level.setdefault(_name(k), []).append((k, t, df.select(v.alias("v"))))
    seen: dict[str, DataFrame] = {}
    counts = []
    while level:
        following: dict[str, list] = {}
        for name, parts in level.items():
            kind, dtype = parts[0][0], parts[0][1]
            values = union_all(p[2] for p in parts).where(F.col("v").isNotNull())
            if isinstance(kind, (C.ListOf, C.MapOf)):
                values = values.where(F.size("v") > 0)
            tagged = values.withColumn("value", F.to_json("v"))
            # Distinct values with counts: combined before the shuffle.
            grouped = cut(tagged.groupBy("value").agg(F.count("*").alias("n"), F.any_value("v").alias("v")), "shared")
            counts.append(grouped.select(F.lit(name).alias("type"), "value", "n"))
            fresh = grouped
            if name in seen:
                fresh = grouped.join(seen[name], "value", "left_anti")
                seen[name] = seen[name].unionByName(fresh.select("value"))
            else:
                seen[name] = grouped.select("value")
            for k, v, t, many in _children(kind, F.col("v"), dtype):
                inner = fresh.select((F.explode(v) if many else v).alias("v"))
                following.setdefault(_name(k), []).append((k, t, inner))
        level = following
    total = union_all(counts).groupBy("type", "value").agg(F.sum("n").alias("n"))
    return total.where("n > 1").withColumn("saved", F.col("n") - 1)


def string_dictionary(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(dictionary ``(value, index)`` in first-seen order, rows with ``<column>_idx``).

    First seen means smallest (row order, column).  Each value's first place is a
    partial aggregate; only distinct values are ever sorted.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("value"))
                                for i, c in enumerate(columns)]))
    places = df.select(*order_by, cells.alias("x")).where(F.col("x.value").isNotNull())
    first = places.groupBy(F.col("x.value").alias("value")).agg(
        F.min(F.struct(*order_by, F.col("x.c").alias("_c"))).alias("_first"))
    # Written, so that its size decides whether rows look it up in memory.
    words = cut(with_position(first, ["_first", "value"], "index").select("value", "index"), "words")
    out = df
    for c in columns:
        mine = words.select(F.col("value").alias("_v"), F.col("index").alias(f"{c}_idx"))
        out = out.join(mine, out[c].cast("string") == F.col("_v"), "left").drop("_v")
    return words, out


def text_dictionaries(matrix: DataFrame, langs: Sequence[str], order_by: Sequence[str]) -> dict[str, DataFrame]:
    """One dictionary ``(value, index)`` per language column of a translations matrix, in first-seen order.

    Texts may be long: they are told apart and put in order by their SHA-256 and first place, and each text then moves once, from the row
    that shows it first.
    """
    matrix = cut(matrix.select(*order_by, *langs), "matrix")
    return {lang: _long_words(matrix.select(F.struct(*order_by).alias("_place"), F.col(lang).cast("string").alias("value"))) for lang in langs}


def _long_words(places: DataFrame) -> DataFrame:
    places = places.where(F.col("value").isNotNull()).withColumn("_h", F.unhex(F.sha2("value", 256)))
    firsts = cut(places.groupBy("_h").agg(F.min("_place").alias("_first")), "firsts")
    order = ["_first"]
    tied = cut(firsts.groupBy("_first").agg(F.count("*").alias("_n")).where("_n > 1").select("_first"), "tied")

    def first_rows(of: DataFrame) -> DataFrame:
        """The row with its text at the first place of every digest; repeated rows once."""
        of = of.withColumnRenamed("_h", "_k")
        rows = places.join(of, (F.col("_h") == F.col("_k")) & (F.col("_place") == F.col("_first")))
        rest = [c for c in rows.columns if c not in ("_h", "_place", "_k", "_first")]
        return rows.groupBy("_h", "_place").agg(*[F.any_value(c).alias(c) for c in rest])

    if not tied.isEmpty():
        # Rows with the same place: their texts decide, as only there they have to.
        texts = first_rows(firsts.join(tied, "_first", "left_semi")).select("_h", F.col("value").alias("_tie"))
        firsts, order = firsts.join(texts, "_h", "left"), ["_first", "_tie"]
    return first_rows(with_position(firsts, order, "index").select("_h", "_first", "index")).select("value", "index")


def pack_bools(df: DataFrame, columns: Sequence[str], out: str = "flags") -> DataFrame:
    """Flags to one bit mask, first column in the lowest bit."""
    if len(columns) < 2:
        return df
    if len(columns) >= 50:
        raise ValueError("at most 49 flags fit one mask")
    mask = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        mask = mask + F.shiftleft(F.coalesce(F.col(c), F.lit(False)).cast("long"), i)
    return df.withColumn(out, mask).drop(*columns)
