"""Table contracts: what a dataset promises about its tables.

A contract lives on the driver and is small.  Every operator turns it into Spark
expressions once; no contract object ever travels with the rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The six primitive types and the Spark type that holds each.
PRIMITIVES = {
    "bool": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.DoubleType(),
    "str": T.StringType(),
    "text": T.StringType(),
}


@dataclass(frozen=True)
class ListOf:
    item: object


@dataclass(frozen=True)
class MapOf:
    key: object
    value: object


@dataclass(frozen=True)
class ForeignKey:
    """``keys`` of this table point at ``ref_keys`` of ``ref_table``.

    ``to_many`` marks a reference that collects every matching row; such a reference
    is never validated.  ``title`` names a field whose value labels the edge.
    """

    name: str
    keys: tuple[str, ...]
    ref_table: str
    ref_keys: tuple[str, ...]
    nullable: bool = False
    to_many: bool = False
    title: str | None = None


@dataclass(frozen=True)
class Field:
    """``layout`` says how the value sits in a grid: ``auto``, ``pack``, ``sep``,
    ``fix`` or ``block``; ``width`` is the N of fix/block, ``sep`` the separator."""

    name: str
    type: object
    layout: str = "auto"
    width: int = 1
    sep: str = ";"
    comment: str = ""
    must_fill: bool = False
    lowercase: bool = False
    seq: bool = False
    tags: frozenset = frozenset()


@dataclass(frozen=True)
class Struct:
    name: str
    fields: tuple[Field, ...]
    fks: tuple[ForeignKey, ...] = ()
    layout: str = "auto"
    sep: str = ","
    tags: frozenset = frozenset()

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)


@dataclass(frozen=True)
class Union:
    """A tagged choice between structs.  Typed as ``struct<type, impl1 struct, ...>``
    unless ``recursive``, which is kept as VARIANT with a ``$type`` member."""

    name: str
    impls: tuple[Struct, ...]
    default: str | None = None
    layout: str = "auto"
    recursive: bool = False
    tags: frozenset = frozenset()

    def impl(self, name: str) -> Struct:
        return next(i for i in self.impls if i.name == name)


@dataclass(frozen=True)
class TableContract:
    """``order`` gives the columns that define row order inside the table; without it
    the order is taken from all non-key columns, so that "last row wins" is defined.
    ``entry`` is the field holding an entry/enum name; ``source`` is grid or json."""

    name: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    fks: tuple[ForeignKey, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    entry: str | None = None
    is_enum: bool = False
    is_root: bool = False
    title: str | None = None
    description: tuple[str, ...] = ()
    source: str = "grid"
    order: tuple[str, ...] = ()
    tags: frozenset = frozenset()
    comment: str = ""

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.type)) for f in self.fields])

    def texts(self) -> list[str]:
        return [f.name for f in self.fields if f.type == "text"]

    def with_fields(self, fields: Iterable[Field]) -> "TableContract":
        return replace(self, fields=tuple(fields))


@dataclass
class Dataset:
    """Contracts plus one DataFrame per table."""

    contracts: dict[str, TableContract]
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def names(self) -> list[str]:
        return sorted(n for n in self.contracts if n in self.frames)

    def swap(self, table: str, frame: DataFrame) -> "Dataset":
        return Dataset(self.contracts, {**self.frames, table: frame})

    def fks(self) -> list[tuple[str, ForeignKey]]:
        return [(n, fk) for n in self.names() for fk in self.contracts[n].fks
                if fk.ref_table in self.frames]

    def fks_touching(self, table: str) -> list[tuple[str, ForeignKey]]:
        return [(n, fk) for n, fk in self.fks() if table in (n, fk.ref_table)]


def spark_type(kind) -> T.DataType:
    if isinstance(kind, str):
        return PRIMITIVES[kind]
    if isinstance(kind, ListOf):
        return T.ArrayType(spark_type(kind.item))
    if isinstance(kind, MapOf):
        # An entry list until duplicate keys have been checked and resolved.
        return T.ArrayType(T.StructType([
            T.StructField("key", spark_type(kind.key)),
            T.StructField("value", spark_type(kind.value))]))
    if isinstance(kind, Union):
        if kind.recursive:
            return T.VariantType()
        return T.StructType([T.StructField("type", T.StringType())] + [
            T.StructField(i.name, spark_type(i)) for i in kind.impls])
    return T.StructType([T.StructField(f.name, spark_type(f.type)) for f in kind.fields])


def span(kind, layout: str = "auto", width: int = 1) -> int:
    """How many grid columns a value of this type takes."""
    if layout in ("pack", "sep"):
        return 1
    if isinstance(kind, ListOf):
        return width * span(kind.item)
    if isinstance(kind, MapOf):
        return width * (span(kind.key) + span(kind.value))
    if isinstance(kind, Union):
        return 1 if kind.layout == "pack" else 1 + max(span(i) for i in kind.impls)
    if isinstance(kind, Struct):
        if kind.layout in ("pack", "sep"):
            return 1
        return sum(field_span(f) for f in kind.fields)
    return 1


def field_span(f: Field) -> int:
    return span(f.type, f.layout, f.width)


def column_of(contract, name: str) -> int:
    """First grid column of a field."""
    at = 0
    for f in contract.fields:
        if f.name == name:
            return at
        at += field_span(f)
    raise KeyError(name)


def structs_of(kind, seen: frozenset = frozenset()):
    """Struct contracts anywhere inside a type or table; recursive unions are walked once."""
    if isinstance(kind, (str, tuple)) or id(kind) in seen:
        return
    seen = seen | {id(kind)}
    if isinstance(kind, Struct):
        yield kind
    inner = [f.type for f in getattr(kind, "fields", ())] + list(getattr(kind, "impls", ()))
    if isinstance(kind, ListOf):
        inner.append(kind.item)
    if isinstance(kind, MapOf):
        inner += [kind.key, kind.value]
    for k in inner:
        yield from structs_of(k, seen)


# ---------------------------------------------------------------- error rows

# The names of the error kinds.
NOT_MATCH_TYPE = "NotMatchFieldType"
SPAN_NOT_ENOUGH = "FieldCellSpanNotEnough"
CELL_NOT_USED = "FieldCellNotUsed"
PARSE_PACK = "ParsePackErr"
IMPL_NOT_FOUND = "InterfaceCellImplNotFound"
MUST_FILL = "MustFillButCellEmpty"
KEY_DUPLICATED = "PrimaryOrUniqueKeyDuplicated"
ENUM_EMPTY = "EnumEmpty"
ENTRY_SPACE = "EntryContainsSpace"
ENTRY_DUPLICATED = "EntryDuplicated"
SEQ_BROKEN = "SeqValueNotContinuous"
MAP_KEY_DUPLICATED = "MapKeyDuplicated"
REF_EMPTY = "RefNotNullableButCellEmpty"
REF_NOT_FOUND = "ForeignValueNotFound"
JSON_FILE_READ = "JsonFileReadErr"
JSON_EMPTY = "JsonStrEmpty"
JSON_PARSE = "JsonParseException"
JSON_TYPE_MISSING = "JsonTypeNotExist"
JSON_TYPE_MISMATCH = "JsonTypeNotMatch"
JSON_VALUE_MISMATCH = "JsonValueNotMatchType"
JSON_EXTRA = "JsonHasExtraFields"

ERROR_COLUMNS = ("err_type", "level", "table", "record_id", "field", "value", "lineage", "msg")
ERROR_SCHEMA = ", ".join(f"`{c}` string" for c in ERROR_COLUMNS)


def error_rows(df: DataFrame, kind, table: str, record_id, field_name, value,
               lineage=None, msg=None, level="error") -> DataFrame:
    """Project any frame to the shared shape of error rows."""
    as_col = lambda v: F.lit(None) if v is None else (F.lit(v) if isinstance(v, str) else v)
    kind = as_col(kind)
    text = msg if msg is not None else F.concat_ws(
        " ", kind, F.lit(table), as_col(field_name).cast("string"))
    parts = (kind, as_col(level), F.lit(table), as_col(record_id), as_col(field_name),
             as_col(value), as_col(lineage), as_col(text))
    return df.select(*[c.cast("string").alias(n) for c, n in zip(parts, ERROR_COLUMNS)])


def no_errors(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ERROR_SCHEMA)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out
