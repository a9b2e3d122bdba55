"""Record level projections: ids, titles, pages, cell addresses, tag subsets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..contract import Dataset, TableContract
from ..functions.scalars import csv_escape, pack_id, pack_value


def brief_title(contract: TableContract) -> Column:
    """``Enum: title``; the enum name only where it is not the key itself."""
    title = F.col(contract.title).cast("string") if contract.title else F.lit(None).cast("string")
    if contract.is_enum and contract.entry and contract.key[0] != contract.entry:
        enum = F.col(contract.entry)
        return F.when(title.isNull(), enum).otherwise(F.concat(enum, F.lit(": "), title))
    return title


def brief(df: DataFrame, contract: TableContract) -> DataFrame:
    """``(id, title, descriptions)``; a description carries its field's comment."""
    parts = [F.struct(F.lit(n).alias("field"), pack_value(n, df.schema[n].dataType).alias("value"),
                      F.lit(contract.field(n).comment).alias("comment")) for n in contract.description]
    shape = "array<struct<field:string,value:string,comment:string>>"
    return df.select(pack_id(df.schema, contract.key).alias("id"), brief_title(contract).alias("title"),
                     (F.array(*parts) if parts else F.lit(None)).cast(shape).alias("descriptions"))


def parse_id(record_id: str, schema: T.StructType, key: Sequence[str]) -> list:
    """Key values of a packed id; ``;`` and ``,`` both separate the parts."""
    parts = [record_id] if len(key) == 1 else record_id.replace(",", ";").split(";")
    if len(parts) != len(key):
        raise ValueError(f"id {record_id!r} needs {len(key)} parts")
    out = []
    for text, name in zip(parts, key):
        dtype = schema[name].dataType
        if isinstance(dtype, (T.IntegerType, T.LongType)):
            out.append(int(text, 16) if text.lower().startswith("0x") else int(text))
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            out.append(float(text))
        else:
            out.append(text)
    return out


def get_record(df: DataFrame, contract: TableContract, record_id: str) -> DataFrame:
    """Row with this id; typed key predicates reach the Parquet scan."""
    values = parse_id(record_id, df.schema, contract.key)
    cond = F.lit(True)
    for name, value in zip(contract.key, values):
        cond = cond & (F.col(name) == F.lit(value).cast(df.schema[name].dataType))
    return df.where(cond)


def list_records(df: DataFrame, contract: TableContract, fields: Sequence[str] = (), offset: int = 0,
                 limit: int = 100) -> DataFrame:
    """One page in key order: key, enum name, title and the asked fields."""
    names = list(dict.fromkeys([*contract.key, *([contract.entry] if contract.entry else []),
                                *([contract.title] if contract.title else []), *fields]))
    return df.select(*names).orderBy(*contract.key).offset(offset).limit(limit)


def to_csv_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row as one CSV line."""
    columns = columns or df.columns
    cells = [csv_escape(F.coalesce(pack_value(c, df.schema[c].dataType), F.lit(""))) for c in columns]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def order_by_pk(df: DataFrame, contract: TableContract, row: str | None = None) -> DataFrame:
    """Key order for a single int key, input row order otherwise."""
    if len(contract.key) == 1 and isinstance(df.schema[contract.key[0]].dataType, T.IntegerType):
        return df.orderBy(contract.key[0])
    return df.orderBy(row) if row else df


def column_letters(index: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def with_lineage(df: DataFrame, column: int, name: str = "address", swapped: bool = False) -> DataFrame:
    """Cell address ``file#sheet!B12`` of a grid column; swapped tables exchange the axes."""
    sheet = F.col("_sheet") if "_sheet" in df.columns else F.lit("")
    head = F.concat(F.col("_file"), F.lit("#"), sheet, F.lit("!"))
    if not swapped:
        return df.withColumn(name, F.concat(head, F.lit(column_letters(column)), (F.col("_row") + 1).cast("string")))
    return df.withColumn(name, F.concat(head, letters_of("_row"), F.lit(str(column + 1))))


def letters_of(c: str) -> Column:
    """Spreadsheet letters of a 0-based column number held in a column, of any length."""
    # Digits run from 1 to 26, so each step takes one off first; 14 letters hold every long.
    start = F.struct((F.col(c).cast("long") + 1).alias("n"), F.lit("").alias("s"))
    step = lambda at, _: F.when(at["n"] <= 0, at).otherwise(F.struct(
        ((at["n"] - 1 - (at["n"] - 1) % 26) / 26).cast("long").alias("n"),
        F.concat(F.char(F.lit(65) + (at["n"] - 1) % 26), at["s"]).alias("s")).cast("struct<n:bigint,s:string>"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start.cast("struct<n:bigint,s:string>"), step)
    return done["s"]


# ------------------------------------------------------------ tag subsets

def _kept_fields(fields, tag: str):
    if tag.startswith("-"):
        return tuple(f for f in fields if tag[1:] not in f.tags)
    if any(tag in f.tags for f in fields):
        return tuple(f for f in fields if tag in f.tags)
    if any("-" + tag in f.tags for f in fields):
        return tuple(f for f in fields if "-" + tag not in f.tags)
    return tuple(fields)


def _has(tags: frozenset, tag: str) -> bool:
    return tag[1:] not in tags if tag.startswith("-") else tag in tags


def _kind_subset(kind, tag: str):
    if isinstance(kind, C.ListOf):
        item = _kind_subset(kind.item, tag)
        return None if item is None else C.ListOf(item)
    if isinstance(kind, C.MapOf):
        k, v = _kind_subset(kind.key, tag), _kind_subset(kind.value, tag)
        return None if k is None or v is None else C.MapOf(k, v)
    if isinstance(kind, C.Struct):
        return _struct_subset(kind, tag) if _has(kind.tags, tag) else None
    if isinstance(kind, C.Union):
        if not _has(kind.tags, tag):
            return None
        # Implementations stay in the union; one whose tag has no tagged field keeps none.
        impls = []
        for i in kind.impls:
            if tag.startswith("-"):
                if tag[1:] not in i.tags:
                    impls.append(_struct_subset(i, tag))
            elif tag in i.tags and not any(tag in f.tags for f in i.fields):
                impls.append(replace(i, fields=(), fks=()))
            else:
                impls.append(_struct_subset(i, tag))
        return replace(kind, impls=tuple(impls))
    return kind


def _struct_subset(struct, tag: str):
    kept = []
    for f in _kept_fields(struct.fields, tag):
        kind = _kind_subset(f.type, tag)
        if kind is not None:
            kept.append(replace(f, type=kind))
    names = {f.name for f in kept}
    return replace(struct, fields=tuple(kept), fks=tuple(fk for fk in struct.fks if set(fk.keys) <= names))


def project_tag(dataset: Dataset, tag: str) -> Dataset:
    """Subset of the dataset for a tag.

    ``t`` keeps tables tagged ``t`` and in them the fields tagged ``t``; without such
    fields all but those tagged ``-t``.  ``-t`` drops whatever is tagged ``t``.  Keys and
    references that lose a column or their target go too.
    """
    contracts = {}
    for name, c in dataset.contracts.items():
        if _has(c.tags, tag):
            sub = _struct_subset(c, tag)
            # A table cannot exist without its key.
            lost = [f for f in c.fields if f.name in c.key and f.name not in {g.name for g in sub.fields}]
            contracts[name] = replace(sub, fields=tuple(lost) + sub.fields)
    out = {}
    for name, c in contracts.items():
        names = {f.name for f in c.fields}

        def target_ok(fk):
            goal = contracts.get(fk.ref_table)
            return goal is not None and set(fk.ref_keys) <= {f.name for f in goal.fields}

        out[name] = replace(
            c, fks=tuple(fk for fk in c.fks if set(fk.keys) <= names and target_ok(fk)),
            uniques=tuple(u for u in c.uniques if set(u) <= names),
            entry=c.entry if c.entry in names else None, is_enum=c.is_enum and c.entry in names,
            title=c.title if c.title in names else None,
            description=tuple(d for d in c.description if d in names))
    frames = {n: dataset.frames[n].select(*[_prune(F.col(f.name), f.type).alias(f.name) for f in out[n].fields])
              for n in out if n in dataset.frames}
    return Dataset(out, frames)


def _prune(c: Column, kind) -> Column:
    """Rebuild a nested value with the kept fields only; Parquet then skips the rest."""
    if isinstance(kind, C.ListOf) and not isinstance(kind.item, str):
        return F.transform(c, lambda e: _prune(e, kind.item))
    if isinstance(kind, C.Struct) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*[_prune(c[f.name], f.type).alias(f.name) for f in kind.fields]))
    return c
