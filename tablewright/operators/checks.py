"""Constraint checks.  Each returns rows in the shared error shape and never stops early."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..cluster import cut, with_position
from ..contract import Dataset, ForeignKey, TableContract, error_rows, no_errors, union_all
from ..functions.scalars import pack_id, pack_value
from .recursive import STEP, Shape, opened
from .typed import from_variant

_CUSTOM: dict[str, Callable[[Dataset], DataFrame]] = {}


def register_check(name: str, fn: Callable[[Dataset], DataFrame]) -> None:
    """Add a user check: dataset in, error rows out.  It runs as part of `validate`."""
    _CUSTOM[name] = fn


def unregister_check(name: str) -> None:
    _CUSTOM.pop(name, None)


def lineage_of(df: DataFrame) -> Column:
    """Cell address of the row when the frame carries one."""
    if "_file" in df.columns:
        sheet = F.col("_sheet") if "_sheet" in df.columns else F.lit("")
        return F.concat(F.col("_file"), F.lit("#"), sheet, F.lit("!"), F.col("_row").cast("string"))
    return F.lit(None).cast("string")


def _sortable(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return F.to_json(F.col(name))
    return F.col(name)


def order_value(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> Column:
    """Comparable struct that fixes row order; all non-key columns unless named."""
    names = list(order) or [c for c in df.columns if c not in key]
    # A leading constant keeps the struct non-empty for tables that are all key.
    return F.struct(F.lit(0).alias("_0"), *[
        _sortable(n, df.schema[n].dataType).alias(f"o{i}") for i, n in enumerate(names)])


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, written out so that their size is known.

    Counting is partially aggregated before the shuffle, so a key that holds a large
    share of the rows costs one row per task.
    """
    counts = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    return cut(counts, "repeated")


def _match(df: DataFrame, other: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the key with NULL equal to NULL (an empty key cell is a value too)."""
    renamed = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                           *[c for c in other.columns if c not in key])
    on = [df[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(key)]
    joined = df.join(renamed, on, how)
    return joined.drop(*[f"_k{i}" for i in range(len(key))])


_CHUNK = 10_000


def _repeat(df: DataFrame, times: Column, key: Sequence[str]) -> DataFrame:
    """Each row ``times`` times; big counts are spread in chunks by key and chunk over all tasks."""
    counted = df.withColumn("_times", times).where("_times > 0")
    few = (counted.where(F.col("_times") <= _CHUNK)
           .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))))
    many = (counted.where(F.col("_times") > _CHUNK)
            .withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_times") - 1, F.lit(_CHUNK))))
            .repartition(*key, "_from")
            .withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(
                F.lit(_CHUNK), F.col("_times") - F.col("_from")).cast("int")))).drop("_from"))
    return few.unionByName(many).drop("_times", "_i")


def _repeats(rows: DataFrame, key: Sequence[str], carry: Sequence[str]) -> DataFrame | None:
    """Rows of ``rows`` that are not the first of their key, or None when there are none.

    ``rows`` has the key, ``_order`` and the ``carry`` columns.  Three narrow steps: count
    the keys, collect the rows of repeated keys only, drop one first row per key.
    """
    dups = repeated_keys(rows, key).drop("_n")
    if dups.isEmpty():
        return None
    # Rows equal in every column share a group, so nothing depends on their order.
    by = list(dict.fromkeys([*key, *carry, "_order"]))
    groups = cut(_match(rows, dups, key).groupBy(*by).agg(F.count("*").alias("_m")), "groups")
    best = groups.groupBy(*key).agg(F.min("_order").alias("_best"))
    marked = _match(groups, best, key)
    return _repeat(marked, F.col("_m") - (F.col("_order") == F.col("_best")).cast("int"), key).drop("_m", "_order", "_best")


def check_unique(df: DataFrame, contract: TableContract, key: Sequence[str] | None = None) -> DataFrame:
    """One error for every repeat of a key after its first row."""
    key = tuple(key or contract.key)
    if "_file" not in df.columns and set(contract.key) <= set(key):
        # Nothing but the key tells the error rows apart: n rows of a key are n - 1 errors.
        dups = repeated_keys(df, key)
        later = _repeat(dups, F.col("_n") - 1, key)
        at = None
    else:
        rows = df.select(*dict.fromkeys([*key, *contract.key]), order_value(df, key, contract.order).alias("_order"),
                         lineage_of(df).alias("_at"))
        later = _repeats(rows, key, [*contract.key, "_at"])
        at = F.col("_at")
    if later is None:
        return no_errors(df)
    return error_rows(later, C.KEY_DUPLICATED, contract.name, pack_id(later.schema, contract.key),
                      ",".join(key), pack_id(later.schema, key), at)


def dedup_last(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Keep the last row of every key; rows with a unique key are passed through unmoved."""
    key = tuple(key)
    dups = repeated_keys(df, key).drop("_n")
    if dups.isEmpty():
        return df
    single = _match(df, dups, key, "left_anti")
    return single.unionByName(last_rows(_match(df, dups, key), key, order))


def last_rows(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Last row per key by partial aggregation, for inputs already cut down to few keys."""
    rest = [c for c in df.columns if c not in key]
    plain = not any(isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) for c in rest)
    if rest and plain and not order:
        # Ordered by all its other columns, the greatest struct is the row itself.
        best = df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row"))
        return best.select(*key, "_row.*").select(*df.columns)
    winner = df.groupBy(*key).agg(F.max_by(
        F.struct(*[F.col(c) for c in df.columns]), order_value(df, key, order)).alias("_row"))
    return winner.select("_row.*").select(*df.columns)


def on_survivors(parts: Sequence[tuple[DataFrame, TableContract, Callable[[DataFrame], DataFrame]]]) -> DataFrame | None:
    """Errors of row checks, restricted to rows that survive `dedup_last` on their key.

    One pass over all rows finds the records with any error.  Only those records are
    de-duplicated and checked again, so clean tables are never sorted by key.
    """
    if not parts:
        return None
    suspects = cut(union_all(check(df).select("table", "record_id") for df, _, check in parts).distinct(), "suspects")
    # At most one row per table.
    hit = {r[0] for r in suspects.select("table").distinct().collect()}
    frames = {c.name: (df, c) for df, c, _ in parts if c.name in hit}

    def survivors(name):
        df, contract = frames[name]
        ids = suspects.where(F.col("table") == name).select(F.col("record_id").alias("_rid"))
        rows = df.join(ids, pack_id(df.schema, contract.key) == F.col("_rid"), "left_semi")
        return cut(last_rows(rows, contract.key, contract.order), "winners")

    with ThreadPoolExecutor(max_workers=8) as pool:
        winners = dict(zip(frames, pool.map(survivors, frames)))
    return union_all(check(winners[c.name]) for _, c, check in parts if c.name in hit)


def check_entry(df: DataFrame, contract: TableContract, name: str | None = None,
                is_enum: bool | None = None) -> DataFrame:
    """Entry names: a space is an error and ends the matter; empty is one for enums only;
    names equal but for case after the first are duplicates."""
    name = name or contract.entry
    is_enum = contract.is_enum if is_enum is None else is_enum
    ident = pack_id(df.schema, contract.key)
    rows = df.select(ident.alias("_id"), F.coalesce(F.col(name), F.lit("")).alias("_name"),
                     order_value(df, (), contract.order).alias("_order"), lineage_of(df).alias("_at"))
    spaced = rows.where(F.contains("_name", F.lit(" ")))
    out = [error_rows(spaced, C.ENTRY_SPACE, contract.name, F.col("_id"), name, F.col("_name"), F.col("_at"))]
    if is_enum:
        empty = rows.where(F.col("_name") == "")
        out.append(error_rows(empty, C.ENUM_EMPTY, contract.name, F.col("_id"), name, F.col("_name"), F.col("_at")))
    named = (rows.where(~F.contains("_name", F.lit(" ")) & (F.col("_name") != ""))
             .withColumn("_upper", F.upper("_name")).withColumn("_value", F.col("_name")))
    later = _repeats(named, ["_upper"], ["_id", "_value", "_at"])
    if later is not None:
        out.append(error_rows(later, C.ENTRY_DUPLICATED, contract.name, F.col("_id"), name,
                              F.col("_value"), F.col("_at")))
    return union_all(out)


def check_seq(df: DataFrame, contract: TableContract, name: str, order_by: Sequence[str] = ()) -> DataFrame:
    """The field has to read 0, 1, 2, … down the rows."""
    order = list(order_by or contract.order) or list(contract.key)
    slim = df.select(*dict.fromkeys([*order, *contract.key, name]), lineage_of(df).alias("_at"))
    placed = with_position(slim, order)
    wrong = placed.where(F.coalesce(F.col(name), F.lit(0)) != F.col("_pos"))
    return error_rows(wrong, C.SEQ_BROKEN, contract.name, pack_id(slim.schema, contract.key), name,
                      F.coalesce(F.col(name), F.lit(0)), F.col("_at"),
                      F.concat(F.lit("expected "), F.col("_pos").cast("string")))


def _repeated_entries(df: DataFrame, entries: Column) -> DataFrame:
    """Rows with ``_again``, a row for each repeat of a key in an entry list."""
    keys = F.transform(entries, lambda e: e["key"])
    repeats = F.size(keys) - F.size(F.array_distinct(keys))
    # The n-th repeat is reported with the key that repeats.
    again = F.filter(keys, lambda k, i: F.array_position(keys, k) <= i)
    return df.where(repeats > 0).withColumn("_again", F.explode(again))


def check_map_keys(df: DataFrame, contract: TableContract, name: str) -> DataFrame:
    """One error per repeat of a key inside one record's entry list."""
    rows = _repeated_entries(df, F.col(name))
    return error_rows(rows, C.MAP_KEY_DUPLICATED, contract.name, pack_id(df.schema, contract.key),
                      name, F.col("_again"), lineage_of(df))


def check_nested(df: DataFrame, contract: TableContract) -> DataFrame:
    """Must-fill fields and map keys of structs anywhere inside the record, recursive values included."""
    out = []
    asked = lambda s: any(f.must_fill or isinstance(f.type, C.MapOf) for f in s.fields)
    if not any(asked(s) for s in C.structs_of(contract)):
        return no_errors(df)
    for struct, frame in nested_structs(df, contract, _row_columns(df, contract)):
        for f in struct.fields:
            value = F.col("_node")[f.name]
            said = (contract.name, pack_id(frame.schema, contract.key), F.concat_ws(".", "_path", F.lit(f.name)))
            if f.must_fill:
                empty = value.isNull()
                if isinstance(f.type, (C.ListOf, C.MapOf)):
                    empty = empty | (F.size(value) == 0)
                out.append(error_rows(frame.where(empty), C.MUST_FILL, *said, None, lineage_of(frame)))
            if isinstance(f.type, C.MapOf):
                rows = _repeated_entries(frame, value)
                out.append(error_rows(rows, C.MAP_KEY_DUPLICATED, *said, F.col("_again"), lineage_of(rows)))
    return union_all(out) if out else no_errors(df)


def entries_to_map(c: Column) -> Column:
    """Map of an entry list; of equal keys the last entry stays."""
    def last(e, i):
        rest = F.slice(c, i + 2, F.size(c))
        return ~F.exists(rest, lambda o: o["key"] == e["key"])
    keys = F.transform(c, lambda e: e["key"])
    # Entries are compared with each other only where some key does repeat.
    clean = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(clean, F.map_from_entries(c)).otherwise(F.map_from_entries(F.filter(c, last)))


def check_must_fill(df: DataFrame, contract: TableContract) -> DataFrame:
    out = []
    for f in contract.fields:
        if not f.must_fill:
            continue
        empty = F.col(f.name).isNull()
        if isinstance(f.type, (C.ListOf, C.MapOf)):
            empty = empty | (F.size(f.name) == 0)
        out.append(error_rows(df.where(empty), C.MUST_FILL, contract.name,
                              pack_id(df.schema, contract.key), f.name, None, lineage_of(df)))
    return union_all(out) if out else no_errors(df)


# ------------------------------------------------------------ foreign keys

def _zero(dtype: T.DataType):
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    return None


def key_value(c: Column, dtype: T.DataType) -> Column:
    """Empty cells compare as the type's default."""
    zero = _zero(dtype)
    return c if zero is None else F.coalesce(c, zero)


def target_keys(target: DataFrame, fk: ForeignKey) -> DataFrame:
    cols = [key_value(F.col(k), target.schema[k].dataType).alias(f"_r{i}") for i, k in enumerate(fk.ref_keys)]
    return target.select(*cols).distinct()


def _packed_cell(contract, fk: ForeignKey) -> bool:
    if isinstance(contract, TableContract) and contract.source == "json":
        return True
    if len(fk.keys) > 1:
        return False
    return contract.field(fk.keys[0]).layout in ("pack", "sep")


def _own_key(contract, fk: ForeignKey) -> bool:
    if not isinstance(contract, TableContract) or len(fk.keys) > 1:
        return False
    return fk.keys[0] in contract.key or any(fk.keys[0] in u for u in contract.uniques)


# What a scalar reference has to satisfy, by where its key comes from.
#   packed, separated or JSON   nullable: never checked    otherwise: has to exist
#   grid, all cells empty       nullable: fine             otherwise: own error
#   grid, number 0              nullable: fine             otherwise: has to exist
#   grid, part of own key       nullable: fine             otherwise: has to exist
#   grid, anything else         has to exist               has to exist
def key_rule(contract, fk: ForeignKey, columns: list[Column], dtypes: list[T.DataType]) -> tuple[Column, Column]:
    """(rows whose key has to exist, rows whose key may not be empty but is)."""
    if _packed_cell(contract, fk):
        return F.lit(not fk.nullable), F.lit(False)
    empty = F.lit(True)
    for c in columns:
        empty = empty & c.isNull()
    if not fk.nullable:
        return ~empty, empty
    if _own_key(contract, fk):
        return F.lit(False), F.lit(False)
    if len(columns) == 1 and isinstance(dtypes[0], T.NumericType):
        return ~empty & (columns[0] != 0), F.lit(False)
    return ~empty, F.lit(False)


def _missing(rows: DataFrame, target: DataFrame, fk: ForeignKey, values: list[str]) -> DataFrame:
    refs = target_keys(target, fk)
    on = [rows[v] == refs[f"_r{i}"] for i, v in enumerate(values)]
    return rows.join(refs, on, "left_anti")


def _row_columns(df: DataFrame, contract: TableContract) -> list[str]:
    """Raw columns that name a row; they are turned to text for bad rows only."""
    return [*contract.key, *[c for c in ("_file", "_sheet", "_row") if c in df.columns]]


def _finish(contract: TableContract, fk: ForeignKey, bad: DataFrame, value, field_name, empty=None) -> DataFrame:
    kind = F.lit(C.REF_NOT_FOUND)
    if empty is not None:
        kind = F.when(empty, C.REF_EMPTY).otherwise(kind)
        value = F.when(~empty, value)
    return error_rows(bad, kind, contract.name, pack_id(bad.schema, contract.key), field_name, value, lineage_of(bad),
                      F.concat(kind, F.lit(f" {fk.name} -> {fk.ref_table}")))


def _recursive_structs(frame: DataFrame, value: Column, kind: C.Union, path: Column, names: list[str]):
    """``(struct contract, frame)`` for every struct inside recursive values, of all depths together."""
    shape = Shape(kind)
    if not any(struct.fields for _, _, struct in shape.structs()):
        return
    levels = opened(frame.select(*names, value.alias("_v"), path.alias("_from")), names, shape, F.col("_from"))
    for n, impl, struct in shape.structs():
        if not struct.fields or struct.name == "entry" and impl is None:
            continue
        mine = (F.col("_s") == f"s{n}") & (F.col("_k") == "O")
        if impl is not None:
            mine = mine & F.col("_impl").isin(impl, f"{shape.kinds[n].name}.{impl}")
        here = union_all(level.where(mine) for level in levels)
        node, _ = from_variant(F.col("_v"), struct, F.lit(""))
        yield struct, here.select(*names, node.alias("_node"), F.replace("_at", F.lit(STEP), F.lit(".")).alias("_path"))


@dataclass(frozen=True)
class References:
    """Rows whose key has to exist: what names the row, the key in ``values``, and how an error shows it."""

    fk: ForeignKey
    rows: DataFrame
    values: tuple[str, ...]
    text: Column
    field: str | Column
    empty: Column | None = None


def references(df: DataFrame, contract: TableContract, fk: ForeignKey) -> References | None:
    """References of a scalar, composite or struct key, of a list's elements or a map's values; none for keys to many rows."""
    if fk.to_many:
        return None
    name, dtypes = fk.keys[0], [df.schema[k].dataType for k in fk.keys]
    first = dtypes[0]
    is_map = isinstance(first, T.MapType) or (isinstance(first, T.ArrayType) and isinstance(contract.field(name).type, C.MapOf))
    if is_map or isinstance(first, T.ArrayType):
        if isinstance(first, T.MapType):
            items, item = F.map_values(name), first.valueType
        elif is_map:
            items, item = F.map_values(entries_to_map(F.col(name))), first.elementType["value"].dataType
        else:
            items, item = F.col(name), first.elementType
        rows = df.select(*_row_columns(df, contract), F.explode(items).alias("_v0"))
        return References(fk, rows.withColumn("_v0", key_value(F.col("_v0"), item)), ("_v0",), pack_value("_v0", item), name)
    columns = [F.col(k) for k in fk.keys]
    must, empty = key_rule(contract, fk, columns, dtypes)
    # An empty key stays NULL, matches nothing and comes out of the same anti join.
    keys = [F.when(~empty, key_value(c, t)).alias(f"_v{i}") for i, (c, t) in enumerate(zip(columns, dtypes))]
    rows = df.where(must | empty).select(*dict.fromkeys([*_row_columns(df, contract), *fk.keys]), *keys)
    return References(fk, rows, tuple(f"_v{i}" for i in range(len(keys))), pack_id(df.schema, fk.keys), ",".join(fk.keys),
                      F.col("_v0").isNull())


def check_fk(df: DataFrame, contract: TableContract, fk: ForeignKey, target: DataFrame) -> DataFrame:
    """One error per reference without a target: of the row, of a list's element, of a map's value.

    A left-anti join on the narrow key: small targets are broadcast by measured size,
    and the row side of a hot key can be split by adaptive execution.
    """
    refs = references(df, contract, fk)
    if refs is None:
        return no_errors(df)
    bad = _missing(refs.rows, target, fk, list(refs.values))
    return _finish(contract, fk, bad, refs.text, refs.field, refs.empty)


# -------------------------------------------------- foreign keys inside structs

def nested_structs(df: DataFrame, contract: TableContract, keep: Sequence[str | Column]):
    """Yield ``(path parts, struct contract, frame)`` for every struct below the row.

    The frame has the ``keep`` columns, ``_node`` (the struct) and ``_path`` (its field
    chain).  Lists and maps are exploded, so one record's items can spread over tasks.
    """
    def walk(frame, value, kind, path):
        if isinstance(kind, C.ListOf) and not isinstance(kind.item, str):
            inner = frame.select(*names, F.posexplode(value).alias("_i", "_node"), path.alias("_up"))
            inner = inner.withColumn("_path", F.concat_ws(".", "_up", F.col("_i").cast("string"))).drop("_i", "_up")
            yield from walk(inner, F.col("_node"), kind.item, F.col("_path"))
        elif isinstance(kind, C.MapOf):
            for part, inner_kind in (("key", kind.key), ("value", kind.value)):
                if isinstance(inner_kind, str):
                    continue
                inner = frame.select(*names, F.posexplode(F.map_entries(entries_to_map(value))).alias("_i", "_e"),
                                     path.alias("_up"))
                inner = (inner.withColumn("_node", F.col("_e")[part])
                         .withColumn("_path", F.concat_ws(".", "_up", F.concat(F.col("_i").cast("string"), F.lit(part[0]))))
                         .drop("_i", "_up", "_e"))
                yield from walk(inner, F.col("_node"), inner_kind, F.col("_path"))
        elif isinstance(kind, C.Union) and kind.recursive:
            yield from _recursive_structs(frame, value, kind, path, names)
        elif isinstance(kind, C.Union):
            for impl in kind.impls:
                inner = frame.where(value["type"] == impl.name).select(
                    *names, value[impl.name].alias("_node"), path.alias("_path"))
                yield from walk(inner, F.col("_node"), impl, F.col("_path"))
        elif isinstance(kind, C.Struct):
            here = frame.where(value.isNotNull()).select(*names, value.alias("_node"), path.alias("_path"))
            yield kind, here
            for f in kind.fields:
                if not isinstance(f.type, str):
                    yield from walk(here, F.col("_node")[f.name], f.type, F.concat_ws(".", "_path", F.lit(f.name)))

    base = df.select(*keep, *[F.col(f.name).alias(f"_fld_{f.name}") for f in contract.fields if not isinstance(f.type, str)])
    names = [c for c in base.columns if not c.startswith("_fld_")]
    for f in contract.fields:
        if not isinstance(f.type, str):
            yield from walk(base, F.col(f"_fld_{f.name}"), f.type, F.lit(f.name))


def nested_references(df: DataFrame, contract: TableContract, tables: Collection[str]) -> Iterator[References]:
    """References to ``tables`` that structs anywhere inside the record declare."""
    for struct, frame in nested_structs(df, contract, _row_columns(df, contract)):
        for fk in struct.fks:
            if fk.to_many or fk.ref_table not in tables:
                continue
            columns = [F.col("_node")[k] for k in fk.keys]
            dtypes = [frame.schema["_node"].dataType[k].dataType for k in fk.keys]
            kind = struct.field(fk.keys[0]).type
            empty = F.col("_v0").isNull()
            if isinstance(kind, (C.ListOf, C.MapOf)):
                is_map = isinstance(kind, C.MapOf)
                item = dtypes[0].elementType["value"].dataType if is_map else dtypes[0].elementType
                rows = frame.withColumn("_v0", F.explode(F.map_values(entries_to_map(columns[0])) if is_map else columns[0]))
                rows = rows.withColumn("_v0", key_value(F.col("_v0"), item))
                kinds = [item]
            else:
                if contract.source == "json" or struct.layout in ("pack", "sep"):
                    must, gone = F.lit(not fk.nullable), F.lit(False)
                else:
                    must, gone = key_rule(struct, fk, columns, dtypes)
                rows = frame.where(must | gone)
                for i, (c, t) in enumerate(zip(columns, dtypes)):
                    rows = rows.withColumn(f"_v{i}", F.when(~gone, key_value(c, t)))
                kinds = dtypes
            values = tuple(f"_v{i}" for i in range(len(kinds)))
            rows = rows.withColumn("_field", F.concat_ws(".", "_path", F.lit(",".join(fk.keys)))).drop("_node")
            text = F.concat_ws(";", *[pack_value(v, t) for v, t in zip(values, kinds)])
            yield References(fk, rows, values, text, F.col("_field"), empty)


def check_fk_nested(df: DataFrame, contract: TableContract, targets: dict[str, DataFrame]) -> DataFrame:
    """References declared by structs anywhere inside the record, reported on its owner."""
    out = [_finish(contract, refs.fk, _missing(refs.rows, targets[refs.fk.ref_table], refs.fk, list(refs.values)), refs.text, refs.field,
                   refs.empty) for refs in nested_references(df, contract, targets)]
    return union_all(out) if out else no_errors(df)


# ---------------------------------------------------------------- everything

def validate(dataset: Dataset, tables: Sequence[str] | None = None, extra: Sequence[DataFrame] = ()) -> DataFrame:
    """All checks over all tables as one error frame; ``extra`` adds parse errors.

    Checks that first count keys run as jobs of their own; they are submitted side by
    side so that small tables do not wait for big ones.
    """
    chosen = list(tables) if tables is not None else dataset.names()
    jobs = [lambda n=n: table_errors(dataset.frames[n], dataset.contracts[n]) for n in chosen]
    jobs.append(lambda: reference_errors(dataset, [p for p in dataset.fks() if p[0] in chosen], chosen))
    with ThreadPoolExecutor(max_workers=8) as pool:
        found = list(pool.map(lambda job: job(), jobs))
    out = [e for e in found if e is not None]
    out += [fn(dataset) for fn in _CUSTOM.values()] + list(extra)
    return union_all(out)


def table_errors(df: DataFrame, contract: TableContract) -> DataFrame:
    """Key, entry, must-fill, sequence and map-key checks of one table."""
    out = [check_unique(df, contract)]
    if contract.uniques:
        kept = dedup_last(df, contract.key, contract.order)
        out += [check_unique(kept, contract, key) for key in contract.uniques]
    if contract.entry:
        out.append(check_entry(df, contract))
    if any(f.must_fill for f in contract.fields):
        out.append(check_must_fill(df, contract))
    if any(not isinstance(f.type, str) for f in contract.fields):
        out.append(check_nested(df, contract))
    for f in contract.fields:
        if f.seq:
            out.append(check_seq(df, contract, f.name))
        if isinstance(f.type, C.MapOf) and isinstance(df.schema[f.name].dataType, T.ArrayType):
            out.append(check_map_keys(df, contract, f.name))
    return union_all(out)


def reference_errors(dataset: Dataset, pairs, nested: Sequence[str] = ()) -> DataFrame | None:
    """Dangling references of surviving rows, for the given foreign keys and nested structs."""
    parts = []
    for name, fk in pairs:
        if not fk.to_many:
            contract, target = dataset.contracts[name], dataset.frames[fk.ref_table]
            parts.append((dataset.frames[name], contract,
                          lambda df, contract=contract, fk=fk, target=target: check_fk(df, contract, fk, target)))
    for name in nested:
        contract = dataset.contracts[name]
        if any(not isinstance(f.type, str) for f in contract.fields):
            parts.append((dataset.frames[name], contract,
                          lambda df, contract=contract: check_fk_nested(df, contract, dataset.frames)))
    return on_survivors(parts)


class ValidationError(ValueError):
    pass


def require_valid(errors: DataFrame, allow_errors: bool = False) -> DataFrame:
    """Strict mode raises on the first error row; warnings never stop the run."""
    if not allow_errors:
        first = errors.where(F.col("level") == "error").limit(1).collect()
        if first:
            raise ValidationError(str(first[0].asDict()))
    return errors


def errors_by_table(errors: DataFrame) -> DataFrame:
    """Counts per table and kind, unnamed tables last."""
    counts = errors.groupBy("table", "level", "err_type").agg(
        F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))
    return counts.orderBy(F.coalesce(F.col("table"), F.lit("")) == "", "table", "level", "err_type")
