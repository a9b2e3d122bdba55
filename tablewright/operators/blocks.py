"""Records that continue over several grid rows.

A record of a contract with block fields takes several rows: a row without key cells continues the record above, and a
block's next item starts where the block's first column is filled.  `fold` finds for every row where its record and each of
its items start, `nested_records` types what belongs together, and `records_to_grid` lays records out again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import cut, running_last
from ..contract import ERROR_COLUMNS, Field, ListOf, MapOf, Struct, TableContract, column_of, field_span, span, spark_type
from ..functions.scalars import pack_id

ORDER = ("_shard", "_file", "_row")


def _filled(cols: Sequence[int]) -> Column:
    out = F.lit(False)
    for i in cols:
        out = out | (F.coalesce(F.get("cells", i), F.lit("")) != "")
    return out


def fold_records(body: DataFrame, key_columns: Sequence[int], group: Sequence[str] = ("_file",),
                 position: str = "_row") -> DataFrame:
    """Tag each row with the row its record starts at (``_record``).

    A row whose key cells are all empty continues the record above; the very first row
    starts a record in any case.  The result stays one row per grid row, so a record as
    big as the table is no trouble; `nest` folds it where that is wanted.
    """
    first = body.groupBy(*group).agg(F.min(position).alias("_first"))
    rows = body.join(first, list(group))
    start = F.when(_filled(key_columns) | (F.col(position) == F.col("_first")), F.col(position))
    return running_last(rows, start, group, position, "_record").drop("_first")


def fold_blocks(body: DataFrame, key_columns: Sequence[int], blocks: Sequence[int],
                group: Sequence[str] = ("_file",), position: str = "_row", in_order: bool = False) -> list[DataFrame]:
    """Items of nested blocks, outermost first, one frame per level.

    ``blocks`` are the first columns of the nested block fields.  Level ``n`` has
    ``_record``, ``_item1`` … ``_itemN`` (the rows where the enclosing items start) and
    the cells of the item's own row.  The row where an outer item starts also starts
    an inner item; below it a filled first column starts the next item, an empty one
    belongs to a deeper level.  All levels come from one scan, as in `fold`.
    """
    begins, mask = _filled(key_columns), F.lit(0).cast("long")
    names = ["_record", *[f"_item{level}" for level in range(1, len(blocks) + 1)]]
    for k, column in enumerate([None, *blocks]):
        begins = begins if column is None else begins | _filled([column])
        mask = mask + F.when(begins, 1 << k).otherwise(0)
    rows = _scanned(body, mask, names, group, [position], in_order, position)
    return [rows.where(F.col(position) == F.col(name)).select(*body.columns, *names[:level + 1])
            for level, name in enumerate(names) if level]


# ------------------------------------------------------------ by contract

@dataclass(frozen=True)
class Block:
    """A block field: its place among a contract's blocks, its first grid column, the block around it (-1: the record)."""

    index: int
    field: Field
    column: int
    parent: int

    @property
    def item_span(self) -> int:
        kind = self.field.type
        return span(kind.key) + span(kind.value) if isinstance(kind, MapOf) else span(kind.item)


def block_fields(contract: TableContract) -> list[Block]:
    """The block fields of a contract, outer ones before those inside them; blocks may stand side by side."""
    out: list[Block] = []

    def walk(fields: Iterable[Field], at: int, parent: int) -> None:
        for f in fields:
            if f.layout == "block":
                block = Block(len(out), f, at, parent)
                out.append(block)
                item = getattr(f.type, "item", None)
                if isinstance(item, Struct) and item.layout == "auto":
                    walk(item.fields, at, block.index)
                    if f.width > 1 and len(out) > block.index + 1:
                        raise ValueError(f"{f.name}: a block inside a block of several items a row")
            elif isinstance(f.type, Struct) and f.type.layout == "auto" and f.layout == "auto":
                walk(f.type.fields, at, parent)
            at += field_span(f)

    walk(contract.fields, 0, -1)
    return out


def _starts_mask(contract: TableContract, blocks: Sequence[Block]) -> Column:
    """Bit 0: the row starts a record; bit k + 1: an item of block k, by its own first column or that of a block around it."""
    def opens(block: Block) -> Column:
        mine = _filled([block.column])
        return mine if block.parent < 0 else mine | opens(blocks[block.parent])

    key = [column_of(contract, k) + i for k in contract.key for i in range(field_span(contract.field(k)))]
    record = _filled(key)
    mask = F.when(record, 1).otherwise(0).cast("long")
    for block in blocks:
        mask = mask + F.when(record | opens(block), 2 << block.index).otherwise(0)
    return mask


def fold(body: DataFrame, contract: TableContract, group: Sequence[str] = (), order: Sequence[str] = ORDER,
         in_order: bool = False) -> DataFrame:
    """``body`` (with ``cells``) and, for every row, its number ``_id``, its place ``_seq`` in the group and the numbers of the rows
    where its record (``_record``) and its item of each block (``_b0`` …) start.

    Rows run in ``order`` within ``group`` (none: the frame is one table), so a record goes on over the ends of files and shards.  A row
    whose key cells are all empty continues the record above; the first row of a group starts one in any case.  An item of a
    block starts where its first column or that of a block around it is filled, and with every record.

    One scan: a task walks its rows with a vector of the last starts and leaves the last vector of every stretch; the vectors of the
    stretches, a row each, are put in order and hand their starts on.  Rows are range partitioned first, and a task's rows of a group are
    one stretch.  ``in_order`` leaves them where they are, for grids that were written in order and numbered without gaps: there
    a stretch ends where the next row's number is not the next one.
    """
    blocks = block_fields(contract)
    if len(blocks) > 61:
        raise ValueError("more than 61 blocks")
    order = [c for c in order if c in body.columns]
    return _scanned(body, _starts_mask(contract, blocks), ["_record", *[f"_b{b.index}" for b in blocks]], group, order, in_order)


def _changes(column: pa.Array) -> np.ndarray:
    """For every value but the first, whether it differs from the one before."""
    a, b = column[1:], column[:-1]
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _scanned(body: DataFrame, mask: Column, names: Sequence[str], group: Sequence[str], order: Sequence[str], in_order: bool,
             value: str = "_id") -> DataFrame:
    """``body`` with ``_id`` and, for every bit of ``mask``, the ``value`` of the last row of the group that has it (none: the first row).

    Numbers ``_id`` differ, but tasks need not have read the stretches in order: ``_seq`` goes up along the rows of a group.
    """
    place = [*group, *order]
    rows = body.withColumn("_mask", mask)
    if not in_order:
        rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    n, at = len(body.columns), [body.columns.index(c) for c in (place if in_order else group)]
    valued = None if value == "_id" else body.columns.index(value)
    none = np.iinfo(np.int64).min

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, stretch = TaskContext.get().partitionId() << 33, 0, 0
        last, starts = None, np.full(len(names), none, np.int64)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            ids, here = task + count + np.arange(size), np.arange(size)
            first, new = [batch.column(i)[0].as_py() for i in at], np.zeros(size, bool)
            if last is None:
                new[0] = True
            elif in_order:
                new[0] = last[:-1] != first[:-1] or last[-1] + 1 != first[-1]
            else:
                new[0] = last != first
            for i in at[:-1] if in_order else at:
                new[1:] |= _changes(batch.column(i))
            if in_order:
                new[1:] |= np.diff(batch.column(at[-1]).to_numpy(zero_copy_only=False)) != 1
            part, bits = stretch + np.cumsum(new), batch.column(n).to_numpy()
            values = ids if valued is None else batch.column(valued).to_numpy().astype(np.int64)
            # Where the row's stretch began in this batch; -1: in an earlier one.
            begin, columns = np.maximum.accumulate(np.where(new, here, -1)), []
            for k in range(len(names)):
                seen = np.maximum.accumulate(np.where(bits >> k & 1, here, -1))
                found = np.where((seen >= begin) & (seen >= 0), values[seen], np.where(begin < 0, starts[k], none))
                starts[k] = found[-1]
                columns.append(pa.array(found, mask=found == none))
            count, stretch, last = count + size, int(part[-1]), [batch.column(i)[size - 1].as_py() for i in at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ids), pa.array(task + part), *columns],
                                             names=[*batch.schema.names[:n], "_id", "_stretch", *names])

    schema = T.StructType([*body.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_id", "_stretch", *names)]])
    stored = cut(rows.mapInArrow(scan, schema), "folded")
    stretches = stored.groupBy(*group, "_stretch").agg(F.min(F.struct(*order)).alias("_first"), F.min(value).cast("long").alias("_top"),
                                                       F.min("_id").alias("_low"),
                                                       *[F.max(c).alias(c) for c in names])
    # A row per stretch: a task's or a file's part of a group.
    along = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_first")
    before, top = along.rowsBetween(Window.unboundedPreceding, -1), F.first("_top").over(along)
    ahead = F.row_number().over(along).cast("long") * F.lit(1 << 33) - F.col("_low")
    carried = stretches.select("_stretch", top.alias("_top"), ahead.alias("_ahead"), *[F.last(c, ignorenulls=True).over(before).alias(f"_c{c}") for c in names])
    out = stored.join(cut(carried, "stretches"), "_stretch")
    return out.select(*body.columns, "_id", (F.col("_id") + F.col("_ahead")).alias("_seq"), *[F.coalesce(c, f"_c{c}", "_top").alias(c) for c in names])


_HUGE = "spark.sql.codegen.hugeMethodLimit"
#: Bytes of a method that the JVM still compiles; typing many cells in one method would be interpreted.
_COMPILED = 8000
_ISSUES = "array<struct<kind:string,field:string,value:string,level:string,at:string>>"


def nested_records(body: DataFrame, contract: TableContract, group: Sequence[str] = (), order: Sequence[str] = ORDER,
                   in_order: bool = False, header_layout: int = 2) -> tuple[DataFrame, DataFrame]:
    """(typed records, errors) of a grid whose contract has block fields, at any depth and side by side.

    Rows are folded once.  Items are typed row by row, then gathered into the row that their outer item starts at, innermost blocks
    first, so a shuffle per block moves typed items only.  Items without any filled cell are left out.  Errors name the row they stand in.
    Records come with the ``group`` columns; a record has to fit a row.
    """
    from .typed import _any_filled, _join, _none, build

    folded = fold(body, contract, group, order, in_order)
    blocks = block_fields(contract)
    inside = {b.index: [c for c in blocks if c.parent == b.index] for b in blocks} | {-1: [b for b in blocks if b.parent < 0]}
    row = F.col("_row").cast("string") if "_row" in body.columns else F.col("_id").cast("string")
    at = F.concat(F.col("_file") if "_file" in body.columns else F.lit(""), F.lit("#!"), row)
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))

    def placed(issues: Column, at: Column) -> Column:
        return F.transform(issues, lambda e: F.struct(e["kind"].alias("kind"), e["field"].alias("field"), e["value"].alias("value"),
                                                      e["level"].alias("level"), at.alias("at"))).cast(_ISSUES)

    found_any = lambda issues: F.size(issues) > 0

    def value_of(f: Field, column: int, path: Column) -> tuple[Column, Column]:
        """(value, issues) of a field whose first cell is ``column``; a block's items have been gathered before."""
        if f.layout == "block":
            return F.col(f"_l{next(b.index for b in blocks if b.column == column and b.field is f)}"), _none()
        cells = [cell(column + i) for i in range(field_span(f))]
        if isinstance(f.type, Struct) and f.type.layout == "auto" and f.layout == "auto":
            return struct_of(f.type, column, path)
        return build(f.type, cells, path, f.layout, f.width, f.sep, header_layout)

    def struct_of(kind: Struct, column: int, path: Column) -> tuple[Column, Column]:
        values, issues, i = [], [], column
        for f in kind.fields:
            v, e = value_of(f, i, F.concat(path, F.lit("." + f.name)))
            values.append(v.alias(f.name))
            issues.append(e)
            i += field_span(f)
        return F.when(_any_filled([cell(k) for k in range(column, i)]), F.struct(*values)), _join(issues)

    def items_of(block: Block, path: Column) -> tuple[Column, Column]:
        """(items, issues) that stand in one row of a block."""
        kind, width, items, issues = block.field.type, block.item_span, [], []
        for g in range(block.field.width):
            first = block.column + g * width
            if isinstance(kind, MapOf):
                k, ke = build(kind.key, [cell(first + i) for i in range(span(kind.key))], path, header_layout=header_layout)
                v, ve = build(kind.value, [cell(first + span(kind.key) + i) for i in range(span(kind.value))], path, header_layout=header_layout)
                v, e = F.struct(k.alias("key"), v.alias("value")), _join([ke, ve])
            elif isinstance(kind.item, Struct) and kind.item.layout == "auto":
                v, e = struct_of(kind.item, first, path)
            else:
                v, e = build(kind.item, [cell(first + i) for i in range(width)], path, header_layout=header_layout)
            on = _any_filled([cell(first + i) for i in range(width)])
            items.append(F.struct(on.alias("on"), v.alias("v")))
            issues.append(F.when(on, e).otherwise(_none()))
        if len(items) == 1:
            # No lambda: these keep Spark from compiling the whole projection, cells and all.
            return F.when(on, F.array(v)).otherwise(F.array()).cast(spark_type(kind)), issues[0]
        kept = F.transform(F.filter(F.array(*items), lambda x: x["on"]), lambda x: x["v"])
        return kept.cast(spark_type(kind)), _join(issues)

    def gathered(index: int) -> DataFrame:
        """Rows where an item of the block (-1: a record) starts, with the lists ``_l`` of the blocks inside and their issues ``_x``."""
        start = "_record" if index < 0 else f"_b{index}"
        up = [] if index < 0 else [F.col("_record" if blocks[index].parent < 0 else f"_b{blocks[index].parent}").alias("_up")]
        keep = [*group] if index < 0 else []
        place = [] if index < 0 else ["_seq"]
        own = folded.where(F.col("_id") == F.col(start)).select("_id", *place, *up, *keep, "cells", at.alias("_at"))
        if not inside[index]:
            return own.withColumn("_x", F.array().cast(_ISSUES))
        frame = own
        for child in inside[index]:
            rows = gathered(child.index)
            values, issues = items_of(child, F.lit(child.field.name))
            # Issues get their place when they are gathered: most items have none, and typing stays one compiled projection.
            rows = rows.select("_up", "_seq", "_x", values.alias("_v"), issues.alias("_e"), "_at")
            item = F.struct(F.col("_seq").alias("o"), F.col("_v").alias("v"), F.col("_x").alias("x"), F.col("_e").alias("e"),
                            F.when(found_any("_e"), F.col("_at")).alias("at"))
            frame = frame.unionByName(rows.select(F.col("_up").alias("_id"), item.alias(f"_c{child.index}")), allowMissingColumns=True)
        kept = [c for c in own.columns if c != "_id"]
        lists = [f"_c{c.index}" for c in inside[index]]
        one = frame.groupBy("_id").agg(*[F.any_value(c, True).alias(c) for c in kept], *[F.collect_list(c).alias(c) for c in lists])
        for c in lists:
            kinds = one.schema[c].dataType.simpleString()
            # Numbers differ, so that nothing behind them is ever compared; what has no order is sorted by them alone.
            ordered = F.array_sort(c, lambda a, b: F.when(a["o"] < b["o"], -1).otherwise(1)) if "map<" in kinds or "variant" in kinds else F.sort_array(c)
            one = one.withColumn(c, ordered)
        found = F.flatten(F.array(*[F.flatten(F.transform(c, lambda x: F.concat(x["x"], placed(x["e"], x["at"])))) for c in lists]))
        flat = [F.flatten(F.transform(c, lambda x: x["v"])).alias("_l" + c[2:]) for c in lists]
        return one.select("_id", *kept, *flat, found.alias("_x"))

    heads, values, i = gathered(-1), {}, 0
    for f in contract.fields:
        values[f.name] = value_of(f, i, F.lit(f.name))
        i += field_span(f)
    typed = heads.select(*group, "_x", "_at", _join([e for _, e in values.values()]).alias("_e"), *[v.alias(name) for name, (v, _) in values.items()])
    own = F.when(found_any("_e"), placed(F.col("_e"), F.col("_at"))).otherwise(F.array().cast(_ISSUES))
    typed = typed.select(*group, F.concat("_x", own).alias("_x"), *values)
    spark = typed.sparkSession
    before = spark.conf.get(_HUGE, None)
    spark.conf.set(_HUGE, str(_COMPILED))
    try:
        typed = cut(typed, "records")
    finally:
        spark.conf.unset(_HUGE) if before is None else spark.conf.set(_HUGE, before)
    bad = typed.select(pack_id(typed.schema, contract.key).alias("_id"), F.explode("_x").alias("x"))
    said = F.concat_ws(" ", "x.kind", F.lit(contract.name), "x.field")
    errors = bad.select(*[c.cast("string").alias(name) for name, c in zip(ERROR_COLUMNS, (
        F.col("x.kind"), F.col("x.level"), F.lit(contract.name), F.col("_id"), F.col("x.field"), F.col("x.value"), F.col("x.at"), said))])
    return typed.drop("_x"), errors


def records_to_grid(df: DataFrame, contract: TableContract) -> DataFrame:
    """(key fields, ``_line``, ``cells``): grid rows of typed records, the inverse of `nested_records`.

    An item of a block takes as many rows as the highest block inside it, at least one; blocks side by side start in the same row.
    Heights add up from the inside, their prefix sums say where an item's rows begin.  Records are moved once, by
    their key; an item brings the rows of the blocks in it that have no others inside.  Null records' cells are empty.
    """
    blocks = block_fields(contract)
    inside = {b.index: [c for c in blocks if c.parent == b.index] for b in blocks} | {-1: [b for b in blocks if b.parent < 0]}
    width, key = sum(field_span(f) for f in contract.fields), [f"_k{i}" for i in range(len(contract.key))]

    def steps(fields: Iterable[Field], goal: Field) -> list[str] | None:
        """Names of the structs that lead to a block field, then its own."""
        for f in fields:
            if f is goal:
                return [f.name]
            if isinstance(f.type, Struct) and f.layout == "auto" and (rest := steps(f.type.fields, goal)):
                return [f.name, *rest]
        return None

    def fields_of(index: int) -> Sequence[Field]:
        return contract.fields if index < 0 else blocks[index].field.type.item.fields

    def items_of(value: Column, block: Block) -> Column:
        for name in steps(fields_of(block.parent), block.field):
            value = value[name]
        return F.coalesce(value, F.array().cast(spark_type(block.field.type)))

    def lines(items: Column, block: Block) -> Column:
        """Rows that the items take."""
        if not inside[block.index]:
            return F.ceil(F.size(items) / block.field.width).cast("int")
        return F.aggregate(items, F.lit(0), lambda n, item: n + height(item, block.index))

    def height(value: Column, index: int, only: Sequence[Block] | None = None) -> Column:
        inner = [lines(items_of(value, c), c) for c in (inside[index] if only is None else only)]
        return F.greatest(F.lit(1), F.lit(1), *inner)

    pieces: list[DataFrame] = []
    #: The piece that has a grid column, and where in it.
    places: dict[int, tuple[int, int]] = {}

    def lay(frame: DataFrame, index: int, ids: list[str]) -> None:
        """``frame`` has the key, ``_line`` of every item of block ``index`` and the item ``_v``.

        Blocks without others inside are read by their place, so only the others are opened item by item.
        """
        leaves = [c for c in inside[index] if not inside[c.index]]
        # Where each leaf's items go: (block, its place among those that share a row).
        spots = [(c, g) for c in leaves for g in range(c.field.width)]
        nth = {(c, g): F.col("_j") * c.field.width + g for c, g in spots}
        rows = frame.select(*key, "_line", "_v", F.explode(F.sequence(F.lit(0), height(F.col("_v"), index, leaves) - 1)).alias("_j"))
        kinds = rows.schema["_v"].dataType
        rows = rows.select(*key, (F.col("_line") + F.col("_j")).alias("_line"), "_v", "_j", *[
            F.get(items_of(F.col("_v"), c), nth[c, g]).alias(f"_v{c.index}_{g}") for c, g in spots])
        cells = [(at, F.when(F.col("_j") == 0, cell).otherwise("")) for at, cell in _flat_cells(
            fields_of(index), 0 if index < 0 else blocks[index].column, "_v", kinds)]
        for c, g in spots:
            kind, name, dtype = c.field.type, f"_v{c.index}_{g}", rows.schema[f"_v{c.index}_{g}"].dataType
            here = nth[c, g] < F.size(items_of(F.col("_v"), c))
            fields = [Field("key", kind.key), Field("value", kind.value)] if isinstance(kind, MapOf) else (
                kind.item.fields if isinstance(kind.item, Struct) and kind.item.layout == "auto" else None)
            found = [(c.column, record_cells(None, [Field(name, kind.item)], {name: T.StructField(name, dtype)})[0])] if fields is None else (
                _flat_cells(fields, c.column, name, dtype))
            cells += [(at + g * c.item_span, F.when(here, cell).otherwise("")) for at, cell in found]
        places.update({at: (len(pieces), n) for n, (at, _) in enumerate(cells)})
        pieces.append(rows.select(*key, "_line", F.array(*[cell for _, cell in cells]).alias(f"_p{len(pieces)}")))
        for child in inside[index]:
            if not inside[child.index]:
                continue
            name = f"_i{child.index}"
            items = frame.select(*key, *ids, "_line", F.posexplode(items_of(F.col("_v"), child)).alias(name, "_v"))
            items = items.withColumn("_h", height(F.col("_v"), child.index))
            along = Window.partitionBy(*key, *ids).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
            at = F.col("_line") + F.coalesce(F.sum("_h").over(along), F.lit(0))
            lay(items.select(*key, *ids, name, at.cast("long").alias("_line"), "_v"), child.index, [*ids, name])

    base = df.select(*[F.col(k).alias(n) for k, n in zip(contract.key, key)], F.struct(*[f.name for f in contract.fields]).alias("_v"))
    # All windows below and the last grouping go by these keys or more.
    lay(base.repartition(*key).withColumn("_line", F.lit(0).cast("long")), -1, [])
    every = pieces[0]
    for piece in pieces[1:]:
        every = every.unionByName(piece, allowMissingColumns=True)
    # A row's pieces: one at most of each kind.
    one = every.groupBy(*key, "_line").agg(*[F.any_value(f"_p{k}", True).alias(f"_p{k}") for k in range(len(pieces))])
    cells = [F.coalesce(F.get(f"_p{places[i][0]}", places[i][1]), F.lit("")) if i in places else F.lit("") for i in range(width)]
    return one.select(*[F.col(n).alias(k) for k, n in zip(contract.key, key)], "_line", F.array(*cells).alias("cells"))


def _flat_cells(fields: Iterable[Field], column: int, path: str, dtype: T.StructType) -> Iterator[tuple[int, Column]]:
    """(grid column, cell) of the fields of the struct ``path`` that have no blocks in them."""
    for f in fields:
        name, kind = f"{path}.`{f.name}`", dtype[f.name].dataType
        if isinstance(f.type, Struct) and f.layout == "auto" and f.type.layout == "auto" and _has_block(f.type):
            yield from _flat_cells(f.type.fields, column, name, kind)
        elif f.layout != "block":
            yield from enumerate(record_cells(None, [replace(f, name=name)], {name: T.StructField(name, kind)}), column)
        column += field_span(f)


def _has_block(kind: Struct) -> bool:
    return any(f.layout == "block" or (isinstance(f.type, Struct) and _has_block(f.type)) for f in kind.fields)


def nest(rows: DataFrame, by: Sequence[str], value: Column, order: Sequence[str], name: str) -> DataFrame:
    """Ordered array per group, for groups that fit one row."""
    items = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(items)), lambda x: x["v"]).alias(name))


def to_grid(head: DataFrame, key: Sequence[str], head_cells: Sequence[Column], items: DataFrame,
            item_cells: Sequence[Column], item_order: Sequence[str]) -> DataFrame:
    """Block rows of parent records and their items: the first item shares the parent's
    row, later ones continue with empty parent cells.

    Items stay one row each: the first of a group is found by partial aggregation, not
    by gathering the group.  Rows come with ``_sort`` = (key, item order).
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = items.groupBy(*key).agg(F.min(F.struct(*item_order)).alias("_first"))
    tagged = items.join(first, list(key)).withColumn("_lead", F.struct(*item_order) == F.col("_first"))
    lead = head.select(*key, F.array(*[text(c) for c in head_cells]).alias("_head"))
    blank_head = F.array(*[F.lit("") for _ in head_cells])
    blank_item = F.array(*[F.lit("") for _ in item_cells])
    body = tagged.select(*key, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(item_order)], "_lead",
                         F.array(*[text(c) for c in item_cells]).alias("_item"))
    # Inner join and the parents without items apart: an outer join could not split the
    # items of one big parent.
    alone = lead.join(first.select(*key), list(key), "left_anti")
    joined = lead.join(body, list(key)).unionByName(alone, allowMissingColumns=True)
    cells = F.concat(F.when(F.coalesce("_lead", F.lit(True)), F.col("_head")).otherwise(blank_head),
                     F.coalesce("_item", blank_item))
    sort = [*key, *[f"_o{i}" for i in range(len(item_order))]]
    return joined.select(*sort, cells.alias("cells"))


def record_cells(df: DataFrame, fields, schema) -> list[Column]:
    """Cells of one record row: auto layout one cell per primitive, ``fix`` spread over its
    groups, ``pack`` and ``sep`` in one cell."""
    from ..contract import ListOf, MapOf, Struct, Union, field_span, span
    from ..functions.scalars import pack_value

    def cells(c: Column, kind, dtype, layout, width, sep) -> list[Column]:
        if layout == "pack" or (isinstance(kind, (Struct, Union)) and kind.layout == "pack"):
            return [pack_value(c, dtype)]
        if isinstance(kind, ListOf) and layout == "sep":
            return [F.array_join(F.transform(c, lambda e: cells(e, kind.item, dtype.elementType, "auto", 1, sep)[0]), sep)]
        if isinstance(kind, Struct) and kind.layout == "sep":
            return [F.concat_ws(kind.sep, *[F.coalesce(pack_value(c[f.name], dtype[f.name].dataType), F.lit(""))
                                            for f in kind.fields])]
        if isinstance(kind, Struct):
            return [x for f in kind.fields
                    for x in cells(c[f.name], f.type, dtype[f.name].dataType, f.layout, f.width, f.sep)]
        if isinstance(kind, Union):
            room = span(kind) - 1
            options = {i.name: cells(c[i.name], i, dtype[i.name].dataType, "auto", 1, sep) for i in kind.impls}
            out = [c["type"]]
            for n in range(room):
                pick = F.lit("")
                for name, have in options.items():
                    if n < len(have):
                        pick = F.when(c["type"] == name, have[n]).otherwise(pick)
                out.append(pick)
            return out
        if isinstance(kind, ListOf):
            return [x for i in range(width)
                    for x in cells(F.get(c, i), kind.item, dtype.elementType, "auto", 1, sep)]
        if isinstance(kind, MapOf):
            entry = dtype.elementType
            return [x for i in range(width) for part, k in (("key", kind.key), ("value", kind.value))
                    for x in cells(F.get(c, i)[part], k, entry[part].dataType, "auto", 1, sep)]
        return [pack_value(c, dtype)]

    out = []
    for f in fields:
        out += [F.coalesce(x, F.lit("")) for x in
                cells(F.col(f.name), f.type, schema[f.name].dataType, f.layout, f.width, f.sep)]
    return out
