"""From cells or JSON to typed values.  Bad input gives an error row and NULL, never a stop.

Empty cells stay NULL until `fill_defaults`, because key and must-fill rules need to
know what was empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..cluster import cut
from ..contract import TableContract, error_rows, field_span, span, spark_type, union_all
from ..functions.packed import cast_text, parse_packed
from ..functions.scalars import pack_id, split_sep, trim_space
from .recursive import Shape, issues_of, lowered, opened

ISSUES = "array<struct<kind:string,field:string,value:string,level:string>>"


def _none() -> Column:
    return F.array().cast(ISSUES)


def _issue(cond: Column, kind: str, path: Column, value: Column, level: str = "error") -> Column:
    one = F.array(F.struct(F.lit(kind).alias("kind"), path.alias("field"), value.cast("string").alias("value"),
                           F.lit(level).alias("level")))
    return F.when(cond, one).otherwise(_none())


def _join(issues: Sequence[Column]) -> Column:
    return F.flatten(F.array(*issues)) if issues else _none()


def _any_filled(cells: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in cells:
        out = out | (c != "")
    return out


def _sub(path: Column, name) -> Column:
    return F.concat(path, F.lit("."), name if isinstance(name, Column) else F.lit(str(name)))


def build(kind, cells: Sequence[Column], path: Column, layout: str = "auto", width: int = 1, sep: str = ";",
          header_layout: int = 2) -> tuple[Column, Column]:
    """(value, issues) of a type laid out over the given cells."""
    again = lambda k, cs, p: build(k, cs, p, header_layout=header_layout)
    if isinstance(kind, str):
        value = cast_text(cells[0], kind, header_layout)
        return value, _issue((cells[0] != "") & value.isNull(), C.NOT_MATCH_TYPE, path, cells[0])
    packed = layout == "pack" or (isinstance(kind, (C.Struct, C.Union)) and kind.layout == "pack")
    if packed:
        parsed = parse_packed(cells[0], kind)
        return parsed["value"], _issue(parsed["error"].isNotNull(), C.PARSE_PACK, path, cells[0])
    if isinstance(kind, C.ListOf) and layout == "sep":
        parts = F.filter(split_sep(cells[0], sep), lambda p: p != "")
        # The index belongs to the path, so positions are carried along.
        value = F.transform(parts, lambda p: again(kind.item, [p], path)[0])
        issues = F.flatten(F.transform(parts, lambda p, i: again(kind.item, [p], _sub(path, i.cast("string")))[1]))
        return value, issues
    if isinstance(kind, C.Struct) and kind.layout == "sep":
        parts = split_sep(cells[0], kind.sep)
        given = [F.coalesce(F.get(parts, i), F.lit("")) for i in range(len(kind.fields))]
        pairs = [again(f.type, [g], _sub(path, f.name)) for f, g in zip(kind.fields, given)]
        filled = cells[0] != ""
        short = filled & (F.size(parts) < len(kind.fields))
        extra = filled & (F.size(parts) > len(kind.fields))
        value = F.struct(*[v.alias(f.name) for f, (v, _) in zip(kind.fields, pairs)])
        inner = F.when(short, _none()).otherwise(_join([i for _, i in pairs]))
        return (F.when(filled & ~short, value),
                _join([_issue(short, C.SPAN_NOT_ENOUGH, path, cells[0]),
                       _issue(extra, C.CELL_NOT_USED, path, cells[0]), inner]))
    if isinstance(kind, C.Struct):
        values, issues, at = [], [], 0
        for f in kind.fields:
            n = field_span(f)
            v, e = build(f.type, cells[at:at + n], _sub(path, f.name), f.layout, f.width, f.sep, header_layout)
            values.append(v.alias(f.name))
            issues.append(e)
            at += n
        return F.when(_any_filled(cells), F.struct(*values)), _join(issues)
    if isinstance(kind, C.Union):
        return _build_union(kind, cells, path, header_layout)
    # fix / block: repeated groups; a group of empty cells is skipped
    n = span(kind.item) if isinstance(kind, C.ListOf) else span(kind.key) + span(kind.value)
    items, issues = [], []
    for i in range(len(cells) // n):
        group = cells[i * n:(i + 1) * n]
        if isinstance(kind, C.ListOf):
            v, e = again(kind.item, group, _sub(path, i))
        else:
            k = span(kind.key)
            kv, ke = again(kind.key, group[:k], _sub(path, f"{i}k"))
            vv, ve = again(kind.value, group[k:], _sub(path, f"{i}v"))
            v, e = F.struct(kv.alias("key"), vv.alias("value")), _join([ke, ve])
        filled = _any_filled(group)
        items.append(F.struct(filled.alias("on"), v.alias("v")))
        issues.append(F.when(filled, e).otherwise(_none()))
    kept = F.transform(F.filter(F.array(*items), lambda x: x["on"]), lambda x: x["v"])
    return kept, _join(issues)


def _build_union(kind: C.Union, cells, path, header_layout):
    """First cell names the implementation; without a name the default one is taken."""
    name = F.when(cells[0] != "", cells[0]).otherwise(F.lit(kind.default or ""))
    known = F.lit(False)
    parts, issues = [], []
    for impl in kind.impls:
        mine = name == impl.name
        known = known | mine
        v, e = build(impl, cells[1:1 + span(impl)], path, header_layout=header_layout)
        # A chosen implementation with empty cells is still that implementation.
        hollow = F.struct(*[F.lit(None).cast(spark_type(f.type)).alias(f.name) for f in impl.fields])
        parts.append(F.when(mine, F.coalesce(v, hollow)).alias(impl.name))
        issues.append(F.when(mine, e).otherwise(_none()))
    filled = _any_filled(cells)
    value = F.when(filled & known, F.struct(name.alias("type"), *parts))
    missing = _issue(filled & ~known, C.IMPL_NOT_FOUND, path, cells[0])
    return value, _join([missing, *issues])


def _finish(df: DataFrame, contract: TableContract, values: dict[str, tuple[Column, Column]],
            keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    typed = df.select(*keep, *[v.alias(n) for n, (v, _) in values.items()])
    key = [values[k][0].alias(k) for k in contract.key]
    lineage = [F.col(c) for c in keep]
    rows = df.select(*lineage, *key, F.explode(_join([e for _, e in values.values()])).alias("_x"))
    at = F.concat(F.col("_file"), F.lit("#!"), F.col("_row").cast("string")) if {"_file", "_row"} <= set(keep) else (
        F.col("_file") if "_file" in keep else None)
    rid = pack_id(rows.schema, contract.key)
    errors = error_rows(rows, "", contract.name, rid, F.col("_x.field"), F.col("_x.value"), at,
                        F.concat_ws(" ", "_x.kind", F.lit(contract.name), "_x.field"))
    fixed = rows.select(F.col("_x.kind").alias("err_type"), F.col("_x.level").alias("level"),
                        F.lit(contract.name).alias("table"), rid.alias("record_id"), F.col("_x.field").alias("field"),
                        F.col("_x.value").alias("value"),
                        (at if at is not None else F.lit(None)).cast("string").alias("lineage"),
                        F.concat_ws(" ", F.col("_x.kind"), F.lit(contract.name), F.col("_x.field")).alias("msg"))
    return typed, fixed


def cast_typed(df: DataFrame, contract: TableContract, header_layout: int = 2,
               keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Type a frame of text columns named like the contract's primitive fields."""
    text = lambda n: F.coalesce(trim_space(n), F.lit(""))
    values = {f.name: build(f.type, [text(f.name)], F.lit(f.name), f.layout, f.width, f.sep, header_layout)
              for f in contract.fields}
    return _finish(df, contract, values, keep)


def type_grid(body: DataFrame, contract: TableContract, header_layout: int = 2,
              keep: Sequence[str] = ("_file", "_row")) -> tuple[DataFrame, DataFrame]:
    """Type the cells of a grid; block fields take what `fold_blocks` gathered elsewhere."""
    values, at = {}, 0
    for f in contract.fields:
        cells = [F.coalesce(F.get("cells", at + i), F.lit("")) for i in range(field_span(f))]
        values[f.name] = build(f.type, cells, F.lit(f.name), f.layout, f.width, f.sep, header_layout)
        at += field_span(f)
    return _finish(body, contract, values, keep)


def assemble_struct(df: DataFrame, contract: TableContract, cells: str = "cells") -> tuple[DataFrame, DataFrame]:
    """Rows of cells to typed fields by span; too few or too many cells are errors."""
    need = sum(field_span(f) for f in contract.fields)
    keep = [c for c in df.columns if c != cells]
    named = df.withColumnRenamed(cells, "cells") if cells != "cells" else df
    typed, errors = type_grid(named, contract, keep=keep)
    size = F.size("cells")
    rid = F.get("cells", C.column_of(contract, contract.key[0]))
    off = named.where(size != need)
    kind = F.when(size < need, C.SPAN_NOT_ENOUGH).otherwise(C.CELL_NOT_USED)
    shape = error_rows(off, "", contract.name, rid, F.lit(None), F.concat_ws(",", F.slice("cells", F.lit(need + 1), size)),
                       None, F.concat(kind, F.lit(" " + contract.name))).withColumn("err_type", F.split("msg", " ")[0])
    return typed, errors.unionByName(shape)


def assemble_fixed(df: DataFrame, groups: Sequence[Sequence[str]], kind, name: str) -> DataFrame:
    """N repeated column groups to one list or map entry list; all-empty groups are skipped."""
    items = []
    for group in groups:
        filled = F.lit(False)
        for c in group:
            filled = filled | (F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
        if isinstance(kind, C.MapOf):
            v = F.struct(F.col(group[0]).alias("key"), F.col(group[1]).alias("value"))
        elif isinstance(kind.item, C.Struct):
            v = F.struct(*[F.col(c).alias(f.name) for c, f in zip(group, kind.item.fields)])
        else:
            v = F.col(group[0])
        items.append(F.struct(filled.alias("on"), v.alias("v")))
    kept = F.transform(F.filter(F.array(*items), lambda x: x["on"]), lambda x: x["v"])
    return df.withColumn(name, kept.cast(spark_type(kind)))


def resolve_variant(df: DataFrame, name: str, kind: C.Union, cells: Sequence[str], out: str,
                    record_id: Column, table: str) -> tuple[DataFrame, DataFrame]:
    """Tagged struct from an implementation-name column and its argument columns.

    Each implementation reads the leading argument columns it has fields for.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    value, issues = _build_union(kind, [text(name), *[text(c) for c in cells]], F.lit(out), 2)
    typed = df.withColumn(out, value)
    rows = df.select(record_id.alias("_id"), F.explode(issues).alias("_x"))
    errors = error_rows(rows, "", table, F.col("_id"), F.col("_x.field"), F.col("_x.value"), None,
                        F.concat_ws(" ", "_x.kind", F.lit(table), "_x.field")).withColumn("err_type", F.split("msg", " ")[0])
    return typed, errors


# ---------------------------------------------------------------- defaults

def default_of(kind) -> Column:
    if isinstance(kind, str):
        zero = {"bool": F.lit(False), "str": F.lit(""), "text": F.lit("")}
        return zero.get(kind, F.lit(0)).cast(spark_type(kind))
    if isinstance(kind, (C.ListOf, C.MapOf)):
        return F.array().cast(spark_type(kind))
    if isinstance(kind, C.Union):
        if kind.recursive:
            return F.parse_json(F.lit(f'{{"$type":"{kind.default}"}}'))
        return F.struct(F.lit(kind.default).alias("type"), *[
            (default_of(i) if i.name == kind.default else F.lit(None)).cast(spark_type(i)).alias(i.name) for i in kind.impls])
    return F.struct(*[default_of(f.type).alias(f.name) for f in kind.fields])


def filled(c: Column, kind) -> Column:
    """The value with every empty part replaced by its type's default."""
    if isinstance(kind, str):
        return F.coalesce(c, default_of(kind))
    if isinstance(kind, C.ListOf):
        inner = c if isinstance(kind.item, str) else F.transform(c, lambda e: filled(e, kind.item))
        if isinstance(kind.item, str):
            inner = F.transform(c, lambda e: F.coalesce(e, default_of(kind.item)))
        return F.coalesce(inner, default_of(kind))
    if isinstance(kind, C.MapOf):
        return F.coalesce(F.transform(c, lambda e: F.struct(
            filled(e["key"], kind.key).alias("key"), filled(e["value"], kind.value).alias("value"))), default_of(kind))
    if isinstance(kind, C.Union):
        if kind.recursive:
            return F.coalesce(c, default_of(kind))
        chosen = F.struct(c["type"].alias("type"), *[
            F.when(c["type"] == i.name, filled(c[i.name], i)).alias(i.name) for i in kind.impls])
        return F.when(c.isNull() | c["type"].isNull(), default_of(kind)).otherwise(chosen)
    return F.struct(*[filled(c[f.name], f.type).alias(f.name) for f in kind.fields])


def fill_defaults(df: DataFrame, contract: TableContract) -> DataFrame:
    names = {f.name: f for f in contract.fields}
    return df.select(*[filled(F.col(c), names[c].type).alias(c) if c in names else F.col(c) for c in df.columns])


def _has_lower(kind, seen: frozenset = frozenset()) -> bool:
    """Whether a type has a lower-cased field anywhere inside."""
    if isinstance(kind, str) or id(kind) in seen:
        return False
    seen = seen | {id(kind)}
    if isinstance(kind, C.Struct):
        return any(f.lowercase or _has_lower(f.type, seen) for f in kind.fields)
    inner = kind.impls if isinstance(kind, C.Union) else (kind.item,) if isinstance(kind, C.ListOf) else (kind.key, kind.value)
    return any(_has_lower(k, seen) for k in inner)


def _lowered(c: Column, kind, lower: bool = False) -> Column:
    if isinstance(kind, str):
        return F.lower(c) if lower and kind in ("str", "text") else c
    if isinstance(kind, C.ListOf) and lower and isinstance(kind.item, str):
        return F.transform(c, lambda e: _lowered(e, kind.item, True))
    if not _has_lower(kind) or isinstance(kind, C.Union) and kind.recursive:
        return c
    if isinstance(kind, C.ListOf):
        return F.transform(c, lambda e: _lowered(e, kind.item))
    if isinstance(kind, C.MapOf):
        return F.transform(c, lambda e: F.struct(_lowered(e["key"], kind.key).alias("key"), _lowered(e["value"], kind.value).alias("value")))
    if isinstance(kind, C.Union):
        return F.when(c.isNotNull(), F.struct(c["type"].alias("type"), *[_lowered(c[i.name], i).alias(i.name) for i in kind.impls]))
    return F.when(c.isNotNull(), F.struct(*[_lowered(c[f.name], f.type, f.lowercase).alias(f.name) for f in kind.fields]))


def normalise_lower(df: DataFrame, contract: TableContract) -> DataFrame:
    """Lower-cased fields in lower case, at any depth; recursive values are opened and built again, which runs jobs."""
    named = {f.name: f for f in contract.fields}
    out = df.select(*[_lowered(F.col(c), named[c].type, named[c].lowercase).alias(c) if c in named else F.col(c) for c in df.columns])
    for f in contract.fields:
        if isinstance(f.type, C.Union) and f.type.recursive and _has_lower(f.type):
            out = lowered(out, f.name, f.type)
    return out


# -------------------------------------------------------------------- JSON

# Members of a JSON record that are not fields.
JSON_EXTRAS = ("$type", "$note", "$fold", "$refs")


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_number(k: Column) -> Column:
    return k.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")


def from_variant(v: Column, kind, path: Column, lower: bool = False) -> tuple[Column, Column]:
    """(value, issues) of a JSON value.  Missing gives the default, a wrong type an error too."""
    gone = v.isNull() | F.is_variant_null(v)
    shape = _kind(v)
    shown = F.to_json(v)
    wrong = lambda ok: _issue(~gone & ~ok, C.JSON_VALUE_MISMATCH, path, shown)
    if isinstance(kind, str):
        if kind == "bool":
            ok = (shape == "BOOLEAN") | _is_number(shape)
            value = F.when(shape == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(
                _is_number(shape), F.try_variant_get(v, "$", "double") == 1)
        elif kind in ("int", "long"):
            ok = _is_number(shape)
            whole = F.try_variant_get(v, "$", "bigint")
            cut = F.try_variant_get(v, "$", "double").try_cast("bigint")
            value = F.when(shape == "BIGINT", whole).when(ok, cut).try_cast(spark_type(kind).simpleString())
            ok = ok & value.isNotNull()  # a number out of the type's range is an error, not a default
        elif kind == "float":
            ok = _is_number(shape)
            value = F.when(ok, F.try_variant_get(v, "$", "double"))
        else:
            ok = shape == "STRING"
            value = F.when(ok, F.try_variant_get(v, "$", "string"))
            value = F.lower(value) if lower else value
        return F.coalesce(value, default_of(kind)), wrong(ok)
    if isinstance(kind, C.ListOf):
        ok = shape.startswith("ARRAY")
        items = F.try_variant_get(v, "$", "array<variant>")
        value = F.transform(items, lambda e: from_variant(e, kind.item, path)[0])
        inner = F.flatten(F.transform(items, lambda e, i: from_variant(e, kind.item, _sub(path, i.cast("string")))[1]))
        return F.coalesce(value, default_of(kind)), _join([wrong(ok), F.coalesce(inner, _none())])
    if isinstance(kind, C.MapOf):
        ok = shape.startswith("ARRAY")
        items = F.try_variant_get(v, "$", "array<variant>")
        entry = lambda e, p: (from_variant(_at(e, "key"), kind.key, p), from_variant(_at(e, "value"), kind.value, p))
        value = F.transform(items, lambda e: F.struct(entry(e, path)[0][0].alias("key"), entry(e, path)[1][0].alias("value")))
        inner = F.flatten(F.transform(items, lambda e, i: _join([x[1] for x in entry(e, _sub(path, i.cast("string")))])))
        return F.coalesce(value, default_of(kind)), _join([wrong(ok), F.coalesce(inner, _none())])
    if isinstance(kind, C.Union):
        return _union_from_variant(v, kind, path, gone)
    ok = shape.startswith("OBJECT")
    pairs = [(f, from_variant(_at(v, f.name), f.type, _sub(path, f.name), f.lowercase)) for f in kind.fields]
    value = F.struct(*[p[0].alias(f.name) for f, p in pairs])
    extra = _extra_fields(v, [f.name for f in kind.fields], path)
    inner = F.when(ok, _join([p[1] for _, p in pairs] + [extra])).otherwise(_none())
    return value, _join([wrong(ok), inner])


def _extra_fields(v: Column, names: Sequence[str], path: Column) -> Column:
    keys = F.json_object_keys(F.to_json(v))
    rest = F.filter(F.array_except(keys, F.array(*[F.lit(n) for n in (*names, *JSON_EXTRAS)])),
                    lambda k: ~k.startswith("$embed_"))
    return _issue(F.size(rest) > 0, C.JSON_EXTRA, path, F.array_join(F.array_sort(rest), ","), "warning")


def _union_from_variant(v, kind: C.Union, path, gone):
    tag = F.try_variant_get(v, "$[\"$type\"]", "string")
    name = F.when(tag.startswith(kind.name + "."), tag.substr(F.lit(len(kind.name) + 2), F.length(tag))).otherwise(tag)
    known = F.coalesce(name.isin(*[i.name for i in kind.impls]), F.lit(False))
    present = ~gone
    no_type = _issue(present & tag.isNull(), C.JSON_TYPE_MISSING, path, F.lit(kind.name))
    bad_type = _issue(present & tag.isNotNull() & ~known, C.JSON_TYPE_MISMATCH, path, tag)
    if kind.recursive:
        return F.when(known, v).otherwise(default_of(kind)), _join([no_type, bad_type])
    parts, issues = [], []
    for i in kind.impls:
        value, inner = from_variant(v, i, path)
        parts.append(F.when(name == i.name, value).alias(i.name))
        issues.append(F.when(present & (name == i.name), inner).otherwise(_none()))
    chosen = F.struct(name.alias("type"), *parts)
    return F.when(known, chosen).otherwise(default_of(kind)), _join([no_type, bad_type, *issues])


def json_to_typed(df: DataFrame, text: str, contract: TableContract,
                  keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """JSON documents to typed records plus errors and warnings."""
    kept = [F.col(k) for k in keep]
    parsed = df.select(*kept, F.col(text).alias("_text"), F.try_parse_json(text).alias("_v"))
    empty = trim_space(F.coalesce("_text", F.lit(""))) == ""
    values = {f.name: from_variant(_at(F.col("_v"), f.name), f.type, F.lit(f.name), f.lowercase) for f in contract.fields}
    extra = F.when(F.col("_v").isNotNull(), _extra_fields(F.col("_v"), [f.name for f in contract.fields], F.lit(contract.name))).otherwise(_none())
    broken = _join([_issue(empty, C.JSON_EMPTY, F.lit(contract.name), F.col("_text")),
                    _issue(~empty & F.col("_v").isNull(), C.JSON_PARSE, F.lit(contract.name), F.col("_text"))])
    first = contract.fields[0].name
    v, e = values[first]
    values[first] = (v, _join([e, extra, broken]))
    typed, errors = _finish(parsed, contract, values, keep)
    deep = [f for f in contract.fields if isinstance(f.type, C.Union) and f.type.recursive and f.type.impls]
    return typed, union_all([errors, *(_recursive_errors(parsed, contract, values, keep, f) for f in deep)])


def _recursive_errors(parsed: DataFrame, contract: TableContract, values: dict, keep: Sequence[str], f: C.Field) -> DataFrame:
    """Errors inside a recursive value, at any depth.  The value itself stays as it was written."""
    key = [values[k][0].alias(f"_key{i}") for i, k in enumerate(contract.key)]
    frame = parsed.select(*keep, *key, _at(F.col("_v"), f.name).alias("_v")).where(~F.is_variant_null("_v"))
    names, shape = [*keep, *[f"_key{i}" for i in range(len(key))]], Shape(f.type)
    frame = cut(frame.withColumn("_rid", F.monotonically_increasing_id()), "recursive")
    levels = opened(frame.select("_rid", "_v"), ["_rid"], shape, F.lit(f.name))
    # Of the value itself its tag has been judged with the record.
    found = issues_of(levels, ["_rid"], shape).where((F.col("field") != f.name) | (F.col("kind") == C.JSON_EXTRA))
    rows = found.join(frame.select("_rid", *names), "_rid")
    at = F.concat(F.col("_file"), F.lit("#!"), F.col("_row").cast("string")) if {"_file", "_row"} <= set(keep) else (
        F.col("_file") if "_file" in keep else None)
    return error_rows(rows, F.col("kind"), contract.name, pack_id(rows.schema, names[len(keep):]), F.col("field"), F.col("value"), at,
                      F.concat_ws(" ", "kind", F.lit(contract.name), "field"), F.col("level"))
