"""Exports: JSON records, CSV, SQL script, split files."""

from __future__ import annotations

import hashlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..cluster import with_position
from ..contract import TableContract
from ..functions.scalars import csv_escape, is_default, number_text, sql_escape


def _json_value(c: Column, kind, dtype: T.DataType, drop_defaults: bool) -> Column:
    if isinstance(kind, C.ListOf):
        return F.transform(c, lambda e: _json_value(e, kind.item, dtype.elementType, drop_defaults))
    if isinstance(kind, C.MapOf):
        entries = F.map_entries(c) if isinstance(dtype, T.MapType) else c
        types = (dtype.keyType, dtype.valueType) if isinstance(dtype, T.MapType) else (
            dtype.elementType["key"].dataType, dtype.elementType["value"].dataType)
        return F.transform(entries, lambda e: F.struct(
            _json_value(e["key"], kind.key, types[0], drop_defaults).alias("key"),
            _json_value(e["value"], kind.value, types[1], drop_defaults).alias("value")))
    if isinstance(kind, C.Union) and not kind.recursive:
        # One struct type has to hold every choice: impl fields side by side, others NULL.  Fields that share a
        # name but not a type meet as VARIANT, which is written as what it holds.
        parts = [c["type"].alias("$type")]
        for name in dict.fromkeys(f.name for impl in kind.impls for f in impl.fields):
            owners = [impl for impl in kind.impls if name in [f.name for f in impl.fields]]
            mixed = len({C.spark_type(impl.field(name).type).simpleString() for impl in owners}) > 1
            pick = F.lit(None)
            for impl in owners:
                inner = dtype[impl.name].dataType[name].dataType
                value = _json_value(c[impl.name][name], impl.field(name).type, inner, drop_defaults)
                if mixed:
                    nested = isinstance(inner, (T.StructType, T.ArrayType, T.MapType))
                    value = F.parse_json(F.to_json(value)) if nested else value.cast("variant")
                pick = F.when(c["type"] == impl.name, value).otherwise(pick)
            parts.append(pick.alias(name))
        return F.when(c["type"].isNotNull(), F.struct(*parts))
    if isinstance(kind, C.Struct):
        fields = [_json_field(c[f.name], f, dtype[f.name].dataType, drop_defaults) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(F.lit(kind.name).alias("$type"), *fields))
    return c


def _json_field(c, f, dtype, drop_defaults):
    value = _json_value(c, f.type, dtype, drop_defaults)
    if drop_defaults and not isinstance(f.type, (C.Struct, C.Union)):
        value = F.when(~is_default(c, dtype), value)
    return value.alias(f.name)


def to_json_records(df: DataFrame, contract: TableContract, drop_defaults: bool = False) -> DataFrame:
    """One JSON document per record, ``$type`` first; default values left out on demand."""
    fields = [_json_field(F.col(f.name), f, df.schema[f.name].dataType, drop_defaults) for f in contract.fields]
    return df.select(F.to_json(F.struct(F.lit(contract.name).alias("$type"), *fields)).alias("value"))


def has_map(kind) -> bool:
    if isinstance(kind, C.MapOf):
        return True
    if isinstance(kind, C.ListOf):
        return has_map(kind.item)
    if isinstance(kind, C.Union):
        return any(has_map(i) for i in kind.impls)
    return isinstance(kind, (C.Struct, TableContract)) and any(has_map(f.type) for f in kind.fields)


def write_json_records(df: DataFrame, contract: TableContract, path: str, drop_defaults: bool = False,
                       mode: str = "errorifexists") -> bool:
    """Write JSON lines; a table that contains a map is skipped (returns False)."""
    if has_map(contract):
        return False
    to_json_records(df, contract, drop_defaults).write.mode(mode).text(path)
    return True


def csv_columns(df: DataFrame) -> list[Column]:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = number_text(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return out


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with byte order mark, header and CRLF in every part file; nested values as JSON."""
    text = df.select(*csv_columns(df))
    marked = text.withColumnRenamed(text.columns[0], "﻿" + text.columns[0])
    (marked.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("lineSep", "\r\n").option("encoding", "UTF-8").csv(path))


# Column types of the SQL script.
SQL_TYPES = {
    "bool": "tinyint(1) NOT NULL DEFAULT '0'",
    "int": "int(11) NOT NULL DEFAULT '0'",
    "long": "bigint(20) NOT NULL DEFAULT '0'",
    "float": "double NOT NULL DEFAULT '0'",
    "str": "text DEFAULT NULL",
    "text": "text DEFAULT NULL",
}
SQL_KEY_STRING = "varchar(255) NOT NULL"
SQL_NESTED = "text DEFAULT NULL"


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_name(name: str, prefix: str) -> str:
    from ..functions.naming import snake
    return prefix + snake(name).replace(".", "_")


def sql_ddl(contract: TableContract, prefix: str = "cfg_", drop: bool = True, if_not_exists: bool = True) -> str:
    """DDL text of one table, from the contract alone."""
    keyed = {k for key in (contract.key, *contract.uniques) for k in key}
    note = lambda s: s.replace("\r", " ").replace("\n", " ").replace("\\", "\\\\").replace("'", "''")
    table = _sql_name(contract.name, prefix)
    lines = []
    for f in contract.fields:
        kind = SQL_TYPES.get(f.type, SQL_NESTED) if isinstance(f.type, str) else SQL_NESTED
        if f.type == "str" and f.name in keyed:
            kind = SQL_KEY_STRING
        lines.append(f"  {_tick(f.name)} {kind}" + (f" COMMENT '{note(f.comment)}'" if f.comment else ""))
    lines.append(f"  PRIMARY KEY ({', '.join(map(_tick, contract.key))})")
    for u in contract.uniques:
        name = "uk_" + table + "_" + "_".join(u)
        if len(name) > 64:  # the longest name allowed; a digest keeps shortened names apart
            name = name[:55] + "_" + hashlib.sha256(name.encode()).hexdigest()[:8]
        lines.append(f"  UNIQUE KEY {_tick(name)} ({', '.join(map(_tick, u))})")
    head = f"DROP TABLE IF EXISTS {_tick(table)};\n\n" if drop else ""
    create = "CREATE TABLE IF NOT EXISTS" if if_not_exists else "CREATE TABLE"
    tail = f" COMMENT='{note(contract.comment)}'" if contract.comment else ""
    return head + f"{create} {_tick(table)} (\n" + ",\n".join(lines) + f"\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4{tail};\n"


def sql_literal(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, "1").otherwise("0")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = number_text(c)
    elif isinstance(dtype, T.NumericType):
        text = c.cast("string")
    else:
        nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        text = F.concat(F.lit("'"), sql_escape(F.to_json(c) if nested else c.cast("string")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def sql_statements(df: DataFrame, contract: TableContract, batch: int = 100, prefix: str = "cfg_") -> DataFrame:
    """``(batch, value)``: one INSERT per ``batch`` rows in key order."""
    cells = [sql_literal(F.col(f.name), df.schema[f.name].dataType) for f in contract.fields]
    row = F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))
    rest = [c for c in df.columns if c not in contract.key]
    order = [*contract.key, *[F.to_json(c) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c)
                              for c in rest]]
    placed = with_position(df.select("*"), order).select("_pos", row.alias("_text"))
    names = ", ".join(_tick(f.name) for f in contract.fields)
    head = f"INSERT INTO {_tick(_sql_name(contract.name, prefix))} ({names}) VALUES\n  "
    # A group is one statement of ``batch`` rows.
    grouped = placed.groupBy(F.floor(F.col("_pos") / batch).cast("long").alias("batch")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_text"))), lambda x: x["_text"]), ",\n  ").alias("_rows"))
    return grouped.select("batch", F.concat(F.lit(head), F.col("_rows"), F.lit(";")).alias("value"))


def write_sql_dump(df: DataFrame, contract: TableContract, path: str, batch: int = 100, mode: str = "errorifexists") -> None:
    """Script files in statement order: the DDL leads, then the INSERT batches."""
    spark = df.sparkSession
    ddl = spark.createDataFrame([(-1, sql_ddl(contract))], "batch long, value string")
    ddl.unionByName(sql_statements(df, contract, batch)).orderBy("batch").select("value").write.mode(mode).text(path)


def write_jdbc(df: DataFrame, contract: TableContract, url: str, properties: dict[str, str], mode: str = "append") -> None:
    """Straight into a database; nested values as JSON text.  The driver jar is the caller's."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                       for f in df.schema.fields])
    flat.write.mode(mode).jdbc(url, _sql_name(contract.name, "cfg_"), properties=properties)


def write_split(df: DataFrame, path: str, rows_per_file: int, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """No file holds more than ``rows_per_file`` records."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)
