"""Ingest, typing, export, change and streaming queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import contract as C
from ..cluster import cut, scratch_path, with_position
from ..functions import scalars as S
from ..functions.packed import parse_packed
from ..operators import blocks, changes, checks, refs, typed
from ..operators.support import ReferenceIndex
from ..sources import grid as G
from ..sources import records as R
from ..sources import sinks
from ..streaming import validate as stream
from . import fixtures, star
from .registry import num, query

PART_NAMES = [f.name for f in star.PART.fields]
PART_COMMENTS = ["#key", "name\nof part", "P_Brand", "", "size", "price"]
PART_TYPES = ["LONG", "STRING", "STRING", "HASHID", "INT", "FLOAT"]


def part_cells(spark, sf):
    """Part as typed text; comment rows and blank rows are planted beside the real ones."""
    df = star.read(spark, sf, "part")
    rows = df.select(*fixtures.text_of(df), F.col("p_partkey").alias("_k"))
    noted = rows.where("_k % 97 = 0").withColumn("p_partkey", F.concat(F.lit("#"), "p_partkey"))
    blank = rows.where("_k % 89 = 0").select(*[F.lit("").alias(n) for n in PART_NAMES], "_k")
    return rows.unionByName(noted).unionByName(blank)


def part_grid(spark, sf, layout: int = 2, names=None, encoding="UTF-8", by="part"):
    names = names or PART_NAMES
    heads = {2: [PART_COMMENTS, names], 3: [PART_COMMENTS, names, ["x"] * 6], 4: [names, PART_TYPES, [""] * 6, PART_COMMENTS]}[layout]
    path = fixtures.write_grid(part_cells(spark, sf), by, heads, "_k", encoding)
    return G.with_table_name(G.read_grid(spark, path, encoding=encoding), path, by_folder=True)


_PART_TEXT = f"""CAST(p_partkey AS VARCHAR) AS c0, p_name AS c1, p_brand AS c2, p_type AS c3,
  CAST(p_size AS VARCHAR) AS c4, {num('p_retailprice')} AS c5"""


@query("s1_read_grid", f"""
SELECT {_PART_TEXT} FROM part
UNION ALL SELECT '#' || c0, c1, c2, c3, c4, c5 FROM (SELECT {_PART_TEXT}, p_partkey FROM part) WHERE p_partkey % 97 = 0
UNION ALL SELECT '', '', '', '', '', '' FROM part WHERE p_partkey % 89 = 0""")
def s1_read_grid(spark, sf):
    grid = part_grid(spark, sf, encoding="GBK")
    return grid.where("_row >= 2").select(*[G.cell(i).alias(f"c{i}") for i in range(6)])


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
LINE_CONTRACT = C.TableContract("lineitem", ("l_orderkey", "l_linenumber"), star.fields(
    "l_orderkey:long l_linenumber:int l_partkey:long l_suppkey:long l_quantity:float"))


def line_grid(spark, sf):
    df = star.read(spark, sf, "lineitem").select(*LINE_COLUMNS)
    rows = df.select(*fixtures.text_of(df), F.xxhash64(*LINE_COLUMNS).alias("_k"))
    path = fixtures.write_grid(rows, "lineitem", [[""] * 5, LINE_COLUMNS], "_k")
    return G.with_table_name(G.read_grid(spark, path, encoding="UTF-8"), path, by_folder=True)


@query("s2_with_table_name", "SELECT 'lineitem' AS \"table\", count(*) AS n, true AS sharded FROM lineitem")
def s2_with_table_name(spark, sf):
    grid = line_grid(spark, sf).where("_row >= 2")
    return grid.groupBy(F.col("_table").alias("table")).agg(F.count("*").alias("n"), (F.max("_shard") > 0).alias("sharded"))


@query("s3_union_shards", f"SELECT {', '.join(LINE_COLUMNS)} FROM lineitem")
def s3_union_shards(spark, sf):
    _, rows, _ = G.union_shards(line_grid(spark, sf), "lineitem")
    return typed.type_grid(rows, LINE_CONTRACT)[0].select(*LINE_COLUMNS)


@query("s4_split_header", """
WITH p AS (SELECT count(*) + count(*) FILTER (p_partkey % 97 = 0) AS filled FROM part)
SELECT layout, i AS "index", name, comment, CASE WHEN layout = 4 THEN type ELSE '' END AS type, filled
FROM (VALUES (0, 'p_partkey', 'key', 'LONG'), (1, 'p_name', 'name--of part', 'STRING'), (2, 'p_brand', '', 'STRING'),
  (3, 'p_type', '', 'HASHID'), (4, 'p_size', 'size', 'INT'), (5, 'p_retailprice', 'price', 'FLOAT')) t(i, name, comment, type),
  (VALUES (2), (3), (4)) l(layout), p""")
def s4_split_header(spark, sf):
    out = []
    for layout in (2, 3, 4):
        names = [n + ("@tag" if n == "p_name" else ".x" if n == "p_type" else "") for n in PART_NAMES]
        split = G.split_header(part_grid(spark, sf, layout, names), layout)
        columns = split.header.select(F.explode("columns").alias("c")).select("c.*").distinct()
        counts = split.body.select(F.posexplode("cells").alias("i", "v")).groupBy("i").agg(F.count_if(F.col("v") != "").alias("filled"))
        out.append(columns.join(counts, columns["index"] == counts["i"]).select(
            F.lit(layout).alias("layout"), "index", "name", "comment", "type", "filled"))
    return C.union_all(out)


@query("s5_transpose_columns", "SELECT CAST(n_nationkey AS VARCHAR) AS c0, n_name AS c1, CAST(n_regionkey AS VARCHAR) AS c2 FROM nation")
def s5_transpose_columns(spark, sf):
    nation = star.read(spark, sf, "nation")
    cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in nation.columns]))
    sideways = nation.select("n_nationkey", cells.alias("_row", "v")).groupBy(F.lit("nation.csv").alias("_file"), F.col("_row").cast("long").alias("_row")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "v"))), lambda x: x["v"]).alias("cells"))
    return G.transpose_columns(sideways).select(*[G.cell(i).alias(f"c{i}") for i in range(3)])


@query("s6_drop_comment_and_blank_rows", f"SELECT {_PART_TEXT} FROM part")
def s6_drop_comment_and_blank_rows(spark, sf):
    body = G.drop_comment_and_blank_rows(G.split_header(part_grid(spark, sf)).body)
    return body.select(*[G.cell(i).alias(f"c{i}") for i in range(6)])


def supplier_documents(spark, sf, broken: bool = False):
    df = star.read(spark, sf, "supplier")
    text = F.to_json(F.struct(F.lit("supplier").alias("$type"), *df.columns))
    if broken:
        text = F.when(F.col("s_suppkey") % 31 == 0, F.lit('{"s_suppkey":')).otherwise(text)
    return df.select(F.col("s_suppkey").alias("id"), text.alias("text"))


@query("s7_read_json_records", """
SELECT CASE WHEN s_suppkey % 31 = 0 THEN 0 ELSE s_suppkey END AS s_suppkey, CASE WHEN s_suppkey % 31 = 0 THEN '' ELSE s_name END AS s_name,
  CASE WHEN s_suppkey % 31 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def s7_read_json_records(spark, sf):
    path = fixtures.write_documents(supplier_documents(spark, sf, broken=True), "supplier")
    return R.read_json_records(spark, path, star.SUPPLIER)[0].select("s_suppkey", "s_name", "s_acctbal")


@query("s7_read_json_errors", "SELECT 'JsonParseException' AS err_type, count(*) AS n FROM supplier WHERE s_suppkey % 31 = 0")
def s7_read_json_errors(spark, sf):
    path = fixtures.write_documents(supplier_documents(spark, sf, broken=True), "supplier")
    return R.read_json_records(spark, path, star.SUPPLIER)[1].groupBy("err_type").agg(F.count("*").alias("n"))


_FILES = ", ".join(f"('{t}.parquet')" for t in (*star.ALL, "embeddings"))


@query("s8_file_manifest", f"SELECT path, 'parquet' AS fmt FROM (VALUES {_FILES}) t(path)")
def s8_file_manifest(spark, sf):
    return R.file_manifest(spark, sf).select("path", "fmt")


@query("s9_manifest_diff", "SELECT * FROM (VALUES ('nation.parquet', 'added'), ('orders.parquet', 'changed'), ('ghost.parquet', 'removed')) t(path, change)")
def s9_manifest_diff(spark, sf):
    new = R.file_manifest(spark, sf)
    shifted = F.when(F.col("path") == "orders.parquet", F.col("modified") - F.expr("interval 1 day")).otherwise(F.col("modified"))
    ghost = new.where("path = 'region.parquet'").withColumn("path", F.lit("ghost.parquet"))
    old = new.where("path <> 'nation.parquet'").withColumn("modified", shifted).unionByName(ghost)
    return R.manifest_diff(old, new)


@query("s10_write_json_records", """
SELECT '{"$type":"customer","c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' ||
  CAST(c_acctbal AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '"}' AS value FROM customer""")
def s10_write_json_records(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json_records(star.read(spark, sf, "customer"), star.CUSTOMER, path)
    return spark.read.text(path)


MIXED = C.Union("Mixed", (C.Struct("Num", star.fields("v:int w:str")), C.Struct("Text", star.fields("v:str")),
                           C.Struct("Pair", (C.Field("v", C.Struct("Both", star.fields("a:int b:float"))),))), default="Num")


@query("s10_union_fields", """
SELECT '{"$type":"part","p_partkey":' || p_partkey || ',"m":{"$type":"' || CASE p_partkey % 3 WHEN 0 THEN 'Num","v":' || p_size || ',"w":"' || p_brand || '"'
  WHEN 1 THEN 'Text","v":"' || p_name || '"' ELSE 'Pair","v":{"$type":"Both","a":' || p_size || ',"b":0.5}' END || '}}' AS value FROM part""")
def s10_union_fields(spark, sf):
    kind = F.col("p_partkey") % 3
    value = F.struct(
        F.when(kind == 0, "Num").when(kind == 1, "Text").otherwise("Pair").alias("type"),
        F.when(kind == 0, F.struct(F.col("p_size").alias("v"), F.col("p_brand").alias("w"))).alias("Num"),
        F.when(kind == 1, F.struct(F.col("p_name").alias("v"))).alias("Text"),
        F.when(kind == 2, F.struct(F.struct(F.col("p_size").alias("a"), F.lit(0.5).alias("b")).alias("v"))).alias("Pair"))
    df = star.read(spark, sf, "part").select("p_partkey", value.alias("m"))
    contract = C.TableContract("part", ("p_partkey",), (C.Field("p_partkey", "long"), C.Field("m", MIXED)))
    return sinks.to_json_records(df, contract)


@query("s10_drop_defaults", """
SELECT '{"$type":"labels"' || CASE WHEN doc_id = 0 THEN '' ELSE ',"doc_id":' || doc_id END || CASE WHEN quality = 0 THEN '' ELSE ',"quality":' || quality END
  || CASE WHEN toxic = 0 THEN '' ELSE ',"toxic":' || toxic END || '}' AS value FROM labels""")
def s10_drop_defaults(spark, sf):
    return sinks.to_json_records(star.read(spark, sf, "labels"), star.LABELS, drop_defaults=True)


@query("s11_write_csv", f"""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ',"x"' AS c_name, {num('c_acctbal')} AS c_acctbal, '{{"n":' || c_nationkey || '}}' AS nested FROM customer""")
def s11_write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    df = star.read(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(',"x"')).alias("c_name"), "c_acctbal",
                                                 F.struct(F.col("c_nationkey").alias("n")).alias("nested"))
    sinks.write_csv(df, path)
    # One header line per file: what the two-row reader calls the name row is data here.
    rows = G.read_grid(spark, path).where("_row >= 1")
    return rows.select(*[G.cell(i).alias(c) for i, c in enumerate(df.columns)])


@query("s12_write_sql_dump", f"""
SELECT (rn - 1) // 100 AS batch, 'INSERT INTO `cfg_part` (`p_partkey`, `p_name`, `p_brand`, `p_type`, `p_size`, `p_retailprice`) VALUES' || chr(10) || '  ' ||
  string_agg('(' || p_partkey || ', ''' || p_name || ''', ''' || p_brand || ''', ''' || p_type || ''', ' || p_size || ', ' || {num('p_retailprice')} || ')',
  ',' || chr(10) || '  ' ORDER BY p_partkey) || ';' AS value
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) GROUP BY 1""")
def s12_write_sql_dump(spark, sf):
    return sinks.sql_statements(star.read(spark, sf, "part"), star.PART)


@query("s13_write_split", "SELECT count(*) AS n, true AS within FROM orders")
def s13_write_split(spark, sf):
    path = scratch_path(spark, "split")
    sinks.write_split(star.read(spark, sf, "orders"), path, 1000)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("c"))
    return files.agg(F.sum("c").alias("n"), (F.max("c") <= 1000).alias("within"))


_ITEM = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def block_grid(spark, sf):
    """Orders and their items as block rows."""
    d = star.dataset(spark, sf)
    items = d.frames["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey")
    return blocks.to_grid(d.frames["orders"], ["o_orderkey"], [F.col("o_orderkey"), F.col("o_orderstatus")],
                          items, [F.col("l_linenumber"), F.col("l_partkey")], _ITEM)


@query("s14_to_grid", """
SELECT CASE WHEN rn = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS c0, CASE WHEN rn = 1 THEN o_orderstatus ELSE '' END AS c1,
  coalesce(CAST(l_linenumber AS VARCHAR), '') AS c2, coalesce(CAST(l_partkey AS VARCHAR), '') AS c3, o_orderkey AS k
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)""")
def s14_to_grid(spark, sf):
    return block_grid(spark, sf).select(*[G.cell(i).alias(f"c{i}") for i in range(4)], F.col("o_orderkey").alias("k"))


@query("b1_fold_records", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, coalesce(CAST(l_linenumber AS VARCHAR), '') AS l_linenumber,
  coalesce(CAST(l_partkey AS VARCHAR), '') AS l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def b1_fold_records(spark, sf):
    grid = block_grid(spark, sf)
    rows = with_position(grid, [c for c in grid.columns if c != "cells"], "_row").withColumn("_file", F.lit("orders.csv"))
    folded = cut(blocks.fold_records(rows.select("_file", "_row", "cells"), [0]), "folded")
    heads = folded.where(F.col("_row") == F.col("_record")).select(
        F.col("_record").alias("_r"), G.cell(0).alias("o_orderkey"), G.cell(1).alias("o_orderstatus"))
    return folded.join(heads, F.col("_record") == F.col("_r")).select(
        "o_orderkey", "o_orderstatus", G.cell(2).alias("l_linenumber"), G.cell(3).alias("l_partkey"))


def three_level_grid(spark, sf):
    """Customers, their orders and the items of those as block rows."""
    d = star.dataset(spark, sf)
    orders = d.frames["customer"].select("c_custkey").join(
        d.frames["orders"].select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    order = ["c_custkey", "o_orderkey", *_ITEM]
    # The first row of each record and of each order shows their keys; later ones leave them empty.  A null key comes first.
    first = F.when(F.count_if(F.col("o_orderkey").isNull()) == 0, F.min("o_orderkey")).alias("_co")
    orders = orders.join(orders.groupBy("c_custkey").agg(first), "c_custkey").select(
        "c_custkey", "o_orderkey", F.col("o_orderkey").eqNullSafe(F.col("_co")).alias("_lead"))
    items = d.frames["lineitem"].select("l_orderkey", *_ITEM)
    firsts = items.groupBy(F.col("l_orderkey").alias("_k")).agg(F.min(F.struct(*_ITEM)).alias("_of"))
    joined = orders.join(firsts, F.col("_k") == F.col("o_orderkey"), "left").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lead_o = F.col("_of").isNull() | F.struct(*_ITEM).eqNullSafe(F.col("_of"))
    # Keys and two flags travel; their texts are made where the rows are read.
    placed = with_position(joined.select(*order, (F.col("_lead") & lead_o).alias("_c"), lead_o.alias("_o")), order, "_row")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = F.array(F.when(F.col("_c"), text("c_custkey")).otherwise(""), F.when(F.col("_o"), text("o_orderkey")).otherwise(""),
                    F.when(F.col("l_linenumber").isNotNull(), F.concat_ws(":", "l_linenumber", "l_partkey")).otherwise(""))
    return placed.select(F.lit("customer.csv").alias("_file"), "_row", cells.alias("cells"))


@query("b2_fold_blocks", """
SELECT 1 AS level, CAST(c_custkey AS VARCHAR) AS c, coalesce(CAST(o_orderkey AS VARCHAR), '') AS o, '' AS l
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT 2, CAST(c_custkey AS VARCHAR), coalesce(CAST(o_orderkey AS VARCHAR), ''), coalesce(l_linenumber || ':' || l_partkey, '')
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def b2_fold_blocks(spark, sf):
    grid = three_level_grid(spark, sf)
    outer, inner = blocks.fold_blocks(grid, [0], [1, 2], in_order=True)
    heads = outer.where(F.col("_row") == F.col("_record")).select(F.col("_record").alias("_r"), G.cell(0).alias("c"))
    mids = outer.join(heads, F.col("_record") == F.col("_r")).select(F.col("_item1").alias("_m"), "c", G.cell(1).alias("o"))
    one = mids.select(F.lit(1).alias("level"), "c", "o", F.lit("").alias("l"))
    # The items move once: an order brings its customer along.
    two = inner.select("_item1", G.cell(2).alias("l")).join(mids, F.col("_item1") == F.col("_m")).select(F.lit(2).alias("level"), "c", "o", "l")
    return one.unionByName(two)


ORDER_ROWS = C.TableContract("orders", ("o_orderkey",), (*star.fields("o_orderkey:long o_orderstatus:str"), C.Field(
    "items", C.ListOf(C.Struct("Item", star.fields("l_linenumber:int l_partkey:long"))), "block")))


@query("b1_fold_shards", """
SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def b1_fold_shards(spark, sf):
    grid = block_grid(spark, sf)
    rows = with_position(grid, [c for c in grid.columns if c != "cells"], "_row")
    # Shards of 997 rows end in the middle of records; their rows come in any order.
    shard = F.floor(F.col("_row") / 997)
    rows = rows.select(shard.alias("_shard"), F.concat(F.lit("orders_"), shard.cast("string"), F.lit(".csv")).alias("_file"),
                       (F.col("_row") % 997).alias("_row"), "cells")
    records, _ = blocks.nested_records(rows, ORDER_ROWS)
    return records.select("o_orderkey", "o_orderstatus", F.explode_outer("items").alias("i")).select(
        "o_orderkey", "o_orderstatus", "i.l_linenumber", "i.l_partkey")


THREE_ROWS = C.TableContract("customer", ("c",), (C.Field("c", "long"), C.Field("orders", C.ListOf(C.Struct("Order", (
    C.Field("o", "long"), C.Field("items", C.ListOf(C.Struct("Line", star.fields("l:str"))), "block")))), "block")))


@query("b2_fold_three_levels", """
SELECT c_custkey AS c, o_orderkey AS o, l_linenumber || ':' || l_partkey AS l
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def b2_fold_three_levels(spark, sf):
    records, _ = blocks.nested_records(three_level_grid(spark, sf), THREE_ROWS, in_order=True)
    orders = records.select("c", F.explode_outer("orders").alias("o"))
    return orders.select("c", "o.o", F.explode_outer("o.items").alias("i")).select("c", "o", "i.l")


@query("b2_fold_errors", """
SELECT 'NotMatchFieldType' AS err_type, CAST(o_orderkey AS VARCHAR) AS record_id, 'items.l_partkey' AS field, 'P' || l_partkey AS value
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 97 = 0""")
def b2_fold_errors(spark, sf):
    grid = block_grid(spark, sf)
    part = G.cell(3)
    bad = F.when((part != "") & (part.cast("long") % 97 == 0), F.concat(F.lit("P"), part)).otherwise(part)
    grid = grid.withColumn("cells", F.array(*[G.cell(i) for i in range(3)], bad))
    rows = with_position(grid, [c for c in grid.columns if c != "cells"], "_row").withColumn("_file", F.lit("orders.csv"))
    return blocks.nested_records(rows.select("_file", "_row", "cells"), ORDER_ROWS, in_order=True)[1].select("err_type", "record_id", "field", "value")


LINE_RECORD = C.Struct("Line", star.fields("l_linenumber:int l_partkey:long l_suppkey:long l_extendedprice:float"))
ORDER_RECORD = C.Struct("Order", (*star.fields("o_orderkey:long o_orderstatus:str"), C.Field("items", C.ListOf(LINE_RECORD), "block"),
                                  C.Field("flags", C.ListOf("str"), "block", 2)))
CUSTOMER_RECORD = C.TableContract("customer", ("c_custkey",), (*star.fields("c_custkey:long c_name:str"), C.Field(
    "orders", C.ListOf(ORDER_RECORD), "block"), C.Field("nations", C.ListOf("int"), "block")))


def nested_customers(spark, sf):
    """Customers with their orders, those with their items and, beside these, the return flags of the items."""
    d = star.dataset(spark, sf)
    items = d.frames["lineitem"].select("l_orderkey", "l_returnflag", *_ITEM, F.struct(*_ITEM).alias("item"))
    by_order = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"),
                                               F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    orders = d.frames["orders"].join(by_order, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    empty = lambda c: F.coalesce(c, F.array().cast(orders.schema[c].dataType)).alias(c)
    order = F.struct("o_orderkey", "o_orderstatus", empty("items"), empty("flags"))
    by_customer = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("orders"))
    out = d.frames["customer"].join(by_customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", "c_name", F.coalesce("orders", F.array().cast(out.schema["orders"].dataType)).alias("orders"),
                      F.array("c_nationkey", F.col("c_nationkey") + 1, F.col("c_nationkey") + 2).alias("nations"))


@query("s14_round_trip", """
SELECT c_custkey, c_name, o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  coalesce((SELECT string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) FROM lineitem x WHERE x.l_orderkey = o_orderkey),
    CASE WHEN o_orderkey IS NOT NULL THEN '' END) AS flags, 3 * c_nationkey + 3 AS nations
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def s14_round_trip(spark, sf):
    # Written: where ranges begin is looked up on rows that are there, not laid out a second time for it.
    grid = cut(blocks.records_to_grid(nested_customers(spark, sf), CUSTOMER_RECORD), "grid")
    rows = with_position(grid, ["c_custkey", "_line"], "_row").withColumn("_file", F.lit("customer.csv"))
    records, _ = blocks.nested_records(rows.select("_file", "_row", "cells"), CUSTOMER_RECORD, in_order=True)
    total = F.aggregate("nations", F.lit(0), lambda n, x: n + x)
    orders = records.select("c_custkey", "c_name", total.alias("nations"), F.explode_outer("orders").alias("o"))
    lines = orders.select("c_custkey", "c_name", "nations", "o.o_orderkey", "o.o_orderstatus", F.array_join("o.flags", "").alias("flags"),
                          F.explode_outer("o.items").alias("i"))
    return lines.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", "i.l_linenumber", "i.l_partkey", "i.l_suppkey",
                        "i.l_extendedprice", "flags", "nations")


@query("s15_ingest_profile", """
SELECT 'part' AS "table", count(*) AS rows, count(*) FILTER (p_partkey % 97 = 0) AS comment_rows, count(*) FILTER (p_partkey % 89 = 0) AS blank_rows,
  3 * count(*) AS number_cells, 3 * count(*) AS text_cells, 0 AS empty_cells, false AS is_empty FROM part""")
def s15_ingest_profile(spark, sf):
    return G.ingest_profile(part_grid(spark, sf)).drop("files", "columns", "ignored_columns")


@query("p12_header_drift", """
SELECT col AS "column", status, kind AS suggested_type, bad AS bad_values FROM (VALUES ('p_partkey', 'matched', 'long', 0), ('p_name', 'matched', 'str', 0),
  ('p_name', 'duplicate', 'str', 0), ('p_kind', 'extra', 'str', 0), ('p_retailprice', 'matched', 'float', 0), ('p_type', 'missing', NULL, 0), ('p_brand', 'missing', NULL, 0)) t(col, status, kind, bad)
UNION ALL SELECT 'p_size', 'matched', 'int', 0""")
def p12_header_drift(spark, sf):
    names = ["p_partkey", "p_name", "p_name", "p_kind", "p_size", "p_retailprice"]
    drift = G.header_drift(part_grid(spark, sf, 4, names), {"part": star.PART}, 4)
    return drift.groupBy("column", "status", "suggested_type").agg(F.max("bad_values").alias("bad_values"))


# ------------------------------------------------------------------ typing

def dirty_part(spark, sf):
    """Part as text; bad numbers and hex sizes are planted."""
    df = star.read(spark, sf, "part")
    rows = df.select(*fixtures.text_of(df))
    key = F.col("p_partkey").cast("long")
    size = (F.when(key % 97 == 0, F.concat("p_size", F.lit("abc"))).when(key % 89 == 0, "")
            .when(key % 5 == 0, F.concat(F.lit("0x"), F.hex(F.col("p_size").cast("int")))).otherwise(F.col("p_size")))
    return rows.withColumn("p_size", size).withColumn("p_retailprice", F.when(key % 83 == 0, "1.2.3").otherwise(F.col("p_retailprice")))


@query("p1_cast_typed", """
SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 OR p_partkey % 89 = 0 THEN NULL ELSE p_size END AS p_size,
  CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice, p_name FROM part""")
def p1_cast_typed(spark, sf):
    return typed.cast_typed(dirty_part(spark, sf), star.PART)[0].select("p_partkey", "p_size", "p_retailprice", "p_name")


@query("p1_cast_errors", """
SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'p_size' AS field, p_size || 'abc' AS value FROM part WHERE p_partkey % 97 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_retailprice', '1.2.3' FROM part WHERE p_partkey % 83 = 0""")
def p1_cast_errors(spark, sf):
    return typed.cast_typed(dirty_part(spark, sf), star.PART)[1].select("record_id", "field", "value")


@query("p1_cast_spaces", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def p1_cast_spaces(spark, sf):
    df = star.read(spark, sf, "part")
    around = F.array(*map(F.lit, ("\u00a0", "\u3000", "\ufeff", "\t \u2003", "")))[(F.col("p_partkey") % 5).cast("int")]
    rows = df.select(*[F.concat(around, c, around).alias(c.strip("`")) for c in df.select(*fixtures.text_of(df)).columns])
    return typed.cast_typed(rows, star.PART)[0].select("p_partkey", "p_name", "p_size", "p_retailprice")


PLACE = C.TableContract("supplier", ("s_suppkey",), (
    C.Field("s_suppkey", "long"), C.Field("about", C.Struct("About", star.fields("name:str nation:int"))), C.Field("s_acctbal", "float")))


@query("p2_assemble_struct", """
SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_nationkey END AS nation, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 13 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier""")
def p2_assemble_struct(spark, sf):
    out = typed.assemble_struct(supplier_cells(spark, sf), PLACE)[0]
    return out.select("s_suppkey", "about.name", "about.nation", "s_acctbal").withColumnRenamed("name", "s_name")


def supplier_cells(spark, sf):
    df = star.read(spark, sf, "supplier")
    cells = F.array(*fixtures.text_of(df))
    key = F.col("s_suppkey")
    shaped = (F.when(key % 13 == 0, F.slice(cells, 1, 2)).when(key % 7 == 0, F.slice(cells, 1, 3))
              .when(key % 5 == 0, F.concat(cells, F.array(F.lit("spare")))).otherwise(cells))
    return df.select(shaped.alias("cells"))


@query("p2_span_errors", """
SELECT CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 7 = 0 THEN 'FieldCellSpanNotEnough' ELSE 'FieldCellNotUsed' END AS err_type, CAST(s_suppkey AS VARCHAR) AS record_id
FROM supplier WHERE s_suppkey % 13 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 5 = 0""")
def p2_span_errors(spark, sf):
    return typed.assemble_struct(supplier_cells(spark, sf), PLACE)[1].select("err_type", "record_id")


@query("p3_assemble_fixed", """
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN p_size END, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 END, p_size + 2) AS sizes,
  CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n_entries FROM part""")
def p3_assemble_fixed(spark, sf):
    key = F.col("p_partkey")
    df = star.read(spark, sf, "part").select(
        "p_partkey", F.when(key % 2 == 0, F.col("p_size")).alias("x1"), F.when(key % 3 == 0, F.col("p_size") + 1).alias("x2"), (F.col("p_size") + 2).alias("x3"),
        F.when(key % 2 == 0, F.lit("a")).alias("k1"), F.when(key % 2 == 0, F.col("p_size")).alias("v1"), F.lit("b").alias("k2"), F.lit(1).alias("v2"))
    df = typed.assemble_fixed(df, [["x1"], ["x2"], ["x3"]], C.ListOf("int"), "xs")
    df = typed.assemble_fixed(df, [["k1", "v1"], ["k2", "v2"]], C.MapOf("str", "int"), "m")
    return df.select("p_partkey", F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("sizes"), F.size("m").alias("n_entries"))


@query("p4_split_sep", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '|') ELSE p_name || ' "x"|' || replace(p_type, ' ', '|') END AS parts,
  CASE WHEN p_partkey % 3 = 0 THEN len(string_split(p_name, ' ')) ELSE 1 + len(string_split(p_type, ' ')) END AS n FROM part""")
def p4_split_sep(spark, sf):
    quoted = F.concat(F.lit('"'), "p_name", F.lit(' ""x"" "'))
    quoted = F.regexp_replace(quoted, ' "$', '"')
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.concat(quoted, F.lit(" "), "p_type"))
    parts = S.split_sep("t", " ")
    return star.read(spark, sf, "part").select("p_partkey", text.alias("t")).select(
        "p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n"))


COND = C.Union("cond", (C.Struct("Click", star.fields("k:int")), C.Struct("Both", star.fields("k:int name:str"))), default="Click")
PACKED = C.Struct("Event", (C.Field("user", C.Struct("User", star.fields("id:long kind:str"))), C.Field("cond", COND),
                            C.Field("ks", C.ListOf("int"))))


def packed_events(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.pmod(F.col("event_id"), F.lit(4))
    cond = (F.when(kind == 0, F.concat(F.lit("Click("), k, F.lit(")"))).when(kind == 1, k)
            .when(kind == 2, F.concat(F.lit("Both("), k, F.lit(', "a,(b")'))).otherwise(F.concat(F.lit("Wrong("), k, F.lit(")"))))
    text = F.concat(F.lit("("), F.col("user_id").cast("string"), F.lit(";"), "event_type", F.lit("), "), cond, F.lit(",("), k, F.lit(","), k, F.lit(")"))
    return star.read(spark, sf, "events").select("event_id", parse_packed(text, PACKED).alias("p"))


@query("p5_parse_packed", """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN user_id END AS user_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS kind,
  CASE WHEN event_id % 4 IN (0, 1) THEN 'Click' WHEN event_id % 4 = 2 THEN 'Both' END AS impl,
  CASE WHEN event_id % 4 < 3 THEN CAST(props->>'k' AS INTEGER) END AS k, CASE WHEN event_id % 4 = 2 THEN 'a,(b' END AS name, event_id % 4 = 3 AS broken FROM events""")
def p5_parse_packed(spark, sf):
    return packed_events(spark, sf).select(
        "event_id", F.col("p.value.user.id").alias("user_id"), F.col("p.value.user.kind").alias("kind"), F.col("p.value.cond.type").alias("impl"),
        F.get("p.value.ks", F.lit(1)).alias("k"), F.col("p.value.cond.Both.name").alias("name"), F.col("p.error").isNotNull().alias("broken"))


@query("p5_parse_flat", """
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS a, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS b, p_partkey % 7 = 0 AS broken FROM part""")
def p5_parse_flat(spark, sf):
    flat = C.Struct("Pair", star.fields("a:int b:float"))
    text = F.concat(F.lit("( "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(";"), S.number_text("p_retailprice"), F.lit(")"))
    return star.read(spark, sf, "part").select("p_partkey", parse_packed(text, flat).alias("p")).select(
        "p_partkey", "p.value.a", "p.value.b", F.col("p.error").isNotNull().alias("broken"))


EVENT = C.Union("event", (C.Struct("click", star.fields("user:long")), C.Struct("view", star.fields("user:long value:float")),
                          C.Struct("purchase", star.fields("user:long value:float k:int")), C.Struct("other", ())), default="other")


def typed_events(spark, sf):
    df = star.read(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "signup", F.col("event_type")).otherwise("").alias("kind"), F.col("user_id").cast("string").alias("u"),
        S.number_text("value").alias("v"), F.get_json_object("props", "$.k").alias("k"))
    return typed.resolve_variant(df, "kind", EVENT, ["u", "v", "k"], "e", F.col("event_id").cast("string"), "events")


@query("p6_resolve_variant", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'other' WHEN 'error' THEN NULL ELSE event_type END AS type,
  CASE WHEN event_type = 'purchase' THEN CAST(props->>'k' AS INTEGER) END AS k, CASE event_type WHEN 'click' THEN user_id END AS click_user FROM events""")
def p6_resolve_variant(spark, sf):
    return typed_events(spark, sf)[0].select("event_id", "e.type", "e.purchase.k", F.col("e.click.user").alias("click_user"))


@query("p6_unknown_impl", "SELECT 'InterfaceCellImplNotFound' AS err_type, CAST(event_id AS VARCHAR) AS record_id, 'error' AS value FROM events WHERE event_type = 'error'")
def p6_unknown_impl(spark, sf):
    return typed_events(spark, sf)[1].select("err_type", "record_id", "value")


@query("p7_fill_defaults", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal, '' AS c_mktsegment FROM customer""")
def p7_fill_defaults(spark, sf):
    key = F.col("c_custkey")
    df = star.read(spark, sf, "customer").select(
        "c_custkey", F.when(key % 7 != 0, F.col("c_name")).alias("c_name"), F.when(key % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(key % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return typed.fill_defaults(df, star.CUSTOMER)


@query("p8_normalise_lower", "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment, c_name FROM customer")
def p8_normalise_lower(spark, sf):
    contract = star.CUSTOMER.with_fields(replace(f, lowercase=f.name == "c_mktsegment") for f in star.CUSTOMER.fields)
    return typed.normalise_lower(star.read(spark, sf, "customer"), contract).select("c_custkey", "c_mktsegment", "c_name")


EVENT_JSON = C.TableContract("events", ("event_id",), (
    C.Field("event_id", "long"), C.Field("user", "int"), C.Field("value", "float"), C.Field("p", C.Struct("Props", star.fields("k:int"))),
    C.Field("m", C.MapOf("int", "str"))), source="json")


def event_documents(spark, sf):
    key = F.col("event_id")
    user = F.when(key % 97 == 0, F.lit('"x"')).when(key % 89 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".9"))).otherwise(F.col("user_id").cast("string"))
    extra = F.when(key % 83 == 0, F.lit(',"zz":1')).otherwise("")
    text = F.concat(F.lit('{"event_id":'), key.cast("string"), F.lit(',"user":'), user, F.lit(',"p":'), "props",
                    F.lit(',"m":[{"key":1,"value":"a"}]'), extra, F.lit("}"))
    return typed.json_to_typed(star.read(spark, sf, "events").select(text.alias("text")), "text", EVENT_JSON)


@query("p10_json_to_typed", """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 0 ELSE user_id END AS user, 0.0::DOUBLE AS value, CAST(props->>'k' AS INTEGER) AS k, 'a' AS m1 FROM events""")
def p10_json_to_typed(spark, sf):
    return event_documents(spark, sf)[0].select("event_id", "user", "value", "p.k", F.col("m")[0]["value"].alias("m1"))


@query("p10_json_errors", """
SELECT 'JsonValueNotMatchType' AS err_type, 'error' AS level, CAST(event_id AS VARCHAR) AS record_id, '"x"' AS value FROM events WHERE event_id % 97 = 0
UNION ALL SELECT 'JsonHasExtraFields', 'warning', CAST(event_id AS VARCHAR), 'zz' FROM events WHERE event_id % 83 = 0""")
def p10_json_errors(spark, sf):
    return event_documents(spark, sf)[1].select("err_type", "level", "record_id", "value")


# --------------------------------------------------------- column functions

@query("f1_parse_hex_int", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey END AS n FROM part")
def f1_parse_hex_int(spark, sf):
    key = F.col("p_partkey")
    text = (F.when(key % 4 == 0, F.concat(F.lit("0x"), F.hex(key))).when(key % 4 == 1, F.concat(F.lit("*#"), F.lower(F.hex(key))))
            .when(key % 4 == 2, key.cast("string")).otherwise(F.concat(key.cast("string"), F.lit("abc"))))
    return star.read(spark, sf, "part").select("p_partkey", S.parse_hex_int(text).alias("n"))


@query("f2_parse_bool", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE NULL END AS b2,
  CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS b4 FROM part""")
def f2_parse_bool(spark, sf):
    key = F.col("p_partkey") % 4
    text = F.when(key == 0, "TRUE").when(key == 1, "0").when(key == 2, "").otherwise(F.col("p_name"))
    return star.read(spark, sf, "part").select("p_partkey", S.parse_bool(text, 2).alias("b2"), S.parse_bool(text, 4).alias("b4"))


_CAMEL = "'heroR' || replace(p_type, ' ', '') || 'HTTPServer2024C' || p_size || 'xX'"
_SNAKE = f"""lower(regexp_replace(regexp_replace(regexp_replace({_CAMEL}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g'))"""
_SCREAM = f"""upper(regexp_replace(regexp_replace({_CAMEL}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'))"""


@query("f3_camel_to_snake", f"SELECT p_partkey, {_SNAKE} AS name FROM part")
def f3_camel_to_snake(spark, sf):
    return star.read(spark, sf, "part").select("p_partkey", S.camel_to_snake(_camel()).alias("name"))


def _camel():
    return F.concat(F.lit("heroR"), F.replace("p_type", F.lit(" "), F.lit("")), F.lit("HTTPServer2024C"), F.col("p_size").cast("string"), F.lit("xX"))


@query("f4_naming_styles", f"""
SELECT p_partkey, {_SCREAM} AS screaming, upper(p_name[1]) || p_name[2:] AS up, lower(p_type[1]) || p_type[2:] AS low,
  string_split(p_name, ' ')[1][1].upper() || string_split(p_name, ' ')[1][2:] || string_split(p_name, ' ')[2][1].upper() || string_split(p_name, ' ')[2][2:] AS pascal FROM part""")
def f4_naming_styles(spark, sf):
    return star.read(spark, sf, "part").select(
        "p_partkey", S.screaming_snake(F.concat(F.lit("_"), _camel(), F.lit("__"))).alias("screaming"), S.upper1("p_name").alias("up"),
        S.lower1("p_type").alias("low"), S.pascal(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("pascal"))


@query("f5_normalise_newlines", """
SELECT doc_id, replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)) AS text FROM documents""")
def f5_normalise_newlines(spark, sf):
    df = star.read(spark, sf, "documents")
    return df.select("doc_id", S.normalise_newlines(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("text"))


@query("f6_escapes", """
SELECT doc_id, replace(replace(text, '\\', '\\\\'), '''', '''''') AS sql_text,
  CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv_text FROM documents""")
def f6_escapes(spark, sf):
    return star.read(spark, sf, "documents").select("doc_id", S.sql_escape("text").alias("sql_text"), S.csv_escape("text").alias("csv_text"))


@query("f7_shorten", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS brief FROM documents")
def f7_shorten(spark, sf):
    return star.read(spark, sf, "documents").select("doc_id", S.shorten("text", 50).alias("brief"))


@query("f8_is_default", "SELECT doc_id, quality = 0 AS q, toxic = 0 AS t FROM labels")
def f8_is_default(spark, sf):
    df = star.read(spark, sf, "labels")
    return df.select("doc_id", *[S.is_default(c, df.schema[c].dataType).alias(a) for c, a in (("quality", "q"), ("toxic", "t"))])


# ----------------------------------------------------------------- changes

def customer_changes(spark, sf):
    """New versions of every third customer, some of them broken, and as many new ones."""
    df = star.read(spark, sf, "customer").where("c_custkey % 3 = 0")
    text = lambda key, balance: F.to_json(F.struct(key.alias("c_custkey"), "c_name", "c_nationkey", balance.alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment")))
    wrong = F.when(F.col("c_custkey") % 97 == 0, F.lit('"much"')).otherwise(F.lit("1.5"))
    old = df.select((F.col("c_custkey") * 2).alias("seq"), F.concat(F.lit('{"c_custkey":'), F.col("c_custkey").cast("string"), F.lit(',"c_name":"n","c_nationkey":1,"c_acctbal":'), wrong, F.lit(',"c_mktsegment":"NEW"}')).alias("text"))
    new = df.select((F.col("c_custkey") * 2 + 1).alias("seq"), text(F.col("c_custkey") + 10000000, F.lit(2.5)).alias("text"))
    return old.unionByName(new)


@query("w1_upsert", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 97 <> 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 97 <> 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 10000000, 2.5, 'NEW' FROM customer WHERE c_custkey % 3 = 0""")
def w1_upsert(spark, sf):
    new, _, _ = changes.upsert(star.read(spark, sf, "customer"), customer_changes(spark, sf), star.CUSTOMER)
    return new.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("w1_upsert_results", """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 97 = 0 THEN 'recordParseError' ELSE 'updateOK' END AS code FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT CAST(c_custkey + 10000000 AS VARCHAR), 'addOK' FROM customer WHERE c_custkey % 3 = 0""")
def w1_upsert_results(spark, sf):
    return changes.upsert(star.read(spark, sf, "customer"), customer_changes(spark, sf), star.CUSTOMER)[1]


def mixed_changes(spark, sf):
    """Text that is no record, a good record 0, and for every third customer a change that fails before or after a good one."""
    df = star.read(spark, sf, "customer").where("c_custkey % 3 = 0 or c_custkey = 1")
    key, nth = F.col("c_custkey"), F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = df.select(key, nth.alias("n"))
    # 0 is good, 1 is not; the third comes last and is good for even keys.
    balance = F.when(F.col("n") == 0, "1.5").when(F.col("n") == 1, '"much"').when(key % 2 == 0, "2.5").otherwise("[]")
    text = F.concat(F.lit('{"c_custkey":'), key.cast("string"), F.lit(',"c_name":"n","c_nationkey":1,"c_acctbal":'), balance,
                    F.lit(',"c_mktsegment":"NEW"}'))
    zero = '{"c_custkey":0,"c_name":"zero","c_nationkey":1,"c_acctbal":9.5,"c_mktsegment":"NEW"}'
    special = F.when(F.col("n") == 0, zero).otherwise('{"c_custkey":')
    return rows.select((key * 3 + F.col("n")).alias("seq"), F.when(key == 1, special).otherwise(text).alias("text"))


@query("w1_upsert_mixed", """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 2.5 WHEN c_custkey % 3 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey <> 0
UNION ALL SELECT 0, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1) THEN 9.5 ELSE 2.5 END, 'NEW'""")
def w1_upsert_mixed(spark, sf):
    new = changes.upsert(star.read(spark, sf, "customer"), mixed_changes(spark, sf), star.CUSTOMER)[0]
    return new.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("w1_upsert_mixed_results", """
SELECT CAST(c_custkey AS VARCHAR) AS id, code FROM customer, (VALUES ('updateOK'), ('recordParseError')) t(code) WHERE c_custkey % 3 = 0""")
def w1_upsert_mixed_results(spark, sf):
    return changes.upsert(star.read(spark, sf, "customer"), mixed_changes(spark, sf), star.CUSTOMER)[1]


def indexed_star(spark, sf):
    """The star without every seventh customer, and its reference index."""
    d = refs.deduplicated(star.dataset(spark, sf))
    d = d.swap("customer", d.frames["customer"].where("c_custkey % 7 <> 0"))
    return d, ReferenceIndex(spark, scratch_path(spark, "index"), d.contracts, buckets=16).build(d)


@query("w1_incremental", """
SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS record_id, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value FROM orders
WHERE o_custkey % 7 = 0 AND o_custkey % 14 <> 0
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_nationkey', '99' FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0""")
def w1_incremental(spark, sf):
    d, index = indexed_star(spark, sf)
    df = star.read(spark, sf, "customer").where("c_custkey % 14 = 0 or (c_custkey % 11 = 0 and c_custkey % 7 <> 0)")
    nation = F.when((F.col("c_custkey") % 11 == 0) & (F.col("c_custkey") % 14 != 0), 99).otherwise(F.col("c_nationkey"))
    edits = df.select(F.col("c_custkey").alias("seq"), F.to_json(F.struct(
        "c_custkey", "c_name", nation.alias("c_nationkey"), "c_acctbal", "c_mktsegment")).alias("text"))
    return changes.upsert_indexed(d, index, "customer", edits, 1)[2].select("table", "record_id", "field", "value")


@query("w2_incremental", f"""
WITH line AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey % 7 = 0 AND o_orderkey % 5 <> 0
UNION ALL SELECT 'lineitem', l_orderkey || ';' || l_linenumber, CAST(l_orderkey AS VARCHAR) FROM line WHERE l_orderkey % 5 = 0""")
def w2_incremental(spark, sf):
    d, index = indexed_star(spark, sf)
    ids = d.frames["orders"].where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    return changes.delete_indexed(d, index, "orders", ids, 1)[2].select("table", "record_id", "value")


@query("w3_incremental", """
WITH line AS (SELECT l_orderkey, l_linenumber, max((l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS r
  FROM lineitem GROUP BY ALL)
SELECT 'lineitem' AS "table", l_orderkey || ';' || l_linenumber AS record_id, CAST(r[2] AS VARCHAR) AS value FROM line WHERE r[2] % 11 = 0
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey % 7 = 0""")
def w3_incremental(spark, sf):
    d, index = indexed_star(spark, sf)
    fresh = d.frames["supplier"].where("s_suppkey % 11 <> 0")
    return changes.reload_indexed(d, index, "supplier", fresh, 1)[1].select("table", "record_id", "value")


@query("w1_support", """
SELECT 'nation(n_nationkey)' AS target, CAST(k AS VARCHAR) AS key, count(*) AS referrers, true AS there FROM (
  SELECT c_nationkey AS k FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k
UNION ALL SELECT 'customer(c_custkey)', CAST(o_custkey AS VARCHAR), count(*), o_custkey % 7 <> 0 FROM orders GROUP BY o_custkey""")
def w1_support(spark, sf):
    return indexed_star(spark, sf)[1].support().where("target in ('nation(n_nationkey)', 'customer(c_custkey)')")


@query("w2_delete", """
SELECT 'orders' AS "table", count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'deleteOK', count(*) FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'recordIdNotFound', count(*) FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'ForeignValueNotFound', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 = 0)""")
def w2_delete(spark, sf):
    d = star.dataset(spark, sf)
    gone = d.frames["orders"].where("o_orderkey % 5 = 0")
    ids = gone.select(F.col("o_orderkey").cast("string").alias("id")).unionByName(
        gone.select((F.col("o_orderkey") + 100000000).cast("string").alias("id")))
    new, results, errors = changes.apply_delete(d, "orders", ids)
    return (new.frames["orders"].agg(F.count("*").alias("n")).select(F.lit("orders").alias("table"), "n")
            .unionByName(results.groupBy(F.col("code").alias("table")).agg(F.count("*").alias("n")))
            .unionByName(errors.groupBy(F.col("err_type").alias("table")).agg(F.count("*").alias("n"))))


@query("w3_reload_table", """
SELECT 'lineitem' AS "table", l_orderkey || ';' || l_linenumber AS record_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS rn FROM lineitem)
WHERE rn = 1 AND l_suppkey % 11 = 0""")
def w3_reload_table(spark, sf):
    d = star.dataset(spark, sf)
    fresh = d.frames["supplier"].where("s_suppkey % 11 <> 0")
    return changes.reload_table(d, "supplier", fresh)[1].select("table", "record_id")


@query("w1_set_notes", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS note FROM customer WHERE c_custkey % 5 <> 0")
def w1_set_notes(spark, sf):
    df = star.read(spark, sf, "customer")
    notes = df.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("note"))
    key = F.col("c_custkey")
    edit = df.where((key % 3 == 0) | (key % 5 == 0)).select(key.cast("string").alias("id"), F.when(key % 5 == 0, "").otherwise("new").alias("note"), key.alias("seq"))
    return changes.set_notes(notes, edit)


#: Records that share a file of the streams.
PACK = 1000


def stream_suppliers(spark, sf, on_batch=None):
    """Two waves of record files run through the stream."""
    path, out, state = (scratch_path(spark, n) for n in ("incoming", "table", "state"))
    d = star.dataset(spark, sf, ("region", "nation"))
    tables = {"supplier": star.SUPPLIER}
    df = star.read(spark, sf, "supplier")
    key = F.col("s_suppkey")
    for wave in (1, 2):
        rows = df if wave == 1 else df.where("s_suppkey % 2 = 0")
        nation = F.when(key % 31 == 0, F.lit(99)).otherwise(F.col("s_nationkey"))
        text = F.to_json(F.struct("s_suppkey", "s_name", nation.alias("s_nationkey"), (F.col("s_acctbal") + wave).alias("s_acctbal")))
        docs = rows.select(F.concat(F.lit(f"w{wave}_"), key.cast("string")).alias("id"), text.alias("text"))
        fixtures.write_documents(docs, "supplier", path, mode="append", pack=PACK)
        stream.stream_validate(spark, path, out, d, tables, state, on_batch).awaitTermination()
    return out


@query("w4_stream_validate", """
SELECT s_suppkey, s_name, round(s_acctbal + CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END, 2) AS s_acctbal FROM supplier""")
def w4_stream_validate(spark, sf):
    out = stream_suppliers(spark, sf)
    return stream.latest(spark, out, star.SUPPLIER).select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("w4_stream_errors", """
SELECT 'ForeignValueNotFound' AS err_type, CAST(s_suppkey AS VARCHAR) AS record_id FROM supplier WHERE s_suppkey % 31 = 0
UNION ALL SELECT 'ForeignValueNotFound', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 62 = 0""")
def w4_stream_errors(spark, sf):
    return stream.errors_of(spark, stream_suppliers(spark, sf)).select("err_type", "record_id")


def late_nations(spark, sf):
    """Suppliers before the nations they name: every third nation comes two batches late, nation 99 never."""
    path, out, state = (scratch_path(spark, n) for n in ("incoming", "table", "state"))
    d = star.dataset(spark, sf, ("region",))
    tables = {"supplier": star.SUPPLIER, "nation": star.NATION}
    suppliers, nations, key = star.read(spark, sf, "supplier"), star.read(spark, sf, "nation"), F.col("s_suppkey")
    for wave in (1, 2, 3):
        nation = F.when((key % 31 == 0) & ((F.lit(wave) == 1) | (key % 2 == 0)), F.lit(99)).otherwise(F.col("s_nationkey"))
        text = F.to_json(F.struct("s_suppkey", "s_name", nation.alias("s_nationkey"), "s_acctbal"))
        rows = {1: suppliers, 2: suppliers.where("s_suppkey % 5 = 0 or s_suppkey % 31 = 0"), 3: suppliers.limit(0)}[wave]
        fixtures.write_documents(rows.select(F.concat(F.lit(f"w{wave}_"), key.cast("string")).alias("id"), text.alias("text")),
                                 "supplier", path, mode="append", pack=PACK)
        rows = nations.where({1: "n_nationkey % 3 <> 0", 2: "false", 3: "n_nationkey % 3 = 0"}[wave])
        fixtures.write_documents(rows.select(F.concat(F.lit(f"w{wave}_"), F.col("n_nationkey").cast("string")).alias("id"),
                                             F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("text")),
                                 "nation", path, mode="append", pack=PACK)
        stream.stream_validate(spark, path, out, d, tables, state, buckets=8).awaitTermination()
    return out, d, tables


@query("w4_open_errors", """
SELECT 'ForeignValueNotFound' AS err_type, 'supplier' AS "table", CAST(s_suppkey AS VARCHAR) AS record_id, '99' AS value FROM supplier
WHERE s_suppkey % 62 = 0""")
def w4_open_errors(spark, sf):
    out, d, tables = late_nations(spark, sf)
    return stream.open_reference_errors(spark, out, d, tables, buckets=8).select("err_type", "table", "record_id", "value")


@query("w4_late_targets", """
SELECT CAST(s_suppkey AS VARCHAR) AS record_id, batch AS _batch FROM supplier, (VALUES (0), (1)) t(batch)
WHERE (batch = 0 AND (s_suppkey % 31 = 0 OR s_nationkey % 3 = 0))
  OR (batch = 1 AND (s_suppkey % 62 = 0 OR (s_suppkey % 5 = 0 OR s_suppkey % 31 = 0) AND s_nationkey % 3 = 0))""")
def w4_late_targets(spark, sf):
    return stream.errors_of(spark, late_nations(spark, sf)[0]).select("record_id", "_batch")


@query("x3_on_batch", """
SELECT count(*) AS suppliers, 2 AS batches FROM supplier""")
def x3_on_batch(spark, sf):
    seen = scratch_path(spark, "seen")

    def note(dataset, batch_id):
        dataset.frames["supplier"].agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{seen}/b={batch_id}")

    stream_suppliers(spark, sf, note)
    return spark.read.parquet(seen).agg(F.max("n").alias("suppliers"), F.count_distinct("batch").alias("batches"))
