"""Constraint and statistics queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import contract as C
from ..operators import checks, refs, stats, typed
from ..operators.blocks import nest
from . import star
from .registry import query

LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("c1_check_unique", f"""
SELECT 'PrimaryOrUniqueKeyDuplicated' AS err_type, l_orderkey || ';' || l_linenumber AS record_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn FROM lineitem)
WHERE rn > 1""")
def c1_check_unique(spark, sf):
    return checks.check_unique(star.read(spark, sf, "lineitem"), star.LINEITEM).select("err_type", "record_id")


_DESC = ", ".join(f"{c.strip()} DESC" for c in LINE_ORDER.split(","))


@query("c1_dedup_last", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DESC}) AS rn FROM lineitem)
WHERE rn = 1""")
def c1_dedup_last(spark, sf):
    out = checks.dedup_last(star.read(spark, sf, "lineitem"), star.LINEITEM.key)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("c1_unique_key", """
WITH kept AS (SELECT p_partkey, p_brand, p_size FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_brand || ';' || p_size AS value
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS rn FROM kept) WHERE rn > 1""")
def c1_unique_key(spark, sf):
    contract = replace(star.PART, uniques=(("p_brand", "p_size"),), order=("p_partkey",))
    return checks.check_unique(star.read(spark, sf, "part"), contract, contract.uniques[0]).select("record_id", "value")


@query("c2_check_entry", """
WITH named AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN '' WHEN p_partkey % 89 = 0 THEN 'a ' || p_brand
  WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS name FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY upper(name) ORDER BY p_partkey) AS rn FROM named
  WHERE name <> '' AND NOT contains(name, ' '))
SELECT 'EntryContainsSpace' AS err_type, CAST(p_partkey AS VARCHAR) AS record_id, name AS value FROM named WHERE contains(name, ' ')
UNION ALL SELECT 'EnumEmpty', CAST(p_partkey AS VARCHAR), name FROM named WHERE name = ''
UNION ALL SELECT 'EntryDuplicated', CAST(p_partkey AS VARCHAR), name FROM ranked WHERE rn > 1""")
def c2_check_entry(spark, sf):
    key = F.col("p_partkey")
    name = (F.when(key % 97 == 0, "").when(key % 89 == 0, F.concat(F.lit("a "), "p_brand"))
            .when(key % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")))
    df = star.read(spark, sf, "part").withColumn("p_brand", name)
    contract = replace(star.PART, entry="p_brand", is_enum=True, order=("p_partkey",))
    return checks.check_entry(df, contract).select("err_type", "record_id", "value")


@query("c3_check_seq", """
WITH s AS (SELECT o_orderkey, CAST(o_orderkey + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) AS seqno FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(seqno AS VARCHAR) AS value
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM s) WHERE seqno <> pos""")
def c3_check_seq(spark, sf):
    df = star.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") + F.when(
        F.col("o_orderkey") % 97 == 0, 1).otherwise(0)).cast("int").alias("seqno"))
    contract = C.TableContract("orders", ("o_orderkey",), star.fields("o_orderkey:long seqno:int"))
    return checks.check_seq(df, contract, "seqno").select("record_id", "value")


def _order_maps(spark, sf):
    items = star.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    entry = F.struct(F.col("l_linenumber").alias("key"), F.col("l_quantity").alias("value"))
    return nest(items, ["l_orderkey"], entry, ["l_linenumber", "l_quantity", "l_partkey", "l_suppkey"], "quantities")


MAP_CONTRACT = C.TableContract("orders", ("l_orderkey",), (
    C.Field("l_orderkey", "long"), C.Field("quantities", C.MapOf("int", "float"))))


@query("c4_check_map_keys", """
SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(l_linenumber AS VARCHAR) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity) AS rn FROM lineitem) WHERE rn > 1""")
def c4_check_map_keys(spark, sf):
    return checks.check_map_keys(_order_maps(spark, sf), MAP_CONTRACT, "quantities").select("record_id", "value")


@query("c4_last_entry_wins", """
SELECT l_orderkey, l_linenumber, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL""")
def c4_last_entry_wins(spark, sf):
    maps = _order_maps(spark, sf).select("l_orderkey", checks.entries_to_map(F.col("quantities")).alias("m"))
    return maps.select("l_orderkey", F.explode("m").alias("l_linenumber", "quantity"))


PRIORITIES = (("1-URGENT", 1, "now"), ("2-HIGH", 2, ""), ("3-MEDIUM", 3, ""), ("5-LOW", 5, ""))


@query("c5_encode_enum", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
  WHEN '5-LOW' THEN 5 END AS code FROM orders""")
def c5_encode_enum(spark, sf):
    enum = stats.declared_enum(spark, PRIORITIES)
    encoded, _ = stats.encode_enum(star.read(spark, sf, "orders"), "o_orderpriority", enum, star.ORDERS, "code")
    return encoded.select("o_orderkey", "code")


@query("c5_unknown_names", """
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderpriority AS value FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""")
def c5_unknown_names(spark, sf):
    enum = stats.declared_enum(spark, PRIORITIES)
    return stats.encode_enum(star.read(spark, sf, "orders"), "o_orderpriority", enum, star.ORDERS)[1].select("record_id", "value")


def dirty_star(spark, sf) -> C.Dataset:
    """The star with planted dangling keys and empty cells."""
    d = star.dataset(spark, sf)
    plant = {
        "customer": ("c_nationkey", F.when(F.col("c_custkey") % 97 == 0, 99).when(F.col("c_custkey") % 89 == 0, None)),
        "orders": ("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, F.lit(-1)).when(F.col("o_orderkey") % 89 == 0, 0)),
        "lineitem": ("l_suppkey", F.when(F.col("l_partkey") % 97 == 0, F.col("l_suppkey") + 1000000)),
    }
    for table, (name, value) in plant.items():
        bad = {"customer": F.col("c_custkey"), "orders": F.col("o_orderkey"), "lineitem": F.col("l_partkey")}[table]
        planted = (bad % 97 == 0) if table == "lineitem" else (bad % 97 == 0) | (bad % 89 == 0)
        d = d.swap(table, d.frames[table].withColumn(name, F.when(planted, value).otherwise(F.col(name))
                                                     .cast(d.frames[table].schema[name].dataType)))
    return d


_DIRTY = f"""
WITH cust AS (SELECT *, CASE WHEN c_custkey % 97 = 0 THEN 99 WHEN c_custkey % 89 = 0 THEN NULL ELSE c_nationkey END AS nk FROM customer),
ord AS (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN -1 WHEN o_orderkey % 89 = 0 THEN 0 ELSE o_custkey END AS ck FROM orders),
line0 AS (SELECT * EXCLUDE (l_suppkey), CASE WHEN l_partkey % 97 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS l_suppkey FROM lineitem),
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DESC}) AS back FROM line0),
errs AS (
SELECT 'PrimaryOrUniqueKeyDuplicated' AS err_type, 'lineitem' AS "table", l_orderkey || ';' || l_linenumber AS record_id,
  'l_orderkey,l_linenumber' AS field FROM line WHERE rn > 1
UNION ALL SELECT 'ForeignValueNotFound', 'lineitem', l_orderkey || ';' || l_linenumber, 'l_suppkey' FROM line
  WHERE back = 1 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'ForeignValueNotFound', 'customer', CAST(c_custkey AS VARCHAR), 'c_nationkey' FROM cust
  WHERE nk IS NOT NULL AND nk NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'RefNotNullableButCellEmpty', 'customer', CAST(c_custkey AS VARCHAR), 'c_nationkey' FROM cust WHERE nk IS NULL
UNION ALL SELECT 'ForeignValueNotFound', 'orders', CAST(o_orderkey AS VARCHAR), 'o_custkey' FROM ord
  WHERE ck NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'EntryContainsSpace', 'region', CAST(r_regionkey AS VARCHAR), 'r_name' FROM region WHERE contains(r_name, ' ')
)"""


@query("c6_validate", _DIRTY + " SELECT * FROM errs")
def c6_validate(spark, sf):
    return checks.validate(dirty_star(spark, sf)).select("err_type", "table", "record_id", "field")


@query("c7_errors_by_table", _DIRTY + """
SELECT "table", err_type, count(*) AS n, count(DISTINCT record_id) AS records FROM errs GROUP BY ALL""")
def c7_errors_by_table(spark, sf):
    return checks.errors_by_table(checks.validate(dirty_star(spark, sf))).select("table", "err_type", "n", "records")


@query("c8_entry_records", """
SELECT "table", count(*) AS n FROM (SELECT 'region' AS "table" FROM region UNION ALL SELECT 'part' FROM part
  WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'orders' FROM orders) GROUP BY ROLLUP ("table")""")
def c8_entry_records(spark, sf):
    part = star.read(spark, sf, "part").withColumn("p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")))
    contracts = {"region": star.REGION, "part": replace(star.PART, entry="p_name"), "orders": replace(star.ORDERS, is_root=True)}
    frames = {"region": star.read(spark, sf, "region"), "part": part, "orders": star.read(spark, sf, "orders")}
    return refs.entry_counts(C.Dataset(contracts, frames))


@query("c9_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in star.ALL))
def c9_table_counts(spark, sf):
    return stats.table_counts(star.dataset(spark, sf, tuple(star.ALL)))


@query("c10_next_free_id", """
WITH ids AS (SELECT o_orderkey + o_orderkey // 1000 AS id FROM orders)
SELECT min(id + 1) AS next_id FROM ids WHERE id > 5 AND id + 1 NOT IN (SELECT id FROM ids)""")
def c10_next_free_id(spark, sf):
    ids = star.read(spark, sf, "orders").select((F.col("o_orderkey") + F.floor(F.col("o_orderkey") / 1000)).cast("long").alias("id"))
    return stats.next_free_id(ids, "id", 5)


PROPS = C.Struct("Props", (C.Field("k", "int"),))


@query("c11_shared_values", """
WITH v AS (SELECT CAST(props->>'k' AS INTEGER) AS k FROM events)
SELECT 'Props' AS type, '{"k":' || k || '}' AS value, count(*) + 1 AS n, count(*) AS saved FROM v GROUP BY k
UNION ALL SELECT 'list<Props>', '[{"k":' || k || '}]', count(*), count(*) - 1 FROM v GROUP BY k HAVING count(*) > 1""")
def c11_shared_values(spark, sf):
    df = star.read(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    df = df.withColumn("ps", F.array("p"))
    contract = C.TableContract("events", ("event_id",), (
        C.Field("event_id", "long"), C.Field("p", PROPS), C.Field("ps", C.ListOf(PROPS))))
    return stats.shared_values(df, contract)


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("c12_string_dictionary", f"""
WITH cells AS (SELECT {", ".join(_LINE)}, 0 AS c, l_returnflag AS value FROM lineitem
  UNION ALL SELECT {", ".join(_LINE)}, 1, l_linestatus FROM lineitem),
firsts AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY {", ".join(_LINE)}, c) AS rn FROM cells)
SELECT value, row_number() OVER (ORDER BY {", ".join(_LINE)}, c, value) - 1 AS index FROM firsts WHERE rn = 1""")
def c12_string_dictionary(spark, sf):
    return stats.string_dictionary(star.read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], _LINE)[0]


@query("c12_encoded_rows", f"""
WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY l_shipdate ORDER BY {", ".join(_LINE)}) AS rn FROM lineitem),
words AS (SELECT l_shipdate, row_number() OVER (ORDER BY {", ".join(_LINE)}, l_shipdate) - 1 AS idx FROM firsts WHERE rn = 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, idx AS l_shipdate_idx FROM lineitem JOIN words USING (l_shipdate)""")
def c12_encoded_rows(spark, sf):
    out = stats.string_dictionary(star.read(spark, sf, "lineitem"), ["l_shipdate"], _LINE)[1]
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate_idx")


@query("c13_pack_bools", """
SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice > 200000 THEN 2 ELSE 0 END)
  + (CASE WHEN o_orderpriority = '5-LOW' THEN 4 ELSE 0 END) AS flags FROM orders""")
def c13_pack_bools(spark, sf):
    df = star.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"),
                                               (F.col("o_totalprice") > 200000).alias("big"),
                                               (F.col("o_orderpriority") == "5-LOW").alias("low"))
    return stats.pack_bools(df, ["done", "big", "low"])


# ------------------------------------------------------------ foreign keys

@query("j1_check_fk_clean", """
SELECT 'ForeignValueNotFound' AS err_type, l_orderkey || ';' || l_linenumber AS record_id FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def j1_check_fk_clean(spark, sf):
    d = star.dataset(spark, sf)
    return checks.check_fk(d.frames["lineitem"], star.LINEITEM, star.LINEITEM.fks[0], d.frames["orders"]).select("err_type", "record_id")


@query("j1_check_fk_dangling", """
SELECT 'ForeignValueNotFound' AS err_type, CAST(o_orderkey AS VARCHAR) AS record_id, CAST(k AS VARCHAR) AS value FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000 WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)
WHERE k NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'RefNotNullableButCellEmpty', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0""")
def j1_check_fk_dangling(spark, sf):
    d = star.dataset(spark, sf)
    key = F.col("o_orderkey")
    df = d.frames["orders"].withColumn("o_custkey", F.when(key % 97 == 0, F.col("o_custkey") + 10000000).when(
        key % 89 == 0, None).otherwise(F.col("o_custkey")))
    return checks.check_fk(df, star.ORDERS, star.ORDERS.fks[0], d.frames["customer"]).select("err_type", "record_id", "value")


@query("j1_nullable_rules", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 89 = 0 THEN NULL
  WHEN o_orderkey % 83 = 0 THEN o_custkey + 10000000 ELSE o_custkey + 1 END AS k FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(k AS VARCHAR) AS value FROM o
WHERE k IS NOT NULL AND k <> 0 AND k NOT IN (SELECT c_custkey + 1 FROM customer)""")
def j1_nullable_rules(spark, sf):
    d = star.dataset(spark, sf)
    key = F.col("o_orderkey")
    df = d.frames["orders"].withColumn("o_custkey", F.when(key % 97 == 0, 0).when(key % 89 == 0, None).when(
        key % 83 == 0, F.col("o_custkey") + 10000000).otherwise(F.col("o_custkey") + 1))
    target = d.frames["customer"].withColumn("c_custkey", F.col("c_custkey") + 1)
    fk = replace(star.ORDERS.fks[0], nullable=True)
    return checks.check_fk(df, star.ORDERS, fk, target).select("record_id", "value")


@query("j1_composite_key", """
SELECT l_orderkey || ';' || l_linenumber AS record_id, l_partkey || ';' || l_suppkey AS value FROM lineitem
WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.01)""")
def j1_composite_key(spark, sf):
    df = star.read(spark, sf, "lineitem")
    fk = star.fk("l_partkey,l_suppkey", "offers", "l_partkey,l_suppkey")
    offers = star.read(spark, sf, "lineitem").where("l_discount > 0.01")
    return checks.check_fk(df, star.LINEITEM, fk, offers).select("record_id", "value")


PARTS_OF = C.TableContract("orders", ("l_orderkey",), (
    C.Field("l_orderkey", "long"), C.Field("parts", C.ListOf("long")), C.Field("suppliers", C.MapOf("int", "long"))),
    (star.fk("parts", "part", "p_partkey"), star.fk("suppliers", "supplier", "s_suppkey")))


def order_lists(spark, sf, bad: bool = True):
    """Orders with their part list and a line number -> supplier map."""
    items = star.read(spark, sf, "lineitem")
    if bad:
        items = (items.withColumn("l_partkey", F.when(F.col("l_partkey") % 97 == 0, F.col("l_partkey") + 10000000).otherwise(F.col("l_partkey")))
                 .withColumn("l_suppkey", F.when(F.col("l_suppkey") % 13 == 0, F.col("l_suppkey") + 10000000).otherwise(F.col("l_suppkey"))))
    entry = F.struct("l_partkey", F.col("l_linenumber").alias("key"), F.col("l_suppkey").alias("value"))
    both = nest(items, ["l_orderkey"], entry, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "x")
    return both.select("l_orderkey", F.col("x.l_partkey").alias("parts"),
                       F.transform("x", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("suppliers"))


@query("j2_check_fk_list", """
SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(l_partkey + 10000000 AS VARCHAR) AS value FROM lineitem WHERE l_partkey % 97 = 0""")
def j2_check_fk_list(spark, sf):
    return checks.check_fk(order_lists(spark, sf), PARTS_OF, PARTS_OF.fks[0], star.read(spark, sf, "part")).select("record_id", "value")


@query("j3_check_fk_map", """
SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(s + 10000000 AS VARCHAR) AS value FROM (
  SELECT l_orderkey, l_linenumber, arg_max(l_suppkey, (l_partkey, CASE WHEN l_suppkey % 13 = 0 THEN l_suppkey + 10000000 ELSE l_suppkey END, l_extendedprice)) AS s
  FROM (SELECT * EXCLUDE (l_partkey), CASE WHEN l_partkey % 97 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS l_partkey FROM lineitem)
  GROUP BY ALL) WHERE s % 13 = 0""")
def j3_check_fk_map(spark, sf):
    return checks.check_fk(order_lists(spark, sf), PARTS_OF, PARTS_OF.fks[1], star.read(spark, sf, "supplier")).select("record_id", "value")


ITEM = C.Struct("Item", star.fields("l_linenumber:int l_partkey:long l_suppkey:long"),
                (star.fk("l_partkey", "part", "p_partkey"), star.fk("l_suppkey", "supplier", "s_suppkey")))
NESTED = C.TableContract("orders", ("l_orderkey",), (C.Field("l_orderkey", "long"), C.Field("items", C.ListOf(ITEM))))


def nested_orders(spark, sf, bad: bool = True):
    items = star.read(spark, sf, "lineitem")
    if bad:
        items = items.withColumn("l_partkey", F.when(F.col("l_partkey") % 97 == 0, F.col("l_partkey") + 10000000).otherwise(F.col("l_partkey")))
    return nest(items, ["l_orderkey"], F.struct("l_linenumber", "l_partkey", "l_suppkey"),
                ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "items")


@query("j4_check_fk_nested", """
SELECT CAST(l_orderkey AS VARCHAR) AS record_id, 'items.' || pos || '.l_partkey' AS field, CAST(p AS VARCHAR) AS value FROM (
  SELECT l_orderkey, p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p, l_suppkey, l_extendedprice) - 1 AS pos
  FROM (SELECT *, CASE WHEN l_partkey % 97 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS p FROM lineitem)) WHERE p >= 10000000""")
def j4_check_fk_nested(spark, sf):
    targets = {"part": star.read(spark, sf, "part"), "supplier": star.read(spark, sf, "supplier")}
    return checks.check_fk_nested(nested_orders(spark, sf), NESTED, targets).select("record_id", "field", "value")


@query("p9_check_must_fill", """
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'o_orderstatus' AS field FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_totalprice' FROM orders WHERE o_orderkey % 89 = 0""")
def p9_check_must_fill(spark, sf):
    key = F.col("o_orderkey")
    df = (star.read(spark, sf, "orders").withColumn("o_orderstatus", F.when(key % 97 != 0, F.col("o_orderstatus")))
          .withColumn("o_totalprice", F.when(key % 89 != 0, F.col("o_totalprice"))))
    must = {"o_orderstatus", "o_totalprice"}
    contract = star.ORDERS.with_fields(replace(f, must_fill=f.name in must) for f in star.ORDERS.fields)
    return checks.check_must_fill(df, contract).select("record_id", "field")


@query("x1_register_check", """
SELECT 'PriceTooLow' AS err_type, CAST(o_orderkey AS VARCHAR) AS record_id FROM orders WHERE o_totalprice < 5000
UNION ALL SELECT 'EntryContainsSpace', CAST(r_regionkey AS VARCHAR) FROM region WHERE contains(r_name, ' ')""")
def x1_register_check(spark, sf):
    d = star.dataset(spark, sf, ("region", "nation", "customer", "orders"))

    def price(dataset):
        rows = dataset.frames["orders"].where("o_totalprice < 5000")
        return C.error_rows(rows, "PriceTooLow", "orders", F.col("o_orderkey"), "o_totalprice", F.col("o_totalprice"))

    checks.register_check("price", price)
    try:
        return checks.validate(d).select("err_type", "record_id")
    finally:
        checks.unregister_check("price")
