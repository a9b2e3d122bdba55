"""Reference graph and record queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import contract as C
from ..cluster import with_position
from ..operators import records, refs
from . import star
from .check_queries import ITEM, NESTED, PARTS_OF, nested_orders, order_lists
from .registry import num, query

# The lineitem rows that survive "last row per key wins".
_DESC = ("l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, "
         "l_returnflag DESC, l_linestatus DESC, l_shipdate DESC")
KEPT = f"""line AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DESC}) AS rn
  FROM lineitem) WHERE rn = 1)"""
_EDGE = "SELECT '{t}' AS from_table, CAST({id} AS VARCHAR) AS from_id, '{k}' AS fk, 'ref{K}' AS label, '{to}' AS to_table, CAST({k} AS VARCHAR) AS to_id FROM {src}"


def _edge(table, ident, key, to, src=None):
    return _EDGE.format(t=table, id=ident, k=key, K=key[0].upper() + key[1:], to=to, src=src or table)


_LINE_ID = "l_orderkey || ';' || l_linenumber"
EDGES = f"""WITH {KEPT}, edges AS (
{_edge('nation', 'n_nationkey', 'n_regionkey', 'region')} UNION ALL
{_edge('customer', 'c_custkey', 'c_nationkey', 'nation')} UNION ALL
{_edge('supplier', 's_suppkey', 's_nationkey', 'nation')} UNION ALL
{_edge('orders', 'o_orderkey', 'o_custkey', 'customer')} UNION ALL
{_edge('lineitem', _LINE_ID, 'l_orderkey', 'orders', 'line')} UNION ALL
{_edge('lineitem', _LINE_ID, 'l_partkey', 'part', 'line')} UNION ALL
{_edge('lineitem', _LINE_ID, 'l_suppkey', 'supplier', 'line')})
"""


def clean_star(spark, sf, names=tuple(star.STAR)):
    return refs.deduplicated(star.dataset(spark, sf, names))


@query("j5_resolve_ref", """
SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0""")
def j5_resolve_ref(spark, sf):
    d = star.dataset(spark, sf)
    target = d.frames["customer"].withColumn("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")))
    out = refs.resolve_ref(d.frames["orders"], star.ORDERS, star.ORDERS.fks[0], target, "customer")
    return out.select("o_orderkey", "customer.c_name", "customer.c_mktsegment")


@query("j5_resolve_list", """
SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS names
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def j5_resolve_list(spark, sf):
    out = refs.resolve_ref(order_lists(spark, sf, bad=False), PARTS_OF, PARTS_OF.fks[0], star.read(spark, sf, "part"), "rows")
    return out.select("l_orderkey", F.array_join("rows.p_name", "|").alias("names"))


@query("j5_resolve_map", """
SELECT l_orderkey, l_linenumber, s_name FROM (SELECT l_orderkey, l_linenumber, arg_max(l_suppkey, (l_partkey, l_suppkey, l_extendedprice)) AS s
FROM lineitem GROUP BY ALL) JOIN supplier ON s = s_suppkey""")
def j5_resolve_map(spark, sf):
    out = refs.resolve_ref(order_lists(spark, sf, bad=False), PARTS_OF, PARTS_OF.fks[1], star.read(spark, sf, "supplier"), "rows")
    return out.select("l_orderkey", F.explode("rows").alias("l_linenumber", "s")).select("l_orderkey", "l_linenumber", "s.s_name")


@query("j6_resolve_ref_list", """
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def j6_resolve_ref_list(spark, sf):
    d = star.dataset(spark, sf)
    fk = replace(star.fk("o_orderkey", "lineitem", "l_orderkey", name="items"), to_many=True)
    out = refs.resolve_ref_list(d.frames["orders"], fk, d.frames["lineitem"], "item")
    return out.select("o_orderkey", "item.l_linenumber", "item.l_partkey", "item.l_suppkey")


@query("j6_resolve_nested_list", """
SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS order_keys
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def j6_resolve_nested_list(spark, sf):
    d = star.dataset(spark, sf)
    fk = replace(star.fk("c_custkey", "orders", "o_custkey", name="orders"), to_many=True)
    out = refs.resolve_ref_list(d.frames["customer"], fk, d.frames["orders"], "rows", nested=["o_orderkey"])
    return out.select("c_custkey", F.array_join(F.transform("rows.o_orderkey", lambda k: k.cast("string")), ",").alias("order_keys"))


@query("j7_ref_edges", EDGES + "SELECT * FROM edges")
def j7_ref_edges(spark, sf):
    return refs.ref_edges(clean_star(spark, sf)).select("from_table", "from_id", "fk", "label", "to_table", "to_id")


@query("j7_nested_edges", """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS from_id, 'items.' || pos || '.refL_partkey' AS label, 'part' AS to_table, CAST(l_partkey AS VARCHAR) AS to_id FROM i
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'items.' || pos || '.refL_suppkey', 'supplier', CAST(l_suppkey AS VARCHAR) FROM i""")
def j7_nested_edges(spark, sf):
    d = C.Dataset({"orders": NESTED, "part": star.PART, "supplier": star.SUPPLIER},
                  {"orders": nested_orders(spark, sf, bad=False), "part": star.read(spark, sf, "part"),
                   "supplier": star.read(spark, sf, "supplier")})
    return refs.ref_edges(d).select("from_id", "label", "to_table", "to_id")


@query("j8_refs_in", EDGES + "SELECT from_table, from_id, label FROM edges WHERE to_table = 'nation' AND to_id = '7'")
def j8_refs_in(spark, sf):
    d = star.dataset(spark, sf)
    ids = spark.createDataFrame([("7",)], "id string")
    return refs.refs_in(d, "nation", ids).select("from_table", "from_id", "label")


@query("j8_refs_to_many", """
SELECT CAST(c_custkey AS VARCHAR) AS from_id, CAST(c_nationkey AS VARCHAR) AS to_id FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def j8_refs_to_many(spark, sf):
    many = replace(star.CUSTOMER, fks=(replace(star.CUSTOMER.fks[0], to_many=True),))
    d = C.Dataset({"nation": star.NATION, "customer": many},
                  {n: star.read(spark, sf, n) for n in ("nation", "customer")})
    ids = d.frames["nation"].where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("id"))
    return refs.refs_in(d, "nation", ids).select("from_id", "to_id")


@query("j9_has_reference", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS referenced FROM orders""")
def j9_has_reference(spark, sf):
    return refs.has_reference(star.dataset(spark, sf), "orders")


@query("j10_unreferenced", """
SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def j10_unreferenced(spark, sf):
    d = star.dataset(spark, sf, tuple(star.ALL))
    return refs.unreferenced(d, ["orders", "documents", "customer", "part", "region"])


@query("j11_reachable", f"""WITH {KEPT}
SELECT 'lineitem' AS "table", {_LINE_ID} AS id, 0 AS depth FROM line
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM line)
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 1 FROM part WHERE p_partkey IN (SELECT l_partkey FROM line)
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 1 FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM line)
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 2 FROM customer WHERE c_custkey IN
  (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM line))
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 2 FROM nation WHERE n_nationkey IN
  (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM line))
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 3 FROM nation WHERE n_nationkey NOT IN
  (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM line)) AND n_nationkey IN
  (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM line)))
UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 3 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN
  (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM line)))
UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 4 FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN
  (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM line))) AND r_regionkey IN (SELECT n_regionkey FROM nation)""")
def j11_reachable(spark, sf):
    d = clean_star(spark, sf)
    plain = {n: replace(c, entry=None, is_enum=False, is_root=n == "lineitem") for n, c in d.contracts.items()}
    return refs.reachable_from_entries(C.Dataset(plain, d.frames))


_AROUND = """
WITH c AS (SELECT * FROM customer WHERE c_nationkey = 7), s AS (SELECT * FROM supplier WHERE s_nationkey = 7), around AS (
SELECT 'nation' AS "table", '7' AS id, 'NATION_7' AS title, 0 AS depth
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, -1 FROM c
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, -1 FROM s
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), o_orderpriority, -2 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name || ': ' || r_name, 1 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 7))
"""


@query("j12_neighbourhood", _AROUND + "SELECT * FROM around")
def j12_neighbourhood(spark, sf):
    d = star.dataset(spark, sf, ("region", "nation", "customer", "supplier", "orders"))
    return refs.neighbourhood(d, "nation", "7", 2, 1, 10_000_000)


@query("j12_limited", _AROUND + 'SELECT "table", id, depth FROM around ORDER BY depth > 0, abs(depth), "table", id LIMIT 21')
def j12_limited(spark, sf):
    d = star.dataset(spark, sf, ("region", "nation", "customer", "supplier", "orders"))
    return refs.neighbourhood(d, "nation", "7", 2, 1, 20).select("table", "id", "depth")


@query("j13_record_with_refs", """
WITH o AS (SELECT * FROM orders WHERE o_orderkey = 1), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)),
n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 1)
SELECT 'orders' AS "table", '1' AS id, 0 AS depth, o_orderpriority AS title, 'customer;' || o_custkey AS refs FROM o
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 1, c_name, 'nation;' || c_nationkey FROM c
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 2, n_name || ': ' || n_name, 'region;' || n_regionkey FROM n
UNION ALL SELECT 'lineitem', l_orderkey || ';' || l_linenumber, -1, NULL, 'orders;1' FROM l""")
def j13_record_with_refs(spark, sf):
    line = replace(star.LINEITEM, fks=star.LINEITEM.fks[:1])
    nation = replace(star.NATION, is_enum=True)
    d = star.dataset(spark, sf, ("region", "nation", "customer", "orders", "lineitem"))
    d = refs.deduplicated(C.Dataset({**d.contracts, "lineitem": line, "nation": nation}, d.frames))
    out = refs.record_with_refs(d, "orders", "1", 2, incoming=True)
    text = F.array_join(F.transform("refs", lambda r: F.concat_ws(";", r["to_table"], r["to_id"])), "|")
    return out.select("table", "id", "depth", "title", text.alias("refs"))


@query("j14_table_graph", """
SELECT 'customer' AS from_table, 'nation' AS to_table, count(*) AS n_refs, count(DISTINCT c_nationkey) AS n_targets, 0 AS n_dangling,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) AS max_fan_in FROM customer
UNION ALL SELECT 'nation', 'region', count(*), count(DISTINCT n_regionkey), 0, (SELECT max(n) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)) FROM nation
UNION ALL SELECT 'supplier', 'nation', count(*), count(DISTINCT s_nationkey), 0, (SELECT max(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)) FROM supplier
UNION ALL SELECT 'orders', 'customer', count(*), count(DISTINCT CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END), count(*) FILTER (o_orderkey % 97 = 0),
  (SELECT max(n) FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY o_custkey)) FROM orders
UNION ALL SELECT 'lineitem', 'orders', count(*), count(DISTINCT l_orderkey), 0, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) FROM lineitem
UNION ALL SELECT 'lineitem', 'part', count(*), count(DISTINCT l_partkey), 0, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)) FROM lineitem
UNION ALL SELECT 'lineitem', 'supplier', count(*), count(DISTINCT l_suppkey), 0, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)) FROM lineitem""")
def j14_table_graph(spark, sf):
    d = star.dataset(spark, sf)
    orders = d.frames["orders"].withColumn("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))
    return refs.table_graph(d.swap("orders", orders)).drop("fk")


@query("j15_reconcile_assets", """
WITH a AS (SELECT DISTINCT page_id * 2 AS id FROM pages)
SELECT 'documents' AS "table", CAST(coalesce(a.id, d.doc_id) AS VARCHAR) AS id,
  CASE WHEN d.doc_id IS NULL THEN 'noCfg' WHEN a.id IS NULL THEN 'noRes' ELSE 'ok' END AS status
FROM a FULL OUTER JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d ON a.id = d.doc_id""")
def j15_reconcile_assets(spark, sf):
    name = F.concat(F.lit("documents_"), (F.col("page_id") * 2).cast("string"))
    pages = star.read(spark, sf, "pages").select(name.alias("asset"))
    extra = star.read(spark, sf, "nation").where("n_nationkey < 5").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("asset"))
    assets = pages.unionByName(extra).select(F.regexp_extract("asset", "^([^_]*)_", 1).alias("table"),
                                             F.regexp_extract("asset", "^[^_]*_(.*)$", 1).alias("id"))
    docs = star.read(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.lit("documents").alias("table"), F.col("doc_id").cast("string").alias("id"))
    nations = star.read(spark, sf, "nation").select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("string").alias("id"))
    return refs.reconcile_assets(assets, docs.unionByName(nations))


@query("j16_recent_records", """
SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title FROM orders
ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20""")
def j16_recent_records(spark, sf):
    return refs.recent_records(star.dataset(spark, sf), {"orders": "o_orderdate"}, 20).select("table", "id", "title")


# ---------------------------------------------------------------- records

@query("p11_project_tag", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders""")
def p11_project_tag(spark, sf):
    tag = frozenset({"client"})
    tagged = lambda c, names: replace(c, tags=tag, fields=tuple(
        replace(f, tags=tag if f.name in names else frozenset()) for f in c.fields))
    contracts = {"orders": tagged(star.ORDERS, {"o_orderkey", "o_custkey", "o_orderpriority"}), "customer": star.CUSTOMER}
    d = C.Dataset(contracts, {n: star.read(spark, sf, n) for n in contracts})
    return records.project_tag(d, "client").frames["orders"]


@query("p11_project_without_tag", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 'customer' AS fk_targets FROM orders""")
def p11_project_without_tag(spark, sf):
    hidden = frozenset({"server"})
    orders = star.ORDERS.with_fields(replace(f, tags=hidden if f.name in ("o_totalprice", "o_orderdate") else frozenset())
                                     for f in star.ORDERS.fields)
    d = C.Dataset({"orders": orders, "customer": star.CUSTOMER}, {n: star.read(spark, sf, n) for n in ("orders", "customer")})
    out = records.project_tag(d, "-server")
    return out.frames["orders"].withColumn("fk_targets", F.lit(",".join(fk.ref_table for fk in out.contracts["orders"].fks)))


@query("p13_brief", f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, 'c_mktsegment=' || c_mktsegment || '(segment);c_acctbal=' || {num('c_acctbal')} || '()' AS about FROM customer""")
def p13_brief(spark, sf):
    noted = star.CUSTOMER.with_fields(replace(f, comment="segment" if f.name == "c_mktsegment" else "") for f in star.CUSTOMER.fields)
    contract = replace(noted, description=("c_mktsegment", "c_acctbal"))
    about = F.array_join(F.transform("descriptions", lambda d: F.concat(d["field"], F.lit("="), d["value"], F.lit("("), d["comment"], F.lit(")"))), ";")
    return records.brief(star.read(spark, sf, "customer"), contract).select("id", "title", about.alias("about"))


@query("p14_get_record", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 1 AND turn = 0")
def p14_get_record(spark, sf):
    return records.get_record(star.read(spark, sf, "conversations"), star.CONVERSATIONS, "1;0")


@query("p15_list_records", f"""
SELECT c_custkey || ',' || c_name || ',' || c_nationkey || ',' || {num('c_acctbal')} AS line FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100""")
def p15_list_records(spark, sf):
    page = records.list_records(star.read(spark, sf, "customer"), star.CUSTOMER, ("c_nationkey", "c_acctbal"), 100, 50)
    return records.to_csv_text(page)


@query("p16_pack_id", f"SELECT {_LINE_ID} AS id, l_partkey FROM lineitem")
def p16_pack_id(spark, sf):
    df = star.read(spark, sf, "lineitem")
    return df.select(records.pack_id(df.schema, star.LINEITEM.key).alias("id"), "l_partkey")


@query("p16_pack_value", """
SELECT CAST(l_orderkey AS VARCHAR) AS id, string_agg('(' || l_linenumber || ',' || l_partkey || ',' || l_suppkey || ')', ','
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS packed FROM lineitem GROUP BY l_orderkey""")
def p16_pack_value(spark, sf):
    df = nested_orders(spark, sf, bad=False)
    return df.select(F.col("l_orderkey").cast("string").alias("id"), records.pack_value("items", df.schema["items"].dataType).alias("packed"))


@query("p17_with_lineage", """
SELECT o_orderkey, 'orders.csv#!C' || row_number() OVER (ORDER BY o_orderkey) AS address FROM orders""")
def p17_with_lineage(spark, sf):
    rows = with_position(star.read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "_row")
    return records.with_lineage(rows.withColumn("_file", F.lit("orders.csv")), 2).select("o_orderkey", "address")


@query("o1_order_by_pk", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey")
def o1_order_by_pk(spark, sf):
    return records.order_by_pk(star.read(spark, sf, "nation"), star.NATION).select("n_nationkey", "n_name")
