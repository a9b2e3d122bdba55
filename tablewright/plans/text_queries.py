"""Search and translation queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import contract as C
from ..operators import checks, refs, search, stats, texts, typed
from . import star
from .check_queries import NESTED, nested_orders
from .registry import num, query


@query("t1_leaves", f"""
SELECT CAST(c_custkey AS VARCHAR) AS pk, 'c_custkey' AS field_chain, 'long' AS type, CAST(c_custkey AS VARCHAR) AS value FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_name', 'str', c_name FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_nationkey', 'int', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_acctbal', 'float', {num('c_acctbal')} FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_mktsegment', 'str', c_mktsegment FROM customer""")
def t1_leaves(spark, sf):
    return search.leaves(star.read(spark, sf, "customer"), star.CUSTOMER).drop("table")


_NESTED = """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS pk, 'l_orderkey' AS field_chain, CAST(l_orderkey AS VARCHAR) AS value FROM (SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'items.' || pos || '.l_linenumber', CAST(l_linenumber AS VARCHAR) FROM i
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'items.' || pos || '.l_partkey', CAST(l_partkey AS VARCHAR) FROM i
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'items.' || pos || '.l_suppkey', CAST(l_suppkey AS VARCHAR) FROM i"""


@query("t1_nested_leaves", _NESTED)
def t1_nested_leaves(spark, sf):
    return search.leaves(nested_orders(spark, sf, bad=False), NESTED).select("pk", "field_chain", "value")


TASK = C.Union("cond", (C.Struct("Click", ()), C.Struct("And", ())), default="Click", recursive=True)


@query("t1_recursive_leaves", """
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS pk, CAST(user_id AS VARCHAR) AS u, event_type AS t, props->>'k' AS k FROM events)
SELECT pk, 'c' AS field_chain, 'str' AS type, 'And' AS value FROM e
UNION ALL SELECT pk, 'c.left', 'str', t FROM e
UNION ALL SELECT pk, 'c.left.user', 'long', u FROM e
UNION ALL SELECT pk, 'c.right', 'str', 'And' FROM e
UNION ALL SELECT pk, 'c.right.left', 'str', 'Props' FROM e
UNION ALL SELECT pk, 'c.right.left.k', 'long', k FROM e
UNION ALL SELECT pk, 'c.right.list.0', 'long', k FROM e
UNION ALL SELECT pk, 'event_id', 'long', pk FROM e""")
def t1_recursive_leaves(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.format_string('{"$type":"And","left":{"$type":"%s","user":%d},"right":{"$type":"And","left":{"$type":"Props","k":%s},"list":[%s]}}',
                           F.col("event_type"), F.col("user_id"), k, k)
    df = star.read(spark, sf, "events").select("event_id", F.parse_json(text).alias("c"))
    contract = C.TableContract("events", ("event_id",), (C.Field("event_id", "long"), C.Field("c", TASK)))
    return search.leaves(df, contract).drop("table")


@query("t2_search_text", """
SELECT 'documents' AS "table", CAST(doc_id AS VARCHAR) AS pk, 'text' AS field_chain, text AS value FROM documents WHERE contains(text, 'tion')
UNION ALL SELECT 'conversations', conv_id || ';' || turn, 'text', text FROM conversations WHERE contains(text, 'tion')
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'p_name', p_name FROM part WHERE contains(p_name, 'tion')
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'source', source FROM documents WHERE contains(source, 'tion')""")
def t2_search_text(spark, sf):
    return search.search_text(star.dataset(spark, sf, ("documents", "conversations", "part")), "tion")


@query("t2_search_top", """
SELECT 'part' AS "table", CAST(p_partkey AS VARCHAR) AS pk, 'p_name' AS field_chain, p_name AS value FROM part WHERE contains(p_name, 'ring')
ORDER BY pk LIMIT 25""")
def t2_search_top(spark, sf):
    return search.search_text(star.dataset(spark, sf), "ring", 25, "part")


@query("t3_search_number", """
SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS pk, 'c_custkey' AS field_chain FROM customer WHERE c_custkey = 17
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_nationkey' FROM customer WHERE c_nationkey = 17
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'n_nationkey' FROM nation WHERE n_nationkey = 17
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'n_regionkey' FROM nation WHERE n_regionkey = 17
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 's_suppkey' FROM supplier WHERE s_suppkey = 17
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 's_nationkey' FROM supplier WHERE s_nationkey = 17
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'o_orderkey' FROM orders WHERE o_orderkey = 17
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'o_custkey' FROM orders WHERE o_custkey = 17""")
def t3_search_number(spark, sf):
    d = star.dataset(spark, sf, ("customer", "nation", "supplier", "orders"))
    return search.search_text(d, "17").drop("value")


@query("t4_extract_texts_by_value", """
SELECT 'documents' AS "table", trim(text) AS original FROM documents WHERE trim(text) <> ''
UNION ALL SELECT 'conversations', trim(text) FROM conversations WHERE trim(text) <> ''
UNION ALL SELECT 'benchmark', trim(text) FROM benchmark WHERE trim(text) <> ''""")
def t4_extract_texts_by_value(spark, sf):
    d = star.dataset(spark, sf, ("documents", "conversations", "benchmark", "nation"))
    return texts.extract_texts_by_value(d).select("table", "original")


@query("t5_extract_texts_by_id", """
SELECT conv_id || ';' || turn AS id, role, replace(trim(text), chr(13) || chr(10), chr(10)) AS text,
  CASE WHEN turn % 2 = 0 THEN upper(role) ELSE '' END AS translated FROM conversations WHERE trim(text) <> ''""")
def t5_extract_texts_by_id(spark, sf):
    df = star.read(spark, sf, "conversations")
    done = df.where("turn % 2 = 0").select(F.lit("conversations").alias("table"), F.concat_ws(";", "conv_id", "turn").alias("pk"),
                                           F.lit("text").alias("field_chain"), F.upper("role").alias("translated"))
    out = texts.extract_texts_by_id(star.dataset(spark, sf, ("conversations",)), "conversations", "role", done)
    return out.withColumnRenamed("t(text)", "translated")


def value_dictionary(spark, sf, tag: str = "T:"):
    """Translations of two thirds of the documents, every third of them empty."""
    df = star.read(spark, sf, "documents").where("doc_id % 3 <> 0")
    word = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit(tag), F.lower("text")))
    return df.select(F.lit("documents").alias("table"), F.col("text").alias("original"), word.alias("translated"),
                     F.col("doc_id").alias("seq"))


_LAST = """w AS (SELECT replace(text, chr(13) || chr(10), chr(10)) AS o, arg_max(CASE WHEN doc_id % 5 = 0 THEN '' ELSE '{tag}' || lower(text) END, doc_id) AS t
FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)"""


@query("t6_translate_by_value", "WITH " + _LAST.format(tag="T:") + """
SELECT doc_id, coalesce(nullif(t, ''), text) AS text, text AS text_original FROM documents LEFT JOIN w ON replace(text, chr(13) || chr(10), chr(10)) = o""")
def t6_translate_by_value(spark, sf):
    out = texts.translate_by_value(star.read(spark, sf, "documents"), star.DOCUMENTS, value_dictionary(spark, sf), "seq")
    return out.select("doc_id", "text", "text_original")


@query("t7_translate_by_id", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 3 <> 0 THEN 'T:' || role ELSE text END AS text FROM conversations""")
def t7_translate_by_id(spark, sf):
    df = star.read(spark, sf, "conversations")
    # Every third conversation changed after it was translated.
    original = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    words = df.where("turn % 2 = 0").select(F.lit("conversations").alias("table"), F.concat_ws(";", "conv_id", "turn").alias("pk"),
                                            F.lit("text").alias("field_chain"), original.alias("original"),
                                            F.concat(F.lit("T:"), "role").alias("translated"))
    return texts.translate_by_id(df, star.CONVERSATIONS, words).select("conv_id", "turn", "text")


@query("t8_translations_matrix", """
WITH w AS (SELECT replace(text, chr(13) || chr(10), chr(10)) AS o, arg_max(CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'D:' || lower(text) END, doc_id) AS de,
  arg_max(CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'F:' || lower(text) END, doc_id) AS fr FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS pk, text AS original, coalesce(nullif(de, ''), text) AS de, coalesce(nullif(fr, ''), text) AS fr
FROM documents LEFT JOIN w ON replace(text, chr(13) || chr(10), chr(10)) = o""")
def t8_translations_matrix(spark, sf):
    d = star.dataset(spark, sf, ("documents",))
    words = {"de": value_dictionary(spark, sf, "D:"), "fr": value_dictionary(spark, sf, "F:")}
    return texts.translations_matrix(d, words, "seq").select("pk", "original", "de", "fr")


@query("c12_text_dictionaries", """
WITH w AS (SELECT replace(text, chr(13) || chr(10), chr(10)) AS o, max(CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'D:' || lower(text) END) AS de
  FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1),
cells AS (SELECT CAST(doc_id AS VARCHAR) AS pk, text AS original, coalesce(nullif(de, ''), text) AS de
  FROM documents LEFT JOIN w ON replace(text, chr(13) || chr(10), chr(10)) = o),
both_langs AS (SELECT 'original' AS lang, original AS value, min(pk) AS p FROM cells GROUP BY original
  UNION ALL SELECT 'de', de, min(pk) FROM cells GROUP BY de)
SELECT lang, value, row_number() OVER (PARTITION BY lang ORDER BY p, value) - 1 AS index FROM both_langs""")
def c12_text_dictionaries(spark, sf):
    matrix = texts.translations_matrix(star.dataset(spark, sf, ("documents",)), {"de": value_dictionary(spark, sf, "D:")})
    words = stats.text_dictionaries(matrix, ["original", "de"], ["pk"])
    return C.union_all(d.withColumn("lang", F.lit(lang)) for lang, d in words.items())


@query("t9_check_terms", """
SELECT CAST(doc_id AS VARCHAR) AS pk, b.text AS term FROM documents d JOIN benchmark b ON contains(d.text, b.text)
WHERE NOT contains(CASE WHEN doc_id % 2 = 0 THEN upper(d.text) ELSE '' END, upper(b.text))""")
def t9_check_terms(spark, sf):
    docs = star.read(spark, sf, "documents")
    rows = docs.select(F.lit("documents").alias("table"), F.col("doc_id").cast("string").alias("pk"), F.lit("text").alias("field_chain"),
                       F.col("text").alias("original"), F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise("").alias("translated"))
    terms = star.read(spark, sf, "benchmark").select(F.col("text").alias("term"), F.upper("text").alias("translated"))
    return texts.check_terms(rows, terms).select("pk", "term")


@query("t9_find_words", """
SELECT CAST(doc_id AS VARCHAR) AS text_id, w AS term FROM documents d
JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) ON contains(d.text, w)""")
def t9_find_words(spark, sf):
    docs = star.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("text_id"), "text")
    words = star.read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return texts.find_terms(docs, words)


def text_table(spark, sf):
    """Document texts with every second one translated."""
    rows = texts.text_rows(star.dataset(spark, sf, ("documents",)))
    return rows.withColumn("translated", F.when(F.col("pk").cast("long") % 2 == 0, F.concat(F.lit("T"), "pk")).otherwise(""))


_TEXTS = """r AS (SELECT CAST(doc_id AS VARCHAR) AS pk, replace(trim(text), chr(13) || chr(10), chr(10)) AS original,
  CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE '' END AS translated FROM documents WHERE trim(text) <> '')"""


@query("t10_split_todo", "WITH " + _TEXTS + " SELECT 'todo' AS part, pk, original FROM r WHERE translated = '' UNION ALL SELECT 'done', pk, original FROM r WHERE translated <> ''")
def t10_split_todo(spark, sf):
    todo, done = texts.split_todo(text_table(spark, sf))
    return (todo.select(F.lit("todo").alias("part"), "pk", "original")
            .unionByName(done.select(F.lit("done").alias("part"), "pk", "original")))


@query("t10_merge_todo", "WITH " + _TEXTS + """
SELECT pk, CASE WHEN translated = '' AND CAST(pk AS BIGINT) % 3 <> 0 AND CAST(pk AS BIGINT) % 5 <> 0 THEN 'N' || pk ELSE translated END AS translated FROM r""")
def t10_merge_todo(spark, sf):
    rows = text_table(spark, sf)
    todo, _ = texts.split_todo(rows)
    n = F.col("pk").cast("long")
    answered = todo.withColumn("translated", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("N"), "pk"))).withColumn(
        "original", F.when(n % 5 == 0, F.concat(F.lit("old "), "original")).otherwise(F.col("original")))
    return texts.merge_todo(rows, answered).select("pk", "translated")


@query("t11_reuse_translations", "WITH " + _TEXTS + """, p AS (SELECT original, arg_min(translated, pk) AS t FROM r WHERE translated <> '' GROUP BY original)
SELECT pk, coalesce(t, '') AS translated FROM r LEFT JOIN p USING (original) WHERE translated = ''""")
def t11_reuse_translations(spark, sf):
    todo, done = texts.split_todo(text_table(spark, sf))
    return texts.reuse_translations(todo, done).select("pk", "translated")


@query("c14_translation_coverage", "WITH " + _TEXTS + " SELECT 'documents' AS \"table\", count(*) AS texts, count(*) FILTER (translated = '') AS untranslated FROM r")
def c14_translation_coverage(spark, sf):
    return texts.translation_coverage(text_table(spark, sf))


@query("x2_visit_leaves", """
SELECT 'int' AS type, 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n
UNION ALL SELECT 'str', (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM customer)
UNION ALL SELECT 'long', count(*) FROM customer UNION ALL SELECT 'float', count(*) FROM customer""")
def x2_visit_leaves(spark, sf):
    d = star.dataset(spark, sf, ("nation", "customer"))
    return search.visit_leaves(d, lambda leaves: leaves.groupBy("type").agg(F.count("*").alias("n")))


# ------------------------------------------------------- nested and recursive

def conditions(refs: bool = True) -> C.Union:
    """A recursive union: a click with a text, a user and its order, or two conditions and a list of them."""
    cond = C.Union("cond", (), default="Click", recursive=True)
    click = C.Struct("Click", (C.Field("say", "text"), C.Field("code", "str", lowercase=True), C.Field("order", "long")),
                     (star.fk("order", "orders", "o_orderkey"),) if refs else ())
    both = C.Struct("And", (C.Field("left", cond), C.Field("right", cond), C.Field("more", C.ListOf(cond))))
    object.__setattr__(cond, "impls", (click, both))
    return cond


def recursive_events(spark, sf, bad: bool = False):
    """Events as conditions of depth three; with ``bad`` numbers that are no number, unknown tags and members, two levels down."""
    df = star.read(spark, sf, "events")
    key, order = F.col("event_id"), F.col("user_id").cast("string")
    if bad:
        order = F.when(key % 7 == 0, F.lit('"seven"')).otherwise(order)
    click = lambda n: F.format_string('{"$type":"Click","say":"%s","code":"%s","order":%s}', F.col("event_type"), F.concat(F.lit("C"), key + n), order)
    tag = F.when(F.lit(bad) & (key % 11 == 0), "Or").otherwise("And")
    extra = F.when(F.lit(bad) & (key % 13 == 0), ',"odd":1').otherwise("")
    inner = F.concat(F.lit('{"$type":"'), tag, F.lit('","left":'), click(1), F.lit(',"right":'), click(2), F.lit(',"more":[]'), extra, F.lit("}"))
    text = F.concat(F.lit('{"$type":"And","left":'), click(0), F.lit(',"right":'), inner, F.lit(',"more":['), click(3), F.lit("]}"))
    return df.select("event_id", text.alias("text"))


RECURSIVE = C.TableContract("events", ("event_id",), (C.Field("event_id", "long"), C.Field("c", conditions())))


def recursive_records(spark, sf):
    return recursive_events(spark, sf).select("event_id", F.parse_json("text").alias("c"))


_PATHS = "(VALUES ('c.left', 0), ('c.right.left', 1), ('c.right.right', 2), ('c.more.0', 3)) p(path, n)"


def said(df, name: str, member: str):
    """A row per click of the recursive records with one of its members."""
    paths = {"c.left": "$.left", "c.right.left": "$.right.left", "c.right.right": "$.right.right", "c.more.0": "$.more[0]"}
    return df.select("event_id", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.try_variant_get(
        "c", f"{at}.{member}", "string").alias(name)) for p, at in paths.items()])).alias("x")).select("event_id", "x.*")


@query("p8_recursive", f"SELECT event_id, path, 'c' || (event_id + n) AS code FROM events, {_PATHS}")
def p8_recursive(spark, sf):
    return said(typed.normalise_lower(recursive_records(spark, sf), RECURSIVE), "code", "code")


@query("t6_recursive", f"""
SELECT event_id, path, CASE WHEN event_type = 'click' THEN 'T:click' ELSE event_type END AS say FROM events, {_PATHS}""")
def t6_recursive(spark, sf):
    words = star.read(spark, sf, "events").select("event_type").distinct().select(
        F.lit("events").alias("table"), F.col("event_type").alias("original"),
        F.when(F.col("event_type") == "click", "T:click").otherwise("").alias("translated"))
    return said(texts.translate_by_value(recursive_records(spark, sf), RECURSIVE, words), "say", "say")


@query("t7_recursive", f"""
SELECT event_id, path, CASE WHEN path = 'c.right.left' AND event_id % 3 = 0 AND event_id % 2 = 0 THEN 'T' || event_id ELSE event_type END AS say
FROM events, {_PATHS}""")
def t7_recursive(spark, sf):
    df = star.read(spark, sf, "events").where("event_id % 3 = 0")
    old = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("changed since")
    words = df.select(F.lit("events").alias("table"), F.col("event_id").cast("string").alias("pk"), F.lit("c-right-left-say").alias("field_chain"),
                      old.alias("original"), F.concat(F.lit("T"), "event_id").alias("translated"))
    return said(texts.translate_by_id(recursive_records(spark, sf), RECURSIVE, words), "say", "say")


@query("t1_recursive_types", f"""
SELECT CAST(event_id AS VARCHAR) AS pk, path || '.say' AS field_chain, 'text' AS type, event_type AS value FROM events, {_PATHS}
UNION ALL SELECT CAST(event_id AS VARCHAR), path || '.order', 'long', CAST(user_id AS VARCHAR) FROM events, {_PATHS}""")
def t1_recursive_types(spark, sf):
    return search.leaves(recursive_records(spark, sf), RECURSIVE, ("text", "long")).where("field_chain <> 'event_id'").drop("table")


@query("j4_recursive", f"""
SELECT CAST(event_id AS VARCHAR) AS record_id, path || '.order' AS field, CAST(user_id AS VARCHAR) AS value FROM events, {_PATHS}
WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)""")
def j4_recursive(spark, sf):
    orders = star.read(spark, sf, "orders").where("o_orderkey % 3 = 0")
    contract = replace(RECURSIVE, source="json")
    return checks.check_fk_nested(recursive_records(spark, sf), contract, {"orders": orders}).select("record_id", "field", "value")


def recursive_dataset(spark, sf):
    return C.Dataset({"events": RECURSIVE, "orders": replace(star.ORDERS, fks=())},
                     {"events": recursive_records(spark, sf), "orders": star.read(spark, sf, "orders")})


@query("j7_recursive_edges", f"""
SELECT CAST(event_id AS VARCHAR) AS from_id, path || '.refOrder' AS label, CAST(user_id AS VARCHAR) AS to_id FROM events, {_PATHS}
WHERE user_id IN (SELECT o_orderkey FROM orders)""")
def j7_recursive_edges(spark, sf):
    return refs.ref_edges(recursive_dataset(spark, sf)).select("from_id", "label", "to_id")


@query("j10_recursive", """
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT user_id FROM events)""")
def j10_recursive(spark, sf):
    return refs.unreferenced(recursive_dataset(spark, sf), ["orders"]).select("id")


@query("j14_nested", """
SELECT 'events' AS from_table, 4 * count(*) AS n_refs, count(DISTINCT CASE WHEN there THEN user_id END) AS n_targets,
  CAST(4 * count(*) FILTER (NOT there) AS BIGINT) AS n_dangling, (SELECT coalesce(4 * max(n), 0) FROM (
    SELECT count(*) AS n FROM events WHERE user_id IN (SELECT o_orderkey FROM orders) GROUP BY user_id)) AS max_fan_in
FROM (SELECT *, user_id IN (SELECT o_orderkey FROM orders) AS there FROM events)""")
def j14_nested(spark, sf):
    return refs.table_graph(recursive_dataset(spark, sf)).select("from_table", "n_refs", "n_targets", "n_dangling", "max_fan_in")


@query("p10_recursive_errors", """
WITH c AS (SELECT event_id, path, n FROM events, (VALUES ('c.left', 0), ('c.right.left', 1), ('c.right.right', 2), ('c.more.0', 3)) p(path, n))
SELECT 'JsonValueNotMatchType' AS err_type, CAST(event_id AS VARCHAR) AS record_id, path || '.order' AS field, '"seven"' AS value FROM c
WHERE event_id % 7 = 0 AND (event_id % 11 <> 0 OR NOT starts_with(path, 'c.right.'))
UNION ALL SELECT 'JsonTypeNotMatch', CAST(event_id AS VARCHAR), 'c.right', 'Or' FROM events WHERE event_id % 11 = 0
UNION ALL SELECT 'JsonHasExtraFields', CAST(event_id AS VARCHAR), 'c.right', 'odd' FROM events WHERE event_id % 13 = 0 AND event_id % 11 <> 0""")
def p10_recursive_errors(spark, sf):
    docs = recursive_events(spark, sf, bad=True).select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"c":'), "text",
                                                                F.lit("}")).alias("text"))
    return typed.json_to_typed(docs, "text", RECURSIVE)[1].select("err_type", "record_id", "field", "value")


WORDS = C.Struct("Words", (C.Field("say", "text"), C.Field("code", "str", lowercase=True, must_fill=True), C.Field("sizes", C.MapOf("int", "str"))))
DEEP = C.TableContract("part", ("p_partkey",), (C.Field("p_partkey", "long"), C.Field("about", C.Struct("About", (
    C.Field("words", C.ListOf(WORDS)),)))))


def deep_parts(spark, sf):
    """Parts with structs in a list in a struct; some have no code, some repeat a map key."""
    df, key = star.read(spark, sf, "part"), F.col("p_partkey")
    entry = lambda k: F.struct(F.lit(k).alias("key"), F.col("p_type").alias("value"))
    sizes = F.when(key % 5 == 0, F.array(entry(1), entry(2), entry(1))).otherwise(F.array(entry(1)))
    words = F.struct(F.col("p_brand").alias("say"), F.when(key % 7 != 0, F.upper("p_type")).alias("code"), sizes.alias("sizes"))
    again = F.struct(F.col("p_name").alias("say"), F.lit("X").alias("code"), F.array(entry(3)).alias("sizes"))
    return df.select("p_partkey", F.struct(F.array(words, again).alias("words")).alias("about"))


@query("p8_nested", """
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN lower(p_type) END AS a, 'x' AS b FROM part""")
def p8_nested(spark, sf):
    out = typed.normalise_lower(deep_parts(spark, sf), DEEP)
    return out.select("p_partkey", F.col("about.words")[0]["code"].alias("a"), F.col("about.words")[1]["code"].alias("b"))


@query("p9_nested", """
SELECT 'MustFillButCellEmpty' AS err_type, CAST(p_partkey AS VARCHAR) AS record_id, 'about.words.0.code' AS field FROM part WHERE p_partkey % 7 = 0""")
def p9_nested(spark, sf):
    return checks.check_nested(deep_parts(spark, sf), DEEP).where("err_type = 'MustFillButCellEmpty'").select("err_type", "record_id", "field")


@query("c4_nested", """
SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'about.words.0.sizes' AS field, '1' AS value FROM part WHERE p_partkey % 5 = 0""")
def c4_nested(spark, sf):
    return checks.check_nested(deep_parts(spark, sf), DEEP).where("err_type = 'MapKeyDuplicated'").select("record_id", "field", "value")


@query("t6_nested", """
SELECT p_partkey, 'T:' || p_brand AS a, p_name AS b FROM part""")
def t6_nested(spark, sf):
    words = star.read(spark, sf, "part").select(F.lit("part").alias("table"), F.col("p_brand").alias("original"),
                                                F.concat(F.lit("T:"), "p_brand").alias("translated")).distinct()
    out = texts.translate_by_value(deep_parts(spark, sf), DEEP, words)
    return out.select("p_partkey", F.col("about.words")[0]["say"].alias("a"), F.col("about.words")[1]["say"].alias("b"))


@query("t7_nested", """
SELECT p_partkey, p_brand AS a, CASE WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey ELSE p_name END AS b FROM part""")
def t7_nested(spark, sf):
    words = star.read(spark, sf, "part").where("p_partkey % 3 = 0").select(
        F.lit("part").alias("table"), F.col("p_partkey").cast("string").alias("pk"), F.lit("about-words-1-say").alias("field_chain"),
        F.col("p_name").alias("original"), F.concat(F.lit("T"), "p_partkey").alias("translated"))
    out = texts.translate_by_id(deep_parts(spark, sf), DEEP, words)
    return out.select("p_partkey", F.col("about.words")[0]["say"].alias("a"), F.col("about.words")[1]["say"].alias("b"))


@query("t4_translated", """
SELECT * FROM (SELECT 'documents' AS "table", CASE WHEN doc_id % 5 = 0 THEN '' ELSE
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS original,
  CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id WHEN doc_id % 5 = 0 THEN 'none' ELSE '' END AS translated FROM documents)
WHERE original <> '' OR translated <> ''""")
def t4_translated(spark, sf):
    df, key = star.read(spark, sf, "documents"), F.col("doc_id")
    # No-break and ideographic spaces and a byte order mark around the originals; blank ones have a translation.
    blank = F.lit("\u00a0\u3000\ufeff")
    original = F.when(key % 5 == 0, blank).otherwise(F.concat(blank, "text", blank))
    done = F.when(key % 3 == 0, F.concat(F.lit("T"), key)).when(key % 5 == 0, "none").otherwise(original)
    df = df.withColumn("text_original", original).withColumn("text", done)
    return texts.extract_texts_by_value(C.Dataset({"documents": star.DOCUMENTS}, {"documents": df}))
