"""One key holding most rows, and what keeps such keys off a single task."""

import io
import contextlib
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablewright.cluster import cut, shared_root, with_position
from tablewright.contract import Dataset, Field, ForeignKey, ListOf, Struct, TableContract, Union
from tablewright.functions.scalars import number_text
from tablewright.operators import blocks, checks, refs, texts, typed
from tablewright.operators.recursive import STEP, _put
from tablewright.plans import fixtures, grid_queries, star
from tablewright.sources import grid, records
from tablewright.streaming import validate
from .conftest import rows

ITEM = TableContract("item", ("id",), (Field("id", "long"), Field("owner", "long")), (ForeignKey("owner", ("owner",), "owner", ("id",)),))
OWNER = TableContract("owner", ("id",), (Field("id", "long"),))


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the items belong to owner 0; owner 7 does not exist."""
    items = spark.range(30_000).select("id", F.when(F.col("id") % 3 < 2, 0).when(F.col("id") % 9 == 2, 7).otherwise(
        F.col("id") % 5 + 1).cast("long").alias("owner"))
    return Dataset({"item": ITEM, "owner": OWNER}, {"item": items, "owner": spark.range(7)})


def shuffle_joins(spark):
    """Plans as for tables too big to broadcast."""
    return [("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"),
            ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k"),
            ("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.2")]


@pytest.fixture
def big(spark):
    old = {k: spark.conf.get(k, None) for k, _ in shuffle_joins(spark)}
    for k, v in shuffle_joins(spark):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_reference_checks_with_a_hot_key(spark, hot, big):
    errors = checks.check_fk(hot.frames["item"], ITEM, ITEM.fks[0], hot.frames["owner"])
    assert errors.count() == sum(1 for i in range(30_000) if i % 3 == 2 and i % 9 == 2)
    assert rows(refs.unreferenced(hot, ["owner"]), "id") == [("6",)]
    graph = refs.table_graph(hot).first()
    assert (graph["n_targets"], graph["max_fan_in"], graph["n_dangling"]) == (6, 20_000, errors.count())


def test_matches_of_a_hot_key_on_the_many_side(spark, hot, big):
    fk = ForeignKey("items", ("id",), "item", ("owner",), to_many=True)
    out = refs.resolve_ref_list(hot.frames["owner"], fk, hot.frames["item"].withColumnRenamed("id", "item_id"), "item")
    assert out.where("id = 0").count() == 20_000 and out.where("item is null").count() == 1


def test_duplicates_of_a_hot_key(spark, hot, big):
    df = hot.frames["item"].select(F.col("owner").alias("id"), F.col("id").alias("v"))
    contract = TableContract("t", ("id",), (Field("id", "long"), Field("v", "long")))
    assert checks.check_unique(df, contract).count() == 30_000 - df.select("id").distinct().count()
    last = {r["id"]: r["v"] for r in checks.dedup_last(df, ("id",)).collect()}
    assert last[0] == 29_998 and len(last) == 7


def test_block_rows_of_one_big_record(spark, hot, big):
    items = hot.frames["item"].select(F.col("owner").alias("k"), F.col("id").alias("n"))
    grid = blocks.to_grid(hot.frames["owner"].withColumnRenamed("id", "k"), ["k"], [F.col("k")], items, [F.col("n")], ["n"])
    placed = with_position(grid, ["k", "_o0"], "_row").withColumn("_file", F.lit("f"))
    folded = blocks.fold_records(placed.select("_file", "_row", "cells"), [0])
    sizes = rows(folded.groupBy("_record").count().orderBy("_record"), "count")
    assert (20_000,) in sizes and (1,) in sizes and folded.count() == items.where("k < 7").count() + 1


def test_written_tables_live_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root.rstrip("/")
    assert root in cut(spark.range(3)).inputFiles()[0]


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    from tablewright.operators import records, search
    one = plan(records.get_record(star.read(spark, sf, "conversations"), star.CONVERSATIONS, "1;0"))
    assert "EqualTo(conv_id,1)" in one and "EqualTo(turn,0)" in one
    hits = plan(search.search_number(star.dataset(spark, sf, ("orders",)), 17))
    assert "EqualTo(o_orderkey,17)" in hits and "o_totalprice" not in hits
    check = plan(checks.check_fk(star.read(spark, sf, "orders"), star.ORDERS, star.ORDERS.fks[0], star.read(spark, sf, "customer")))
    assert "struct<o_orderkey:bigint,o_custkey:bigint>" in check and "CartesianProduct" not in check


def test_no_query_plans_a_cross_join(spark, sf):
    from tablewright.plans import load
    for name in ("j7_ref_edges", "j10_unreferenced", "t8_translations_matrix", "j14_table_graph", "c4_check_map_keys"):
        text = plan(load()[0][name](spark, sf))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_recursive_texts_of_small_files_stay_off_the_driver(spark, big):
    """the new texts come back in one join; with broadcasts off for all that has no short list of words there is none at all."""
    cond = Union("cond", (), default="Click", recursive=True)
    click = Struct("Click", (Field("say", "text"), Field("code", "str", lowercase=True)))
    object.__setattr__(cond, "impls", (click, Struct("And", (Field("left", cond), Field("more", ListOf(cond))))))
    contract = TableContract("t", ("id",), (Field("id", "long"), Field("c", cond)))
    text = '{"$type":"And","left":{"$type":"Click","say":"a \\"b\\" é","code":"X","w":1.10},"more":[{"$type":"Click","say":"n","code":"y"}]}'
    df = spark.createDataFrame([(1, text), (2, '{"$type":"Click","say":"z","code":"q"}'), (3, None)], "id long, t string").select(
        "id", F.parse_json("t").alias("c"))
    words = spark.createDataFrame([("t", 'a "b" é', 'T"1"\\ü'), ("t", "n", "")], "table string, original string, translated string")
    out = texts.translate_by_value(df, contract, words)
    got = dict(rows(out, "id", F.to_json("c").alias("c")))
    assert json.loads(got[1]) == json.loads(text) | {"left": {"$type": "Click", "say": 'T"1"\\ü', "code": "X", "w": 1.10}}
    assert json.loads(got[2])["say"] == "z" and got[3] is None
    low = dict(rows(typed.normalise_lower(df, contract), "id", F.to_json("c").alias("c")))
    assert json.loads(low[1])["left"] == {"$type": "Click", "say": 'a "b" é', "code": "x", "w": 1.1}


def test_json_texts_are_replaced_by_path():
    text = '{"a":[1.10,{"k\\"\\u00e9":"x"},"x"],"b":{},"c":"x","d":[[],["x"]]}'
    at = lambda *steps: STEP.join(("r", *steps))
    new = {at("a", "1", 'k"é'): "y", at("d", "1", "0"): 'z"', at("b"): "no text", at("a", "0"): "no text"}
    want = '{"a":[1.10,{"k\\"\\u00e9":"y"},"x"],"b":{},"c":"x","d":[[],["z\\""]]}'
    assert _put(text, new, "r") == want
    whole = text.replace("1.10", "1")
    del new[at("b")], new[at("a", "0")]
    assert json.loads(_put(whole, new, "r")) == json.loads(want.replace("1.10", "1"))
    deep = '{"l":' * 3000 + '"x"' + "}" * 3000
    assert _put(deep, {at(*["l"] * 3000): "y"}, "r") == deep.replace('"x"', '"y"')


def test_record_files_are_written_by_several_tasks(spark, tmp_path):
    """A folder per task, not per record; a file per id whatever its rows, none for no rows."""
    docs = spark.range(40).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('{"n":'), "id", F.lit("}")).alias("text"))
    odd = spark.createDataFrame([("7", '{"n":7}'), (None, None), (None, "{}")], "id string, text string")
    path = fixtures.write_documents(docs.unionByName(odd), "a.b", str(tmp_path / "in"), files_per_task=10)
    folders = os.listdir(tmp_path / "in" / "_a_b")
    assert 1 < len([f for f in folders if f.startswith("task=")]) <= 5
    fixtures.write_documents(docs.limit(0), "a.b", path, mode="append")
    read = records.read_json_documents(spark, path)
    assert read.select("_table").distinct().collect() == [("a.b",)]
    texts_of = [r["text"] for r in read.collect()]
    assert sorted(texts_of) == sorted(['{"n":%d}\n' % i for i in range(40) if i != 7] + ['{"n":7}\n{"n":7}\n', "\n{}\n"])


def test_a_batch_of_many_files_needs_few_tasks(spark, tmp_path):
    """The files of a batch are not looked up in a task each."""
    n = 8 * spark.sparkContext.defaultParallelism + 40
    docs = spark.range(n).select(F.col("id").cast("string").alias("id"), F.to_json(F.struct("id")).alias("text"))
    path = fixtures.write_documents(docs, "owner", str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run = validate.stream_validate(spark, path, out, Dataset({}, {}), {"owner": OWNER}, str(tmp_path / "state"), buckets=2)
    run.awaitTermination()
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(str(run.runId)) for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < n
    assert validate.latest(spark, out, OWNER, 2).count() == n


def test_table_names_are_worked_out_once_per_file(spark, tmp_path, monkeypatch):
    """names are tested on the list of files; the rows are read for that list alone."""
    (tmp_path / "t_1.csv").write_text("a\nb\n1\n2\n")
    (tmp_path / "1_t.csv").write_text("a\nb\n3\n")
    cell_rows = grid.read_grid(spark, str(tmp_path), encoding="UTF-8")
    plans = {}
    monkeypatch.setattr(grid, "cut", lambda df, label: plans.update({label: plan(df)}) or cut(df, label))
    named = grid.with_table_name(cell_rows, str(tmp_path))
    assert rows(named, "_table", "_shard", "_row") == [("t", 1, i) for i in range(4)]
    assert "Filter" in plans["names"] and "Aggregate" not in plans["names"]


def test_number_text_around_exponents(spark):
    """numbers that are written without an exponent take the short way; both ways meet at its ends."""
    want = {9999999.0: "9999999", 1e7: "10000000", -9999999.5: "-9999999.5", 0.001: "0.001", 0.00099: "0.00099", 10.1: "10.1", -100.0: "-100",
            0.0: "0", -0.0: "0", 12345678.5: "12345678.5"}
    df = spark.createDataFrame([(v,) for v in want], "v double")
    assert dict(rows(df, "v", number_text("v"))) == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_of_root_tables_are_not_looked_up(spark, monkeypatch):
    """F16: the edges of a root table are neither written nor matched with its records; dangling, null and repeated keys, and ways back, stay right."""
    frames = {"item": spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, None), (4, 99)], "id long, owner long"),
              "owner": spark.createDataFrame([(0, 2, 1), (1, 3, 1), (3, 4, 9), (4, 3, 2), (5, 1, 1)], "id long, next long, item long")}
    contracts = {"item": TableContract("item", ("id",), (Field("id", "long"), Field("owner", "long")), ITEM.fks, is_root=True),
                 "owner": TableContract("owner", ("id",), (Field("id", "long"), Field("next", "long"), Field("item", "long")),
                                        (ForeignKey("next", ("next",), "owner", ("id",)), ForeignKey("item", ("item",), "item", ("id",))), is_root=False)}
    written = {}
    monkeypatch.setattr(refs, "cut", lambda df, label, by=None: written.__setitem__(label, cut(df, label, by)) or written[label])
    found = rows(refs.reachable_from_entries(Dataset(contracts, frames)))
    # A null key compares as 0.
    assert found == [("item", "1", 0), ("item", "2", 0), ("item", "3", 0), ("item", "4", 0), ("owner", "0", 1), ("owner", "1", 1), ("owner", "3", 2), ("owner", "4", 3)]
    assert written["edges"].where("from_table = 'item'").isEmpty()


def test_items_are_typed_without_lambdas(spark, monkeypatch):
    """what types an item is compiled as a whole; lambdas run over gathered items and found issues only."""
    contract = TableContract("t", ("id",), (Field("id", "long"), Field("items", ListOf(Struct("Item", star.fields("n:int p:long"))), "block")))
    lines = [("1", "1", "x"), ("", "2", "5"), ("", "y", "z"), ("2", "", "")]
    body = spark.createDataFrame([("f", i, list(c)) for i, c in enumerate(lines)], "_file string, _row int, cells array<string>")
    seen = {}
    monkeypatch.setattr(blocks, "cut", lambda df, label, by=None: seen.__setitem__(label, df) or cut(df, label, by))
    typed_rows, errors = blocks.nested_records(body, contract)
    assert rows(errors, "record_id", "field", "value", "lineage") == [("1", "items.n", "y", "f#!2"), ("1", "items.p", "x", "f#!0"), ("1", "items.p", "z", "f#!2")]
    assert [[tuple(i) for i in r["items"]] for r in typed_rows.orderBy("id").collect()] == [[(1, None), (2, 5), (None, None)], []]
    text = plan_of(seen["records"])
    assert "lambda" not in text[text.index("Aggregate"):]


def test_long_texts_are_not_sorted(spark, monkeypatch):
    """a dictionary of texts orders digests; rows with the same place are ordered by their texts as before."""
    from tablewright.operators import stats
    data = [("b", "t2", "x"), ("a", "t9", "y"), ("a", "t1", "x"), ("c", "t2", None), ("c", "t2", None), (None, "t0", "z")]
    matrix = spark.createDataFrame(data, "pk string, original string, de string")
    sorted_by = []
    monkeypatch.setattr(stats, "with_position", lambda df, order, *a: sorted_by.append(df.columns) or with_position(df, order, *a))
    got = {lang: rows(df) for lang, df in stats.text_dictionaries(matrix, ["original", "de"], ["pk"]).items()}
    assert got == {"original": [("t0", 0), ("t1", 1), ("t2", 3), ("t9", 2)], "de": [("x", 1), ("y", 2), ("z", 0)]}
    assert len(sorted_by) == 2 and not any("value" in columns for columns in sorted_by)


def test_unknown_members_are_found_without_a_join(spark):
    """a node knows whether the contract knows what is around it; below wrong tags and leaves nothing is said."""
    from tablewright.operators.recursive import Shape, issues_of, opened
    cond = Union("cond", (), default="Click", recursive=True)
    click = Struct("Click", (Field("n", "long"),))
    object.__setattr__(cond, "impls", (click, Struct("And", (Field("left", cond), Field("more", ListOf(cond))))))
    texts_ = ['{"$type":"And","odd":1,"even":2,"left":{"$type":"Or","odd":1},"more":[{"$type":"Click","n":"x","q":{"r":1}},{"n":1,"z":2},null,5]}', "null"]
    frame = spark.createDataFrame(list(enumerate(texts_)), "k int, t string").select("k", F.parse_json("t").alias("_v"))
    shape = Shape(cond)
    found = issues_of(opened(frame, ["k"], shape, F.lit("c")), ["k"], shape)
    assert rows(found, "kind", "field", "value") == [
        ("JsonHasExtraFields", "c", "even,odd"), ("JsonHasExtraFields", "c.more.0", "q"), ("JsonTypeNotExist", "c.more.1", ""),
        ("JsonTypeNotMatch", "c.left", "Or"), ("JsonValueNotMatchType", "c.more.0.n", '"x"'), ("JsonValueNotMatchType", "c.more.3", "5")]
    assert "Join" not in plan_of(found)


def test_records_share_files_of_a_stream(spark, tmp_path):
    """a pack holds the documents that had a file each before, texts and all, and the stream takes each by itself."""
    docs = spark.range(60).select(F.col("id").cast("string").alias("id"), F.format_string('{"id":%d}', "id").alias("text"))
    odd = spark.createDataFrame([("7", '{"id":7}'), (None, None), (None, "{}"), ("x", '["a"]'), ("y", '{"id":'), ("z", 'a\\n"b')], "id string, text string")
    whole = docs.unionByName(odd)
    alone = fixtures.write_documents(whole, "owner", str(tmp_path / "alone"))
    packed = fixtures.write_documents(whole, "owner", str(tmp_path / "packed"), pack=10)
    texts_of = lambda path: sorted(r["text"] for r in records.read_json_documents(spark, path).collect())
    assert texts_of(packed) == texts_of(alone) and len(texts_of(alone)) == 64
    files = lambda path: [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files(alone)) == 64 and len(files(packed)) <= 7
    # Packs that others wrote: lines as they are, blank ones left out, broken ones reported by line, later lines first.
    folder = tmp_path / "packed" / "_owner" / "pack=mine"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id":100}\r\n\n{"id":\n{"id":7}\n["{\\"id\\":\\n101}"]')
    (folder / "none.jsonl").write_text("")
    typed, errors = records.read_json_records(spark, packed, OWNER)
    assert typed.count() == 64 + 4
    at = [r["lineage"] for r in errors.where("err_type = 'JsonParseException'").collect()]
    assert [a.rsplit("/", 1)[1] for a in at if "pack=mine" in a] == ["a.jsonl#000000003"]
    assert errors.where("err_type = 'JsonFileReadErr'").count() == 0
    out = str(tmp_path / "out")
    validate.stream_validate(spark, packed, out, Dataset({}, {}), {"owner": OWNER}, str(tmp_path / "state"), buckets=2).awaitTermination()
    assert {r["id"] for r in validate.latest(spark, out, OWNER, 2).collect()} >= {*range(60), 100, 101} - {7}


def test_the_streams_of_the_queries_hold_few_files(spark, sf, monkeypatch):
    """the files of the queries' streams grow with a thousandth of the records."""
    held = []
    monkeypatch.setattr(grid_queries.stream, "stream_validate", lambda s, path, *a, **k: held.append(
        records._record_files(s, path).select("_metadata.file_path").distinct().count()) or SimpleNamespace(awaitTermination=lambda: None))
    monkeypatch.setattr(star, "read", lambda s, d, name: s.range(2500).select(
        F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal"),
        (F.col("id") % 25).alias("n_nationkey"), F.lit("n").alias("n_name"), F.lit(0).alias("n_regionkey")))
    grid_queries.stream_suppliers(spark, sf)
    grid_queries.late_nations(spark, sf)
    assert held[1] <= 8 and held[4] <= 14
