"""Records over several rows: folding and laying out by contract."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright import contract as C
from tablewright.operators import blocks
from tablewright.plans import grid_queries
from tablewright.plans.star import fields
from tests.conftest import rows

ITEM = C.Struct("Item", (*fields("k:str n:int"), C.Field("marks", C.ListOf("int"), "block", 2), C.Field("parts", C.ListOf(
    C.Struct("Part", fields("p:str q:int"))), "block")))
ABOUT = C.Struct("About", (*fields("title:str"), C.Field("tags", C.ListOf("str"), "block")))
TABLE = C.TableContract("t", ("id",), (C.Field("id", "int"), C.Field("about", ABOUT), C.Field("items", C.ListOf(ITEM), "block"),
                                       C.Field("ranks", C.MapOf("str", "int"), "block", 2), C.Field("last", "str")))


def records(rng, n):
    some = lambda top, make: [make(i) for i in range(rng.randrange(top))]
    item = lambda i: (f"k{i}", rng.choice((None, i)), some(6, lambda j: j + 1), some(4, lambda j: (f"p{j}", rng.choice((None, j)))))
    return [(i, (f"t{i}", some(4, str)), some(4, item), some(5, lambda j: (f"r{j}", j + 1)), rng.choice((None, "end"))) for i in range(1, n + 1)]


def as_grid(spark, data, per_shard=10_000):
    """Grid rows of the records, dealt over shards and partitions in any order."""
    grid = blocks.records_to_grid(spark.createDataFrame(data, TABLE.schema()), TABLE).orderBy("id", "_line").collect()
    out = [(i // per_shard, f"t_{i // per_shard}", i % per_shard, r["cells"]) for i, r in enumerate(grid)]
    random.Random(1).shuffle(out)
    return spark.createDataFrame(out, "_shard int, _file string, _row int, cells array<string>").repartition(5)


def plain(data):
    return [tuple(r) for r in data]


@pytest.mark.parametrize("per_shard", [10_000, 7, 1])
def test_round_trip(spark, per_shard):
    data = records(random.Random(per_shard), 40)
    typed, errors = blocks.nested_records(as_grid(spark, data, per_shard), TABLE)
    assert errors.count() == 0
    got = sorted(typed.collect())
    assert [r.asDict(recursive=True) for r in got] == [r.asDict(recursive=True) for r in sorted(spark.createDataFrame(data, TABLE.schema()).collect())]


def grid(spark, lines, parts=1):
    data = [(0, "f", i, list(cells)) for i, cells in enumerate(lines)]
    return spark.createDataFrame(data, "_shard int, _file string, _row int, cells array<string>").coalesce(parts)


SMALL = C.TableContract("s", ("id",), (C.Field("id", "int"), C.Field("a", C.ListOf(C.Struct("A", (*fields("x:str"), C.Field(
    "b", C.ListOf(C.Struct("B", fields("y:str z:int"))), "block")))), "block"), C.Field("c", C.ListOf("str"), "block")))


def test_rows_of_a_record(spark):
    lines = [("", "orphan", "o1", "1", ""),      # the first row starts a record without a key
             ("1", "a1", "b1", "1", "c1"), ("", "", "b2", "x", ""), ("", "", "", "", "c2"),
             ("", "a2", "", "", ""), ("", "", "b3", "3", "c3"),
             ("2", "", "", "", ""), ("", "", "late", "", "")]
    typed, errors = blocks.nested_records(grid(spark, lines), SMALL)
    got = {r["id"]: r.asDict(recursive=True) for r in typed.collect()}
    item = lambda x, *b: {"x": x, "b": [{"y": y, "z": z} for y, z in b]}
    assert got[None] == {"id": None, "a": [item("orphan", ("o1", 1))], "c": []}
    assert got[1] == {"id": 1, "a": [item("a1", ("b1", 1), ("b2", None)), item("a2", ("b3", 3))], "c": ["c1", "c2", "c3"]}
    # Rows below an item whose own row has nothing filled: the item is left out, as its first row says.
    assert got[2] == {"id": 2, "a": [], "c": []}
    assert rows(errors, "err_type", "record_id", "field", "value", "lineage") == [("NotMatchFieldType", "1", "b.z", "x", "f#!2")]


def test_empty_grid_and_groups(spark):
    assert blocks.nested_records(grid(spark, [("1", "a", "b", "1", "c")]).limit(0), SMALL)[0].count() == 0
    body = grid(spark, [("1", "a", "b", "1", "c"), ("", "", "b", "2", "")]).withColumn("_table", F.lit("p"))
    body = body.unionByName(grid(spark, [("", "x", "", "", ""), ("7", "y", "", "", "")]).withColumn("_table", F.lit("q")))
    typed, _ = blocks.nested_records(body, SMALL, group=["_table"])
    assert rows(typed, "_table", "id", F.size("a")) == [("p", 1, 1), ("q", 7, 1), ("q", None, 1)]


def test_ordered_stretches(spark, tmp_path):
    lines = [("%d" % (i // 3) if i % 3 == 0 else "", "a%d" % i, "", "", "") for i in range(300)]
    grid(spark, lines).repartitionByRange(7, "_row").sortWithinPartitions("_row").write.parquet(str(tmp_path / "g"))
    body = spark.read.parquet(str(tmp_path / "g"))
    typed, _ = blocks.nested_records(body, SMALL, in_order=True)
    assert rows(typed, "id", F.size("a")) == sorted(((i, 3) for i in range(100)), key=lambda t: str(t[0]))
    # Any order is put right, only slower: every row is a stretch of its own then.
    mixed = body.orderBy(F.rand(1)).coalesce(2)
    assert rows(blocks.nested_records(mixed, SMALL, in_order=True)[0], "id", F.size("a")) == rows(typed, "id", F.size("a"))


def test_blocks_of_a_contract():
    assert [(b.field.name, b.column, b.parent) for b in blocks.block_fields(TABLE)] == [
        ("tags", 2, -1), ("items", 3, -1), ("marks", 5, 1), ("parts", 7, 1), ("ranks", 9, -1)]
    twice = C.TableContract("t", ("id",), (C.Field("id", "int"), C.Field("items", C.ListOf(ITEM), "block", 2)))
    with pytest.raises(ValueError):
        blocks.block_fields(twice)


@pytest.mark.parametrize("in_order", [False, True])
def test_nested_levels_come_from_one_scan(spark, tmp_path, in_order):
    """rows are not moved once per level; in a grid that was written in order they are not moved at all."""
    lines = [("", "", "x"), ("a", "p", "1"), ("", "", "2"), ("", "q", ""), ("", "", "3"), ("b", "", ""), ("", "r", "4"), ("", "", ""), ("c", "", "5")]
    data = [("f%d" % f, i, list(cells)) for f in range(2) for i, cells in enumerate(lines * 20)]
    spark.createDataFrame(data, "_file string, _row int, cells array<string>").repartitionByRange(5, "_file", "_row").sortWithinPartitions(
        "_file", "_row").write.parquet(str(tmp_path / "g"))
    body = spark.read.parquet(str(tmp_path / "g"))
    outer, inner = blocks.fold_blocks(body if in_order else body.repartition(3), [0], [1, 2], in_order=in_order)
    want, starts = ([], []), {}
    for f, i, cells in data:
        for k in range(3):
            if i == 0 or any(cells[:k + 1]):
                starts[k] = i
        for k in (1, 2):
            if starts[k] == i:
                want[k - 1].append((f, *[starts[j] for j in range(k + 1)], cells))
    for frame, level in ((outer, 1), (inner, 2)):
        names = ["_record", *[f"_item{j}" for j in range(1, level + 1)]]
        assert rows(frame.where("_row = " + names[-1]), "_file", *names, "cells") == sorted(
            want[level - 1], key=lambda t: tuple((v is None, str(v)) for v in t))
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in text and "Aggregate" not in text


@pytest.mark.parametrize("cut_at", [1, 3, 5])
def test_items_stay_in_order_over_tasks(spark, cut_at):
    """a record whose later rows are read by an earlier task keeps the order of its items."""
    lines = [("1", "a1", "b1", "1", "c1"), ("", "", "b2", "2", "c2"), ("", "a2", "b3", "3", ""), ("", "", "b4", "4", "c4"), ("", "a3", "", "", ""), ("", "", "b5", "5", "")]
    whole = grid(spark, lines)
    body = whole.where(F.col("_row") >= cut_at).unionByName(whole.where(F.col("_row") < cut_at))
    got = blocks.nested_records(body, SMALL, in_order=True)[0].first().asDict(recursive=True)
    assert [a["x"] for a in got["a"]] == ["a1", "a2", "a3"] and got["c"] == ["c1", "c2", "c4"]
    assert [[b["y"] for b in a["b"]] for a in got["a"]] == [["b1", "b2"], ["b3", "b4"], ["b5"]]


def test_rows_of_blocks_without_others_are_not_opened(spark):
    """an item lays out the blocks in it that have no others inside; only the others are opened and summed up."""
    data = [*records(random.Random(7), 30), (31, None, None, None, None), (32, ("t", None), [("k", 1, None, None), None], [], None)]
    df = spark.createDataFrame(data, TABLE.schema())
    laid = blocks.records_to_grid(df, TABLE)
    text = laid._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("+- Window") + text.count(":- Window") == 1 and text.count("Generate") == 3
    assert laid.where("id = 31").collect()[0]["cells"] == ["31"] + [""] * 13
    assert {len(r["cells"]) for r in laid.collect()} == {14}


def test_positions_are_looked_up_on_written_rows(spark, sf, monkeypatch):
    """the grid is not laid out twice, once to find where ranges begin."""
    seen = []
    monkeypatch.setattr(grid_queries, "with_position", lambda df, order, name: seen.append(df) or df.withColumn(name, F.lit(0)).limit(0))
    grid_queries.s14_round_trip(spark, sf)
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
