"""Constraint checks on small hand-made tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablewright.contract import Dataset, Field, ForeignKey, ListOf, MapOf, Struct, TableContract
from tablewright.operators import checks, refs
from .conftest import rows

TARGET = TableContract("target", ("id",), (Field("id", "int"), Field("code", "str")), uniques=(("code",),))


def source(**kw):
    fk = ForeignKey("fk", ("fk",), "target", ("id",), nullable=kw.pop("nullable", False), to_many=kw.pop("to_many", False))
    return TableContract("source", kw.pop("key", ("id",)), (Field("id", "int"), Field("fk", "int", layout=kw.pop("layout", "auto"))), (fk,), **kw)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "id int, code string")


def check(spark, target, contract, data):
    df = spark.createDataFrame(data, "id int, fk int")
    return rows(checks.check_fk(df, contract, contract.fks[0], target), "err_type", "record_id", "value")


NOT_FOUND, EMPTY = "ForeignValueNotFound", "RefNotNullableButCellEmpty"


@pytest.mark.parametrize("kw, data, wanted", [
    ({}, [(1, 1), (2, 2)], []),
    ({}, [(1, 9)], [(NOT_FOUND, "1", "9")]),
    ({}, [(1, None)], [(EMPTY, "1", None)]),
    ({}, [(1, 0)], [(NOT_FOUND, "1", "0")]),
    ({"nullable": True}, [(1, None), (2, 0), (3, 1)], []),
    ({"nullable": True}, [(1, 9)], [(NOT_FOUND, "1", "9")]),
    ({"nullable": True, "key": ("fk",)}, [(1, 9)], []),
    ({"nullable": True, "uniques": (("fk", "id"),)}, [(1, 9)], []),
    ({"key": ("fk",)}, [(1, 9)], [(NOT_FOUND, "9", "9")]),
    ({"source": "json", "nullable": True}, [(1, 9), (2, None)], []),
    ({"source": "json"}, [(1, 9), (2, None)], [(NOT_FOUND, "1", "9"), (NOT_FOUND, "2", "")]),
    ({"layout": "pack", "nullable": True}, [(1, 9)], []),
    ({"layout": "pack"}, [(1, 9)], [(NOT_FOUND, "1", "9")]),
    ({"to_many": True}, [(1, 9)], []),
])
def test_scalar_rules(spark, target, kw, data, wanted):
    assert check(spark, target, source(**kw), data) == wanted


def test_reference_to_unique_key(spark, target):
    fk = ForeignKey("fk", ("code",), "target", ("code",))
    contract = TableContract("source", ("id",), (Field("id", "int"), Field("code", "str")), (fk,))
    df = spark.createDataFrame([(1, "a"), (2, "x")], "id int, code string")
    assert rows(checks.check_fk(df, contract, fk, target), "record_id", "value") == [("2", "x")]


def test_composite_key_counts_as_empty_only_when_all_cells_are(spark):
    fk = ForeignKey("fk", ("a", "b"), "pair", ("a", "b"))
    contract = TableContract("source", ("id",), (Field("id", "int"), Field("a", "int"), Field("b", "int")), (fk,))
    df = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, None, None), (4, 5, 5)], "id int, a int, b int")
    pair = spark.createDataFrame([(1, 1), (1, 0)], "a int, b int")
    assert rows(checks.check_fk(df, contract, fk, pair), "err_type", "record_id") == [(NOT_FOUND, "4"), (EMPTY, "3")]


def test_list_and_map_references(spark, target):
    contract = TableContract("source", ("id",), (Field("id", "int"), Field("l", ListOf("int")), Field("m", MapOf("int", "int"))), (
        ForeignKey("l", ("l",), "target", ("id",)), ForeignKey("m", ("m",), "target", ("id",))))
    df = spark.createDataFrame([(1, [1, 7, 8, 7], [(9, 1), (9, 5)]), (2, [], [])], "id int, l array<int>, m array<struct<key:int,value:int>>")
    assert rows(checks.check_fk(df, contract, contract.fks[0], target), "value") == [("7",), ("7",), ("8",)]
    assert rows(checks.check_fk(df, contract, contract.fks[1], target), "value") == [("5",)]


def test_nested_references_report_the_owner(spark, target):
    inner = Struct("Inner", (Field("t", "int"),), (ForeignKey("t", ("t",), "target", ("id",)),))
    contract = TableContract("source", ("id",), (Field("id", "int"), Field("one", inner), Field("many", ListOf(inner)), Field("m", MapOf("int", inner))))
    df = spark.createDataFrame([(1, (9,), [(1,), (8,)], [(5, (7,))])],
                               "id int, one struct<t:int>, many array<struct<t:int>>, m array<struct<key:int,value:struct<t:int>>>")
    got = rows(checks.check_fk_nested(df, contract, {"target": target}), "record_id", "field", "value")
    assert got == [("1", "m.0v.t", "7"), ("1", "many.1.t", "8"), ("1", "one.t", "9")]


def test_unique_key_counts_every_repeat_and_keeps_the_last(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("v", "str")))
    df = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b"), (2, "x"), (None, "n"), (None, "m")], "id int, v string")
    assert len(rows(checks.check_unique(df, contract))) == 3
    assert rows(checks.dedup_last(df, ("id",))) == [(1, "c"), (2, "x"), (None, "n")]


def test_rows_equal_in_every_column_are_all_counted(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("v", "str")), uniques=(("v",),))
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "a")], "id int, v string")
    assert len(rows(checks.check_unique(df, contract))) == 4
    assert rows(checks.check_unique(df, contract, ("v",)), "record_id") == [("1",)] * 4 + [("2",)]
    assert rows(checks.dedup_last(df, ("id",))) == [(1, "a"), (2, "a")]


def test_more_repeats_than_one_chunk(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"),))
    df = spark.range(25_001).select(F.lit(7).alias("id"))
    assert checks.check_unique(df, contract).count() == 25_000
    assert checks.dedup_last(df, ("id",)).count() == 1


def test_lineage_names_the_repeating_row(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"),), order=("_row",))
    df = spark.createDataFrame([(1, "f.csv", 2), (1, "f.csv", 5)], "id int, _file string, _row int")
    assert rows(checks.check_unique(df, contract), "lineage") == [("f.csv#!5",)]


def test_unique_keys_are_checked_on_surviving_rows(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("u", "str")), uniques=(("u",),))
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, u string")
    got = rows(checks.table_errors(df, contract), "field", "record_id")
    assert got == [("id", "1")]


def test_only_surviving_rows_are_validated(spark, target):
    contract = source()
    df = spark.createDataFrame([(1, 9), (1, 10), (2, 9), (2, 1)], "id int, fk int")
    target10 = target.unionByName(spark.createDataFrame([(10, "j")], "id int, code string"))
    d = Dataset({"source": contract, "target": TARGET}, {"source": df, "target": target10})
    got = rows(checks.validate(d).where("err_type = 'ForeignValueNotFound'"), "record_id", "value")
    assert got == [("2", "9")]


def test_entry_rules(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("n", "str")), entry="n", order=("id",))
    df = spark.createDataFrame([(1, "Fire"), (2, "fire"), (3, "a b"), (4, ""), (5, None)], "id int, n string")
    assert rows(checks.check_entry(df, contract), "err_type", "record_id") == [("EntryContainsSpace", "3"), ("EntryDuplicated", "2")]
    enum = rows(checks.check_entry(df, contract, is_enum=True), "err_type", "record_id")
    assert ("EnumEmpty", "4") in enum and ("EnumEmpty", "5") in enum


def test_sequence(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("s", "int", seq=True)))
    df = spark.createDataFrame([(10, 0), (11, 2), (12, 2)], "id int, s int")
    assert rows(checks.check_seq(df, contract, "s"), "record_id", "value") == [("11", "2")]


def test_map_keys(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("m", MapOf("int", "str"))))
    df = spark.createDataFrame([(1, [(1, "a"), (2, "b"), (1, "c"), (1, "d")]), (2, [(1, "a")])], "id int, m array<struct<key:int,value:string>>")
    assert rows(checks.check_map_keys(df, contract, "m"), "record_id", "value") == [("1", "1"), ("1", "1")]
    assert df.select(checks.entries_to_map(F.col("m")).alias("m")).first()[0] == {2: "b", 1: "d"}


def test_must_fill(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("n", "str", must_fill=True), Field("l", ListOf("int"), must_fill=True)))
    df = spark.createDataFrame([(1, "x", [1]), (2, None, []), (3, "y", None)], "id int, n string, l array<int>")
    assert rows(checks.check_must_fill(df, contract), "record_id", "field") == [("2", "l"), ("2", "n"), ("3", "l")]


def test_strict_mode_raises_and_lenient_passes(spark, target):
    contract = source()
    d = Dataset({"source": contract, "target": TARGET}, {"source": spark.createDataFrame([(1, 9)], "id int, fk int"), "target": target})
    errors = checks.validate(d)
    with pytest.raises(checks.ValidationError):
        checks.require_valid(errors)
    assert checks.require_valid(errors, allow_errors=True).count() == 1
    warning = errors.withColumn("level", F.lit("warning"))
    checks.require_valid(warning)


def test_self_reference_and_entry_points(spark):
    task = TableContract("task", ("id",), (Field("id", "int"), Field("next", "int"), Field("e", "str")),
                         (ForeignKey("next", ("next",), "task", ("id",), nullable=True),), entry="e")
    df = spark.createDataFrame([(1, 2, "start"), (2, 3, ""), (3, 1, ""), (4, 0, ""), (5, None, "")], "id int, next int, e string")
    d = Dataset({"task": task}, {"task": df})
    assert rows(refs.unreferenced(d)) == [("task", "4"), ("task", "5")]
    assert rows(refs.reachable_from_entries(d)) == [("task", "1", 0), ("task", "2", 1), ("task", "3", 2)]
    around = rows(refs.neighbourhood(d, "task", "1", 1, 2, 10), "id", "depth")
    assert around == [("1", 0), ("2", 1), ("3", -1)]
    root = Dataset({"task": replace(task, is_root=True)}, {"task": df})
    assert rows(refs.unreferenced(root)) == []


def test_lookup_status(spark, target):
    d = Dataset({"target": TARGET}, {"target": target})
    assert [refs.lookup_status(d, *a) for a in ((None, "1"), ("target", ""), ("x", "1"), ("target", "q"), ("target", "9"), ("target", "1"))] == [
        "tableNotSet", "idNotSet", "tableNotFound", "idParseErr", "idNotFound", "ok"]


def test_edge_labels(spark, target):
    fk = ForeignKey("fk", ("fk",), "target", ("id",), nullable=True)
    named = ForeignKey("by", ("fk",), "target", ("id",), title="t")
    contract = TableContract("source", ("id",), (Field("id", "int"), Field("fk", "int"), Field("t", "str")), (fk, named))
    df = spark.createDataFrame([(1, 2, "boss"), (2, 9, "none")], "id int, fk int, t string")
    d = Dataset({"source": contract, "target": TARGET}, {"source": df, "target": target})
    assert rows(refs.ref_edges(d), "from_id", "label", "to_id") == [("1", "boss", "2"), ("1", "nullableRefFk", "2")]
