"""Grids, typing, blocks, JSON and exports on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from tablewright.contract import Field, ListOf, MapOf, Struct, TableContract, Union, column_of, field_span
from tablewright.functions import scalars as S
from tablewright.functions.packed import parse_packed
from tablewright.operators import blocks, records, typed
from tablewright.sources import grid as G
from tablewright.sources import records as R
from tablewright.sources import sinks
from .conftest import rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("grids")
    (root / "Other").mkdir()
    gbk = "#编号,名称,x1,x2,note\r\nid,name@x,x1,x2,\r\n1,剑,1,,\r\n#2,c,,,\r\n,,,,\r\n3,\"a\"\"b\nline\",0x1F,bad,,extra\r\n"
    (root / "Other" / "item_1.csv").write_bytes(gbk.encode("gbk"))
    (root / "Other" / "item_2道具.csv").write_bytes("﻿id,n\r\nid,nome\r\n7,剑\r\n".encode())
    (root / "Other" / "1bad.csv").write_bytes(b"a\r\nb\r\n")
    return str(root)


@pytest.fixture(scope="module")
def grid(spark, folder):
    return G.with_table_name(G.read_grid(spark, folder), folder).cache()


def test_encoding_quotes_and_ragged_rows(grid):
    got = rows(grid.where("_shard = 1 and _row >= 2"), "_row", "cells")
    assert got[0] == (2, ["1", "剑", "1"])
    assert got[-1] == (5, ["3", 'a"b\nline', "0x1F", "bad", "", "extra"])
    assert rows(grid.where("_shard = 2 and _row = 2"), "cells") == [(["7", "剑"],)]


def test_table_names(grid):
    assert rows(grid.select("_table", "_shard").distinct()) == [("other.item", 1), ("other.item", 2)]


def test_wide_rows_are_read_whole(spark, tmp_path):
    (tmp_path / "w.csv").write_text('a,"b\n' + ",".join(str(i) for i in range(9)) + '",c,d\n')
    (tmp_path / "v.csv").write_text(",".join(str(i) for i in range(100)) + "\n")
    got = {len(r[0]) for r in G.read_grid(spark, str(tmp_path), width=2).select("cells").collect()}
    assert got == {4, 100}


def test_split_files_keep_row_numbers(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f"{i},x\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = G.read_grid(spark, str(tmp_path), multi_line=False)
        assert got.where(F.col("_row") != F.col("cells")[0].cast("long")).count() == 0 and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_header_and_shards(grid):
    columns, body, warnings = G.union_shards(grid, "other.item")
    assert [(c["index"], c["name"], c["comment"]) for c in columns] == [(0, "id", "编号"), (1, "name", "名称"), (2, "x1", ""), (3, "x2", "")]
    assert rows(body, "cells") == [(["1", "剑", "1", ""],), (["3", 'a"b\nline', "0x1F", "bad"],), (["7", "剑"],)]
    assert rows(warnings, "err_type", "level", "value") == [("SplitDataHeaderNotEqual", "warning", "id,nome")]


ITEM = TableContract("other.item", ("id",), (Field("id", "int"), Field("name", "str"), Field("xList", ListOf("int"), layout="fix", width=2)))


def test_typing_and_lineage(spark, grid):
    _, body, _ = G.union_shards(grid, "other.item")
    good, errors = typed.type_grid(body.where("_shard = 1"), ITEM)
    assert rows(good, "id", "name", "xList") == [(1, "剑", [1]), (3, 'a"b\nline', [31, None])]
    assert rows(errors, "err_type", "record_id", "field", "value") == [("NotMatchFieldType", "3", "xList.1", "bad")]
    full = rows(typed.fill_defaults(good, ITEM), "xList")
    assert full == [([1],), ([31, 0],)]
    address = records.with_lineage(body.where("_row = 5"), column_of(ITEM, "xList")).first()["address"]
    assert address.endswith("item_1.csv#!C6")


def test_profile_and_drift(grid):
    profile = G.ingest_profile(grid).first()
    assert (profile["files"], profile["rows"], profile["comment_rows"], profile["blank_rows"]) == (2, 3, 1, 1)
    drift = rows(G.header_drift(grid, {"other.item": ITEM}), "column", "status")
    assert ("x1", "grouped") in drift and ("nome", "extra") in drift and ("name", "missing") in drift


def test_transpose(spark):
    grid = spark.createDataFrame([("f", 0, ["c", "id", "1", "2"]), ("f", 1, ["", "n", "a"])], "_file string, _row long, cells array<string>")
    assert rows(G.transpose_columns(grid), "_row", "cells") == [(0, ["c", ""]), (1, ["id", "n"]), (2, ["1", "a"]), (3, ["2", ""])]


def test_lineage_letters():
    assert [records.column_letters(i) for i in (0, 25, 26, 51, 701, 702)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]


def test_swapped_lineage(spark):
    df = spark.createDataFrame([("f", 27)], "_file string, _row long")
    assert records.with_lineage(df, 2, swapped=True).first()["address"] == "f#!AB3"


COND = Union("cond", (Struct("Level", (Field("lv", "int"),)), Struct("And", (Field("a", "int"), Field("b", "str")))), default="Level")


def test_union_cells(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("c", COND)))
    assert field_span(contract.fields[1]) == 3
    df = spark.createDataFrame([(["1", "And", "2", "x"],), (["2", "", "5"],), (["3", "Nope", "1"],), (["4"],)], "cells array<string>")
    good, errors = typed.type_grid(df, contract, keep=[])
    assert rows(good, "id", "c.type", "c.Level.lv", "c.And.b") == [(1, "And", None, "x"), (2, "Level", 5, None), (3, None, None, None), (4, None, None, None)]
    assert rows(errors, "err_type", "value") == [("InterfaceCellImplNotFound", "Nope")]
    full = rows(typed.fill_defaults(good, contract), "id", "c.type", "c.Level.lv", "c.And.b")
    assert full[2:] == [(3, "Level", 0, None), (4, "Level", 0, None)]


def test_separated_structs(spark):
    point = Struct("Point", (Field("x", "int"), Field("y", "int")), layout="sep", sep=":")
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("ps", ListOf(point), layout="sep", sep=";")))
    df = spark.createDataFrame([(["1", "1:2;3:4"],), (["2", "1;5:6:7;x:1"],), (["3", ""],)], "cells array<string>")
    good, errors = typed.type_grid(df, contract, keep=[])
    assert rows(good, "id", "ps.x") == [(1, [1, 3]), (2, [None, 5, None]), (3, [])]
    assert rows(errors, "err_type", "field") == [("FieldCellNotUsed", "ps.1"), ("FieldCellSpanNotEnough", "ps.0"), ("NotMatchFieldType", "ps.2.x")]


@pytest.mark.parametrize("text, wanted", [
    ("a,b,c", ["a", "b", "c"]), ("a,b,", ["a", "b"]), (",,", ["", ""]), ("", []),
    ('"a,b",c', ["a,b", "c"]), ('"a""b"', ['a"b']), ('"a"x,y', ["ax", "y"]), ('a"b,c', ['a"b', "c"]), ('"a,b', ["a,b"]),
])
def test_split_sep(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(S.split_sep("t", ",")).first()[0] == wanted


@pytest.mark.parametrize("text, wanted", [
    ("1,(2)", None), ("1,5", (1, "Level", 5, None)), ("1, Level(7)", (1, "Level", 7, None)), ('2,And(0x10,"q,)")', (2, "And", None, "q,)")),
    ("1,And(3", None), ("1", None), ("1,2,3", None), ("1,Zip(3)", None),
])
def test_packed(spark, text, wanted):
    kind = Struct("S", (Field("i", "int"), Field("c", COND)))
    p = spark.createDataFrame([(text,)], "t string").select(parse_packed("t", kind).alias("p"))
    got = p.select("p.value.i", "p.value.c.type", "p.value.c.Level.lv", "p.value.c.And.b", "p.error").first()
    assert (got["error"] is not None) if wanted is None else (tuple(got)[:4] == wanted)


def test_packed_lists_and_maps(spark):
    df = spark.createDataFrame([("(a),b;\"c,d\"", "1,x,2,(y)", "1;0x0f,3")], "s string, m string, n string")
    got = df.select(parse_packed("s", ListOf("str"))["value"], parse_packed("m", MapOf("int", "str"))["value"],
                    parse_packed("n", ListOf("int"))["value"]).first()
    assert got[0] == ["a", "b", "c,d"] and [tuple(e) for e in got[1]] == [(1, "x"), (2, "y")] and got[2] == [1, 15, 3]


def test_recursive_packed_value_is_variant(spark):
    tree = Union("tree", (), default="Leaf", recursive=True)
    leaf = Struct("Leaf", (Field("n", "int"),))
    node = Struct("Node", (Field("l", tree), Field("r", tree)))
    object.__setattr__(tree, "impls", (leaf, node))
    df = spark.createDataFrame([("Node(Node(Leaf(1),Leaf(2)),Leaf(3))",)], "t string").select(parse_packed("t", tree).alias("p"))
    got = df.select(F.variant_get("p.value", "$.l.r.n", "int"), F.variant_get("p.value", "$.r.n", "int")).first()
    assert tuple(got) == (2, 3)


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("0xff",), ("#10",), ("*42",), ("12abc",), ("",), ("-7",)], "t string")
    assert [r[0] for r in df.select(S.parse_hex_int("t")).collect()] == [255, 16, 42, None, None, -7]
    nums = spark.createDataFrame([(1.0,), (0.5,), (12345678.9,), (-3.25,), (0.0,)], "d double")
    assert [r[0] for r in nums.select(S.number_text("d")).collect()] == ["1", "0.5", "12345678.9", "-3.25", "0"]


@pytest.mark.parametrize("name, snake, screaming", [
    ("heroR", "hero_r", "HERO_R"), ("HTTPServer", "http_server", "HTTP_SERVER"), ("2024C", "2024_c", "2024C"), ("__a_b__", "__a_b__", "A_B"),
])
def test_naming(spark, name, snake, screaming):
    df = spark.createDataFrame([(name,)], "t string")
    assert tuple(df.select(S.camel_to_snake("t"), S.screaming_snake("t")).first()) == (snake, screaming)


def test_block_rows(spark):
    grid = spark.createDataFrame([("f", 0, ["1", "100", "1", "2"]), ("f", 1, ["", "200", "3", "4"]), ("f", 2, ["", "", "5", "6"]),
                                  ("f", 3, ["2", "300", "7", ""]), ("g", 0, ["", "9", "9", "9"])], "_file string, _row long, cells array<string>")
    assert rows(blocks.fold_records(grid, [0]), "_file", "_row", "_record") == [("f", 0, 0), ("f", 1, 0), ("f", 2, 0), ("f", 3, 3), ("g", 0, 0)]
    outer, inner = blocks.fold_blocks(grid.where("_file = 'f'"), [0], [1, 2])
    assert rows(outer, "_record", "_row") == [(0, 0), (0, 1), (3, 3)]
    assert rows(inner, "_record", "_item1", "_row") == [(0, 0, 0), (0, 1, 1), (0, 1, 2), (3, 3, 3)]


def test_running_state_crosses_chunks(spark):
    from tablewright.cluster import running_last
    df = spark.range(1000).select(F.lit("f").alias("_file"), F.col("id").alias("_row"))
    got = running_last(df, F.when(F.col("_row") % 300 == 0, F.col("_row")), ["_file"], "_row", "start", chunk=7)
    assert got.where(F.col("start") != F.floor(F.col("_row") / 300) * 300).count() == 0


def test_global_position(spark):
    from tablewright.cluster import with_position
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"))
    got = with_position(df, ["k"])
    assert got.agg(F.min("_pos"), F.max("_pos"), F.count_distinct("_pos")).first()[:] == (0, 9999, 10_000)
    first = [r[0] for r in got.orderBy("_pos").limit(3).collect()]
    assert first == sorted(first)


JSON = TableContract("t", ("id",), (Field("id", "int"), Field("c", COND), Field("m", MapOf("int", "str")), Field("l", ListOf("float")),
                                    Field("b", "bool"), Field("s", "str", lowercase=True)), source="json")


def test_json_records(spark):
    df = spark.createDataFrame([('{"id":1.7,"c":{"$type":"cond.And","a":3,"b":"x"},"m":[{"key":1,"value":"z"}],"l":[1,2.5,"q"],"b":1,"s":"ABC","zz":1,"$note":"n"}',),
                                ("nope",), ('{"id":2,"c":{"$type":"Zip"},"m":3,"b":true}',), ("",), ('{"id":3,"c":{}}',)], "text string")
    good, errors = typed.json_to_typed(df, "text", JSON)
    got = rows(good, "id", "c.type", "c.And.a", "b", "s", F.size("m").alias("n"), "l")
    assert (1, "And", 3, True, "abc", 1, [1.0, 2.5, 0.0]) in got and (2, "Level", None, True, "", 0, []) in got
    assert rows(errors, "err_type", "level") == sorted([
        ("JsonHasExtraFields", "warning"), ("JsonParseException", "error"), ("JsonStrEmpty", "error"), ("JsonTypeNotExist", "error"),
        ("JsonTypeNotMatch", "error"), ("JsonValueNotMatchType", "error"), ("JsonValueNotMatchType", "error")])


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([('{"id":1,"c":{"$type":"And","a":3,"b":"x"},"l":[1]}',), ("{}",)], "text string")
    good, _ = typed.json_to_typed(df, "text", JSON)
    assert '{"$type":"t","id":1,"c":{"$type":"And","a":3,"b":"x"},"l":[1.0]}' in [r[0] for r in sinks.to_json_records(good, JSON, True).collect()]
    assert sinks.write_json_records(good, JSON, str(tmp_path / "j")) is False


def test_csv_export_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', (2,))], "id int, t string, s struct<n:int>")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    name = next(n for n in os.listdir(tmp_path / "c") if n.endswith(".csv"))
    assert (tmp_path / "c" / name).read_bytes() == '﻿id,t,s\r\n1,"a,""b""","{""n"":2}"\r\n'.encode()


def test_sql_script(spark, tmp_path):
    contract = TableContract("HeroItem", ("id",), (Field("id", "int", comment="it's"), Field("name", "str"), Field("l", ListOf("int"))), uniques=(("name",),))
    ddl = sinks.sql_ddl(contract)
    assert "CREATE TABLE IF NOT EXISTS `cfg_hero_item`" in ddl and "COMMENT 'it''s'" in ddl
    assert "UNIQUE KEY `uk_cfg_hero_item_name` (`name`)" in ddl and "`name` varchar(255) NOT NULL" in ddl
    df = spark.createDataFrame([(i, "o'x\\", [i]) for i in range(5)], "id int, name string, l array<int>")
    got = rows(sinks.sql_statements(df, contract, batch=2))
    assert len(got) == 3 and got[0][1].startswith("INSERT INTO `cfg_hero_item` (`id`, `name`, `l`) VALUES\n  (0, 'o''x\\\\', '[0]'),\n  (1")
    sinks.write_sql_dump(df, contract, str(tmp_path / "s"), batch=2)
    text = "".join((tmp_path / "s" / n).read_text() for n in sorted(os.listdir(tmp_path / "s")) if n.startswith("part"))
    assert text.startswith("DROP TABLE IF EXISTS") and text.count("INSERT INTO") == 3


def test_grid_round_trip_of_one_row_layouts(spark):
    point = Struct("Point", (Field("x", "int"), Field("y", "int")), layout="sep", sep=":")
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("ps", ListOf(point), layout="sep", sep=";"), Field("f", ListOf("int"), layout="fix", width=2),
                                            Field("c", COND), Field("m", MapOf("int", "str"), layout="fix", width=1)))
    df = spark.createDataFrame([(["1", "1:2;3:4", "7", "8", "And", "2", "x", "5", "v"],)], "cells array<string>")
    good, _ = typed.type_grid(df, contract, keep=[])
    back = good.select(F.array(*blocks.record_cells(good, contract.fields, good.schema)).alias("cells"))
    assert back.first()["cells"] == df.first()["cells"]


def test_json_files_and_manifest(spark, tmp_path):
    (tmp_path / "_a_b").mkdir()
    (tmp_path / "_a_b" / "1.json").write_text('{"id":\n1}')
    (tmp_path / "~x.json").write_text("{}")
    (tmp_path / "n.txt").write_text("x")
    contract = TableContract("a.b", ("id",), (Field("id", "int"),), source="json")
    good, errors = R.read_json_records(spark, str(tmp_path), contract)
    assert rows(good, "id") == [(1,)] and rows(errors) == []


def test_tags(spark):
    from tablewright.contract import Dataset, ForeignKey
    t = frozenset({"client"})
    inner = Struct("Inner", (Field("a", "int", tags=t), Field("b", "int")), tags=t)
    one = TableContract("one", ("id",), (Field("id", "int", tags=t), Field("s", inner, tags=t), Field("x", "int")), (ForeignKey("x", ("x",), "two", ("id",)),), tags=t)
    two = TableContract("two", ("id",), (Field("id", "int"),))
    df = spark.createDataFrame([(1, (2, 3), 4)], "id int, s struct<a:int,b:int>, x int")
    d = Dataset({"one": one, "two": two}, {"one": df, "two": spark.createDataFrame([(4,)], "id int")})
    out = records.project_tag(d, "client")
    assert list(out.contracts) == ["one"] and out.contracts["one"].fks == () and out.frames["one"].schema.simpleString() == "struct<id:int,s:struct<a:int>>"
    rest = records.project_tag(d, "-client")
    assert list(rest.contracts) == ["two"]


def test_number_text_keeps_every_digit(spark):
    values = [0.1234567890123456, 1.2345678901234568e-05, 1.5e10, -1.25e7, 123456789012345680000.0, 1e20, 100.0, 1e-6, 5e-7, -0.00015, 12000000.5]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [r[0] for r in df.select(S.number_text("d")).collect()]
    assert got == ["0.1234567890123456", "0.000012345678901234568", "15000000000", "-12500000", "123456789012345680000",
                   "100000000000000000000", "100", "0.000001", "5.0E-7", "-0.00015", "12000000.5"]


def test_letters_of_any_length(spark):
    from tablewright.operators.records import letters_of
    df = spark.createDataFrame([(n,) for n in (0, 25, 26, 701, 702, 18277, 18278, 30000, 475253)], "n long")
    assert [r[0] for r in df.select(letters_of("n")).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "ARIW", "ZZZZ"]


@pytest.mark.parametrize("text, kind", [("1_0", "int"), ("2147483648", "int"), ("9223372036854775808", "long"), ("nan", "float"), ("١", "int")])
def test_packed_numbers_are_strict(spark, text, kind):
    from tablewright.contract import Field, Struct
    from tablewright.functions.packed import parse_packed
    df = spark.createDataFrame([(f"{text},1",)], "c string")
    row = df.select(parse_packed("c", Struct("P", (Field("a", kind), Field("b", "int")))).alias("p")).first()["p"]
    assert row["value"] is None and row["error"]
