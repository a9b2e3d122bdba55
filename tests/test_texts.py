"""Search, translations, changes and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.contract import Dataset, Field, ForeignKey, ListOf, MapOf, Struct, TableContract, Union
from tablewright.operators import changes, search, stats, texts
from tablewright.streaming import validate as stream
from .conftest import rows

KIND = Union("u", (Struct("A", (Field("n", "int"), Field("t", "text"))), Struct("B", ())), default="B")
QUEST = TableContract("quest", ("id",), (Field("id", "int"), Field("title", "text"), Field("u", KIND), Field("m", MapOf("str", "int")), Field("l", ListOf("str"))))


@pytest.fixture(scope="module")
def quests(spark):
    df = spark.createDataFrame([(1, "Find it", ("A", (7, "deep")), [("k", 7)], ["x", "y"]), (2, " ", ("B", None), [], [])],
                               "id int, title string, u struct<type:string,A:struct<n:int,t:string>>, m array<struct<key:string,value:int>>, l array<string>")
    return Dataset({"quest": TableContract("quest", ("id",), tuple(
        f if f.name != "u" else Field("u", Union("u", KIND.impls[:1], default="A")) for f in QUEST.fields))}, {"quest": df})


def test_leaves(quests):
    got = rows(search.leaves(quests.frames["quest"].where("id = 1"), quests.contracts["quest"]), "field_chain", "type", "value")
    assert got == sorted([("id", "int", "1"), ("title", "text", "Find it"), ("u", "str", "A"), ("u.n", "int", "7"), ("u.t", "text", "deep"),
                          ("m.0k", "str", "k"), ("m.0v", "int", "7"), ("l.0", "str", "x"), ("l.1", "str", "y")])


def test_search(quests):
    assert rows(search.search_text(quests, "ee"), "field_chain") == [("u.t",)]
    assert rows(search.search_text(quests, "7"), "field_chain") == [("m.0v",), ("u.n",)]
    assert rows(search.search_text(quests, "  ")) == []
    assert len(rows(search.search_text(quests, "7", 1))) == 1
    assert [search.query_kind(q) for q in (None, "", "12", "1.5", "0x10", "abc")] == ["qNotSet", "qNotSet", "number", "text", "number", "text"]


def test_note_is_a_leaf(spark):
    df = spark.createDataFrame([(1, "mind")], "id int, `$note` string")
    got = rows(search.leaves(df, TableContract("t", ("id",), (Field("id", "int"),))), "field_chain", "value")
    assert got == [("$note", "mind"), ("id", "1")]


def test_text_sheet(quests):
    assert rows(texts.text_rows(quests), "field_chain", "original") == [("title", "Find it"), ("u-t", "deep")]
    sheet = texts.extract_texts_by_id(quests, "quest")
    assert sheet.columns == ["id", "title", "t(title)", "u-t", "t(u-t)"] and sheet.count() == 1


def test_find_terms_both_ways(spark):
    docs = spark.createDataFrame([(1, "abcdefgh and more"), (2, "abc"), (3, ""), (4, None), (5, "日本語のテキスト")], "text_id long, text string")
    terms = spark.createDataFrame([("abc",), ("and",), ("abcdefgh and mor",), ("",), ("本語",), ("zzz",)], "term string")
    scanned = rows(texts.find_terms(docs, terms))
    joined = rows(texts.find_terms(docs, terms, limit=0))
    assert scanned == joined == [(1, "abc"), (1, "abcdefgh and mor"), (1, "and"), (2, "abc"), (5, "本語")]


def test_terms_modes(spark):
    t = spark.createDataFrame([("d", "1", "x", "a sword", "une épée"), ("d", "2", "x", "a sword", "un couteau"), ("d", "3", "x", "a sword", "")],
                              "table string, pk string, field_chain string, original string, translated string")
    words = spark.createDataFrame([("sword", "épée")], "term string, translated string")
    assert rows(texts.check_terms(t, words), "pk") == [("2",), ("3",)]
    assert rows(texts.check_terms(t, words, "pending"), "pk") == [("3",)]


def test_translation_needs_same_original(spark):
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("x", "text")))
    df = spark.createDataFrame([(1, "a\r\nb"), (2, "changed"), (3, "none")], "id int, x string")
    words = spark.createDataFrame([("t", "1", "x", "a\nb", "A"), ("t", "2", "x", "old", "B"), ("t", "3", "x", "none", "")],
                                  "table string, pk string, field_chain string, original string, translated string")
    assert rows(texts.translate_by_id(df, contract, words), "id", "x") == [(1, "A"), (2, "changed"), (3, "none")]
    assert rows(texts.translate_by_value(df, contract, words), "id", "x", "x_original")[0] == (1, "A", "a\r\nb")


def test_shared_values(spark):
    inner = Struct("In", (Field("n", "int"),))
    outer = Struct("Out", (Field("i", inner), Field("k", "int")))
    contract = TableContract("t", ("id",), (Field("id", "int"), Field("o", outer), Field("i", inner)))
    df = spark.createDataFrame([(1, ((5,), 1), (5,)), (2, ((5,), 1), (6,)), (3, ((5,), 2), (7,))], "id int, o struct<i:struct<n:int>,k:int>, i struct<n:int>")
    # In(5): once as a field, once inside each of the two distinct Out values.
    assert rows(stats.shared_values(df, contract), "type", "n", "saved") == [("In", 3, 2), ("Out", 2, 1)]


def test_next_free_id(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "id int")
    assert [stats.next_free_id(df, "id", c).first()[0] for c in (0, 1, 4, 9)] == [4, 4, 6, 10]


def test_pack_bools(spark):
    df = spark.createDataFrame([(1, True, False, True), (2, None, True, False)], "id int, a boolean, b boolean, c boolean")
    assert rows(stats.pack_bools(df, ["a", "b", "c"])) == [(1, 5), (2, 2)]
    assert stats.pack_bools(df, ["a"]).columns == df.columns
    with pytest.raises(ValueError):
        stats.pack_bools(df, ["a"] * 50)


WEAPON = TableContract("weapon", ("id",), (Field("id", "int"), Field("name", "str")))
USER = TableContract("user", ("id",), (Field("id", "int"), Field("w", "int")), (ForeignKey("w", ("w",), "weapon", ("id",)),), source="json")


@pytest.fixture
def arms(spark):
    return Dataset({"weapon": WEAPON, "user": USER}, {
        "weapon": spark.createDataFrame([(1, "bow"), (2, "axe")], "id int, name string"),
        "user": spark.createDataFrame([(1, 1), (2, 2)], "id int, w int")})


def test_upsert_and_references(spark, arms):
    edits = spark.createDataFrame([(1, '{"id":2,"w":1}'), (2, '{"id":3,"w":9}'), (3, '{"id":4,"w":"x"}'), (4, '{"id":2,"w":2}')], "seq int, text string")
    new, results, errors = changes.apply_upsert(arms, "user", edits)
    assert rows(new.frames["user"]) == [(1, 1), (2, 2), (3, 9)]
    assert rows(results) == [("2", "updateOK"), ("3", "addOK"), ("4", "recordParseError")]
    assert rows(errors, "err_type", "record_id") == [("ForeignValueNotFound", "3"), ("JsonValueNotMatchType", "4")]


def test_delete_shows_dangling(spark, arms):
    new, results, errors = changes.apply_delete(arms, "weapon", spark.createDataFrame([("2",), ("7",)], "id string"))
    assert rows(new.frames["weapon"], "id") == [(1,)]
    assert rows(results) == [("2", "deleteOK"), ("7", "recordIdNotFound")]
    assert rows(errors, "table", "record_id", "value") == [("user", "2", "2")]


def test_stream_of_record_files(spark, arms, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (root / "_user").mkdir(parents=True)
    seen = []
    base = Dataset({"weapon": WEAPON}, {"weapon": arms.frames["weapon"]})
    run = lambda: stream.stream_validate(spark, str(root), out, base, {"user": USER}, state,
                                         lambda d, n: seen.append((n, d.frames["user"].count()))).awaitTermination()
    put = lambda name, doc: (root / "_user" / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    put("1.json", {"id": 1, "w": 1})
    put("2.json", {"id": 2, "w": 9})
    put("bad.json", "{")
    run()
    assert rows(stream.latest(spark, out, USER)) == [(1, 1), (2, 9)]
    assert rows(stream.errors_of(spark, out), "err_type", "record_id", "_batch") == [("ForeignValueNotFound", "2", 0), ("JsonParseException", "0", 0)]
    assert rows(stream.open_reference_errors(spark, out, base, {"user": USER}), "record_id") == [("2",)]
    put("2b.json", {"id": 2, "w": 2})
    run()
    assert rows(stream.latest(spark, out, USER)) == [(1, 1), (2, 2)]
    assert rows(stream.open_reference_errors(spark, out, base, {"user": USER})) == []
    assert seen == [(0, 2), (1, 2)]
