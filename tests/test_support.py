"""Reference index and bucket tables: the same answers as full checks, from the touched buckets only."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tablewright import contract as C
from tablewright.operators import changes, checks
from tablewright.operators.support import BucketTable, ReferenceIndex
from tablewright.plans import star
from tablewright.streaming import validate as stream
from tests.conftest import rows

ITEM = C.Struct("Item", star.fields("arm:int"), (star.fk("arm", "arm", "id"),))
ARM = C.TableContract("arm", ("id",), star.fields("id:int code:str"), uniques=(("code",),))
USER = C.TableContract("user", ("id",), (C.Field("id", "int"), C.Field("code", "str"), C.Field("arms", C.ListOf("int")),
                                         C.Field("items", C.ListOf(ITEM))),
                       (star.fk("code", "arm", "code", name="byCode"), star.fk("arms", "arm", "id", name="byArms")))


def arms(spark, data):
    return spark.createDataFrame(data, ARM.schema())


def users(spark, data):
    return spark.createDataFrame([(i, code, list(a), [(x,) for x in b]) for i, code, a, b in data], USER.schema())


def columns(df):
    return rows(df, "err_type", "table", "record_id", "field", "value", "msg")


def full(d):
    return columns(checks.reference_errors(d, d.fks(), d.names()))


def test_index_follows_changes(spark, tmp_path):
    rng = random.Random(3)
    have_arms = {i: f"c{i}" for i in range(0, 20, 2)}
    have_users = {}
    some = lambda: [rng.randrange(12) for _ in range(rng.randrange(3))]
    user = lambda i: (i, None if rng.random() < 0.2 else f"c{rng.randrange(12)}", some(), some())
    for i in range(30):
        have_users[i] = user(i)
    d = C.Dataset({"arm": ARM, "user": USER}, {"arm": arms(spark, list(have_arms.items())), "user": users(spark, list(have_users.values()))})
    index = ReferenceIndex(spark, str(tmp_path / "index"), d.contracts, buckets=8).build(d)
    assert columns(index.errors()) == full(d) and full(d)
    for version in range(1, 5):
        old_arms = {i: have_arms.pop(i) for i in rng.sample(sorted(have_arms), 2)}
        new_arms = {i: f"c{rng.randrange(12)}" for i in rng.sample(range(12), 3) if i not in have_arms}
        replaced = {i: have_users[i] for i in rng.sample(sorted(have_users), 4)}
        new_users = {i: user(i) for i in [*list(replaced)[:3], 100 + version]}
        have_arms.update(new_arms)
        for i in replaced:
            del have_users[i]
        have_users.update(new_users)
        change = [("arm", arms(spark, list(old_arms.items())), arms(spark, list(new_arms.items()))),
                  ("user", users(spark, list(replaced.values())), users(spark, list(new_users.values())))]
        index.change(change, version)
        index.change(change, version)  # a batch that runs again
        index.forget(version)
        now = C.Dataset(d.contracts, {"arm": arms(spark, list(have_arms.items())), "user": users(spark, list(have_users.values()))})
        assert columns(index.errors()) == full(now)
    counts = {(r["target"], r["key"]): (r["referrers"], r["there"]) for r in index.support().collect()}
    assert counts[("arm(id)", "1")][1] == (1 in have_arms)


def poisoned(df):
    """Fails when any row of it is read."""
    first = df.columns[0]
    return df.withColumn(first, F.raise_error(F.lit("read")).cast(df.schema[first].dataType))


def test_changes_read_no_other_table(spark, sf, tmp_path):
    d = star.dataset(spark, sf)
    index = ReferenceIndex(spark, str(tmp_path / "index"), d.contracts, buckets=8).build(d)
    for name in ("region", "nation", "orders", "lineitem", "supplier", "part"):
        d = d.swap(name, poisoned(d.frames[name]))
    gone = d.frames["customer"].where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    d, _, errors = changes.delete_indexed(d, index, "customer", gone, 1)
    wanted = star.read(spark, sf, "orders").where("o_custkey % 5 = 0").count()
    assert errors.where("table = 'orders'").count() == wanted > 0
    back = star.read(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.to_json(F.struct(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")).alias("text"))
    assert changes.upsert_indexed(d, index, "customer", back, 2)[2].count() == 0
    with pytest.raises(Exception, match="read"):
        d.frames["orders"].collect()


def test_bucket_table(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k int, v string", ("k",), 4)
    assert table.read().count() == 0
    first = spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string")
    table.write(0, first, range(4))
    one = table.buckets_of(first.where("k = 3"))
    table.write(1, first.limit(0), one)  # an emptied bucket stays empty
    inside = {r["k"] for r in first.where(table.bucket().isin(one)).collect()}
    assert {r["k"] for r in table.read().collect()} == set(range(20)) - inside
    assert table.read(one, before=1).count() == len(inside) and table.read(one).count() == 0
    table.write(2, first.where("k = 3"), one)
    table.forget(2)
    assert rows(table.read(one)) == [(3, "a")] and table.read(one, before=2).count() == 0


def write(root, table, name, text):
    os.makedirs(root / f"_{table}", exist_ok=True)
    (root / f"_{table}" / f"{name}.json").write_text(text)


FLAT = C.TableContract("user", ("id",), star.fields("id:int arm:int"), (star.fk("arm", "arm", "id"),), source="json")
LATE = C.TableContract("arm", ("id",), star.fields("id:int code:str"), source="json")


def test_late_targets_read_their_buckets_only(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    tables = {"user": FLAT, "arm": LATE}
    base = C.Dataset({}, {})
    run = lambda: stream.stream_validate(spark, str(root), out, base, tables, state, buckets=16).awaitTermination()
    opened = lambda: rows(stream.open_reference_errors(spark, out, base, tables, buckets=16), "record_id", "value")
    for i in range(12):
        write(root, "user", f"u{i}", f'{{"id":{i},"arm":{i % 3}}}')
    write(root, "arm", "a0", '{"id":0,"code":"x"}')
    run()
    assert opened() == sorted((str(i), str(i % 3)) for i in range(12) if i % 3)
    write(root, "user", "again", '{"id":1,"arm":7}')
    run()
    assert ("1", "7") in opened() and ("1", "1") not in opened()
    # What holds neither the new record nor the keys it answers to may be unreadable.
    index = stream.reference_index(spark, out, base, tables, 16)
    answered = index.incoming("arm", spark.createDataFrame([(2, "")], LATE.schema()))
    kept = {*index.refs.buckets_of(answered)}
    store = stream._stored(spark, out, LATE, 16)
    own = set(store.buckets_of(spark.createDataFrame([(2,)], "id int")))
    spoilt = []
    for path in glob.glob(f"{out}/**/*.parquet", recursive=True):
        bucket = int(path.split("_b=")[1].split("/")[0]) if "_b=" in path else None
        if bucket is not None and ("/_references/" in path and bucket not in kept or "/arm/" in path and bucket not in own or "/user/" in path):
            spoilt.append((path, open(path, "rb").read()))
            open(path, "wb").write(b"spoilt")
    assert spoilt
    write(root, "arm", "a2", '{"id":2,"code":"z"}')
    run()
    for path, data in spoilt:
        if os.path.exists(path):
            open(path, "wb").write(data)
    for path in glob.glob(f"{out}/**/.*.crc", recursive=True):
        os.remove(path)
    assert opened() == sorted([("1", "7"), *((str(i), "1") for i in (4, 7, 10))])


def test_a_change_rewrites_its_own_references(spark, tmp_path):
    """what other tables refer to is neither written again nor moved for keys that nobody misses."""
    line = C.TableContract("line", ("id",), star.fields("id:int order:int part:int"), (star.fk("order", "order", "id"), star.fk("part", "part", "id")))
    order = C.TableContract("order", ("id",), star.fields("id:int part:int"), (star.fk("part", "part", "id"),))
    part = C.TableContract("part", ("id",), star.fields("id:int"))
    ints = lambda data, names: spark.createDataFrame(data, ", ".join(f"`{n}` int" for n in names))
    d = C.Dataset({"line": line, "order": order, "part": part}, {
        "line": ints([(i, i % 20, i % 7) for i in range(100)], ("id", "order", "part")),
        "order": ints([(i, i % 5) for i in range(20)], ("id", "part")), "part": ints([(i,) for i in range(6)], ("id",))})
    index = ReferenceIndex(spark, str(tmp_path / "index"), d.contracts, buckets=4).build(d)
    assert columns(index.errors()) == full(d)
    gone = spark.createDataFrame([(str(i),) for i in range(0, 20, 3)], "id string")
    now, _, errors = changes.delete_indexed(d, index, "order", gone, 1)
    assert columns(errors) == full(now) and errors.where("field = 'order'").count() == 35
    versions = lambda name: sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "index" / "refs" / f"of={name}" / "_v=*")))
    assert versions("line") == ["_v=0"] and versions("order") == ["_v=0", "_v=1"]
    # An index that was kept otherwise is not taken for an empty one.
    BucketTable(spark, str(tmp_path / "other" / "refs"), index.refs.schema, ("_to", "_key"), 4).write(0, index.references(), range(4))
    with pytest.raises(ValueError):
        ReferenceIndex(spark, str(tmp_path / "other"), d.contracts, buckets=4)
