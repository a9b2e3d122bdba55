"""Reference checks that follow changes: who points where, and what is there, kept by key.

A full check reads every table.  Here each reference is one row filed under the key it needs, and each key that can be
pointed at is one row with the number of records that have it.  Both are dealt into buckets by that key, so a change
reads the buckets of the keys it touches and no table at all: references of old and new versions of the
changed records, and keys that came or went.  References are kept apart by the table they stand in, so a change rewrites those of
its own tables only.  A bucket's open references are its references without a key; a record
that arrives late closes exactly those filed under its key.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..cluster import cut
from ..contract import ERROR_COLUMNS, Dataset, TableContract, union_all
from ..functions.scalars import pack_id, pack_value
from .checks import key_value, nested_references, references

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: From so many bytes on, buckets are rewritten without bringing their rows together.
_MANY = 256 << 20


class BucketTable:
    """Parquet rows in ``buckets`` folders by ``key``; a new version holds only the buckets that changed.

    The newest version of each bucket counts.  Writing a version again replaces it, so a job that was cut off can run again.  Every
    rewritten bucket has a mark row, so that one left without rows hides its older version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: Sequence[str], buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, tuple(key), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, *frames: DataFrame) -> list[int]:
        """The buckets that rows of ``frames`` belong to: ``buckets`` numbers at most."""
        keys = union_all(f.select(*self.key) for f in frames)
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def _listed(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}"))
        return [f.getPath().toString() for f in found or ()]

    def _versions(self) -> dict[int, list[int]]:
        """Complete versions of each bucket, newest first."""
        done = {int(p.split("/_v=")[1].split("/")[0]) for p in self._listed("_v=*/_SUCCESS")}
        out: dict[int, list[int]] = {}
        for p in self._listed("_v=*/_b=*"):
            version, bucket = (int(p.split(f"/{name}=")[1].split("/")[0]) for name in ("_v", "_b"))
            if version in done:
                out.setdefault(bucket, []).append(version)
        return {b: sorted(v, reverse=True) for b, v in out.items()}

    def _newest(self, only: Iterable[int] | None = None, before: int | None = None) -> list[str]:
        wanted = None if only is None else set(only)
        paths = []
        for bucket, versions in sorted(self._versions().items()):
            now = next((v for v in versions if before is None or v < before), None)
            if now is not None and (wanted is None or bucket in wanted):
                paths.append(f"{self.path}/_v={now}/_b={bucket}")
        return paths

    def read(self, only: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of all buckets, or of some, as they are or as they were ``before`` a version."""
        paths = self._newest(only, before)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        marked = T.StructType([*self.schema.fields, T.StructField("_mark", T.BooleanType())])
        return self.spark.read.schema(marked).parquet(*paths).where("_mark is null").drop("_mark")

    def size(self, only: Iterable[int], before: int | None = None) -> int:
        """Bytes of some buckets, as they are or as they were ``before`` a version."""
        return sum(f.getLen() for path in self._newest(only, before) for f in self._fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path)))

    def write(self, version: int, rows: DataFrame, touched: Sequence[int], many: bool = False) -> None:
        """``rows`` are from now on all that the ``touched`` buckets hold.

        ``many`` rows are written where they are, a file per task and bucket; else they are brought together first.  A task has the
        files of all its buckets open, so that nothing is sorted.
        """
        marks = self.spark.createDataFrame([(b,) for b in touched], "_b int").withColumn("_mark", F.lit(True)).coalesce(1)
        whole = rows.select(*self.schema.names, self.bucket().alias("_b")).unionByName(marks, allowMissingColumns=True)
        # A bucket with a hot key may have several files, written by several tasks.
        whole = whole if many else whole.hint("rebalance", "_b")
        before = self.spark.conf.get(_WRITERS, None)
        self.spark.conf.set(_WRITERS, str(self.buckets + 1))
        try:
            whole.write.mode("overwrite").partitionBy("_b").option("compression", "zstd").parquet(f"{self.path}/_v={version}")
        finally:
            self.spark.conf.unset(_WRITERS) if before is None else self.spark.conf.set(_WRITERS, before)

    def forget(self, before: int) -> None:
        """Removes bucket versions that neither the newest state nor the one before version ``before`` needs."""
        for bucket, versions in self._versions().items():
            needed = {versions[0], next((v for v in versions if v < before), versions[0])}
            for v in set(versions) - needed:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_v={v}/_b={bucket}"), True)


_REFS = ("_to string, _key string, fk string, `table` string, record_id string, field string, value string, "
         "is_empty boolean, ref_table string")


def target_name(table: str, keys: Sequence[str]) -> str:
    return f"{table}({','.join(keys)})"


def _packed(values: Sequence[Column], dtypes: Sequence[T.DataType]) -> Column:
    return F.concat_ws(";", *[F.coalesce(pack_value(v, t), F.lit("")) for v, t in zip(values, dtypes)])


def _bytes(df: DataFrame) -> int:
    """Bytes of a frame as the planner sees them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class ReferenceIndex:
    """References and keys of a dataset under ``root``, kept up by what changes.

    Tables are taken as their last rows per key.  ``buckets`` is fixed when the index is built: choose it so that a bucket, the
    unit a change rewrites, fits a few tasks.  A reference to a table that the dataset does not have is open.
    """

    def __init__(self, spark: SparkSession, root: str, contracts: dict[str, TableContract], buckets: int = 64):
        self.spark, self.contracts, key = spark, contracts, ("_to", "_key")
        self.refs = BucketTable(spark, f"{root}/refs", _REFS, key, buckets)
        if self.refs._versions():
            raise ValueError(f"{root}: references are not kept by table, build the index again")
        self.by_table = {t: BucketTable(spark, f"{root}/refs/of={t}", _REFS, key, buckets) for t in contracts}
        self.keys = BucketTable(spark, f"{root}/keys", "_to string, _key string, n long", key, buckets)
        self.open = BucketTable(spark, f"{root}/open", _REFS, key, buckets)

    def exists(self) -> bool:
        return bool(self.open._versions())

    def references(self, only: Iterable[int] | None = None) -> DataFrame:
        """The references of all tables, of all buckets or some."""
        return union_all([self.spark.createDataFrame([], self.refs.schema), *(t.read(only) for t in self.by_table.values() if t._versions())])

    def outgoing(self, table: str, rows: DataFrame) -> DataFrame:
        """A row per reference that has to exist, of the given rows of a table."""
        contract = self.contracts[table]
        found = [references(rows, contract, fk) for fk in contract.fks]
        if any(not isinstance(f.type, str) for f in contract.fields):
            found += nested_references(rows, contract, self.contracts)
        out = []
        for refs in filter(None, found):
            field = F.lit(refs.field) if isinstance(refs.field, str) else refs.field
            rid = pack_id(refs.rows.schema, contract.key)
            empty = refs.empty if refs.empty is not None else F.lit(False)
            # An empty key is never there; filed under its own record, so that no bucket gets all of them.
            key = F.when(empty, rid).otherwise(_packed([F.col(v) for v in refs.values], [refs.rows.schema[v].dataType for v in refs.values]))
            out.append(refs.rows.select(
                F.lit(target_name(refs.fk.ref_table, refs.fk.ref_keys)).alias("_to"), key.alias("_key"), F.lit(refs.fk.name).alias("fk"),
                F.lit(table).alias("table"), rid.alias("record_id"), field.alias("field"),
                F.when(~empty, refs.text).alias("value"), empty.alias("is_empty"), F.lit(refs.fk.ref_table).alias("ref_table")))
        return union_all(out) if out else self.spark.createDataFrame([], self.refs.schema)

    def _asked_keys(self, table: str) -> list[tuple[str, ...]]:
        """The key sets of ``table`` that foreign keys point at."""
        fks = [fk for c in self.contracts.values() for fk in c.fks]
        for c in self.contracts.values():
            fks += [fk for struct in C.structs_of(c) for fk in struct.fks]
        return list(dict.fromkeys(fk.ref_keys for fk in fks if fk.ref_table == table and not fk.to_many))

    def incoming(self, table: str, rows: DataFrame, sign: int = 1) -> DataFrame:
        """(_to, _key, n) of the keys that the rows answer to."""
        out = []
        for keys in self._asked_keys(table):
            dtypes = [rows.schema[k].dataType for k in keys]
            values = [key_value(F.col(k), t) for k, t in zip(keys, dtypes)]
            out.append(rows.select(F.lit(target_name(table, keys)).alias("_to"), _packed(values, dtypes).alias("_key"),
                                   F.lit(sign).cast("long").alias("n")))
        return union_all(out) if out else self.spark.createDataFrame([], self.keys.schema)

    def build(self, dataset: Dataset, version: int = 0) -> "ReferenceIndex":
        """Files all references and keys of a dataset."""
        every = range(self.refs.buckets)
        for name in dataset.names():
            refs = self.outgoing(name, dataset.frames[name])
            self.by_table[name].write(version, refs, every, _bytes(refs) > _MANY)
        none = self.spark.createDataFrame([], self.keys.schema)
        keys = union_all([none, *(self.incoming(n, dataset.frames[n]) for n in dataset.names())])
        self.keys.write(version, keys.groupBy("_to", "_key").agg(F.sum("n").alias("n")), every)
        self._reopen(version, every)
        return self

    def _reopen(self, version: int, touched: Sequence[int]) -> None:
        refs, keys = self.references(touched), self.keys.read(touched)
        t, k = F.col("_to").alias("_t"), F.col("_key").alias("_k")
        on = (F.col("_to") == F.col("_t")) & (F.col("_key") == F.col("_k"))
        # Keys are compared once each; references move only to keys that are missing.
        asked = refs.where("not is_empty").select("_to", "_key").distinct()
        missing = cut(asked.join(keys.select(t, k), on, "left_anti").select(t, k), "missing")
        # As many targets as foreign keys name; references to others do not move at all.
        targets = [r[0] for r in missing.select("_t").distinct().collect()]
        lost = refs.where(~F.col("is_empty") & F.col("_to").isin(targets)).join(missing, on, "left_semi")
        self.open.write(version, lost.unionByName(refs.where("is_empty")), touched)

    def change(self, changes: Sequence[tuple[str, DataFrame, DataFrame]], version: int) -> list[int]:
        """Follows ``(table, removed rows, added rows)`` changes; an updated record is in both.  Returns the touched buckets.

        ``version`` is higher than any before; running one again gives the same.
        """
        gone = cut(union_all(self.outgoing(t, old) for t, old, _ in changes).select(*self.refs.key, "table", "record_id"), "refs-gone")
        new = cut(union_all(self.outgoing(t, added) for t, _, added in changes), "refs-new")
        delta = union_all(d for t, old, added in changes for d in (self.incoming(t, old, -1), self.incoming(t, added)))
        delta = cut(delta.groupBy("_to", "_key").agg(F.sum("n").alias("n")).where("n <> 0"), "keys-delta")
        touched = self.refs.buckets_of(gone, new, delta)
        if not touched:
            return []
        owners = gone.select(F.col("table").alias("_t"), F.col("record_id").alias("_r")).distinct()
        on = (F.col("table") == F.col("_t")) & (F.col("record_id") == F.col("_r"))
        for name in {t: None for t, _, _ in changes}:
            # Of other tables' references and other targets' keys nothing changes.
            store, mine = self.by_table[name], new.where(F.col("table") == name)
            where = store.buckets_of(gone.where(F.col("table") == name), mine)
            if where:
                kept = store.read(where, version).join(owners.where(F.col("_t") == name), on, "left_anti")
                store.write(version, kept.unionByName(mine), where, store.size(where, version) > _MANY)
        many = self.keys.size(touched, version) > _MANY
        targets = F.col("_to").isin(*{target_name(t, keys) for t, _, _ in changes for keys in self._asked_keys(t)})
        keys = self.keys.read(touched, version)
        added = keys.where(targets).unionByName(delta).groupBy("_to", "_key").agg(F.sum("n").alias("n")).where("n > 0")
        self.keys.write(version, keys.where(~targets).unionByName(added), touched, many)
        self._reopen(version, touched)
        return touched

    def support(self) -> DataFrame:
        """(target, key, referrers, there): per key that is pointed at, how often, and whether it exists."""
        refs = self.references().where("not is_empty").groupBy("_to", "_key").agg(F.count("*").alias("referrers"))
        return refs.join(self.keys.read(), ["_to", "_key"], "left").select(
            F.col("_to").alias("target"), F.col("_key").alias("key"), "referrers", F.col("n").isNotNull().alias("there"))

    def errors(self, only: Iterable[int] | None = None) -> DataFrame:
        """Open references as error rows, of all buckets or some."""
        kind = F.when(F.col("is_empty"), C.REF_EMPTY).otherwise(C.REF_NOT_FOUND)
        parts = {"err_type": kind, "level": F.lit("error"), "table": F.col("table"), "record_id": F.col("record_id"), "field": F.col("field"),
                 "value": F.col("value"), "lineage": F.lit(None), "msg": F.concat(kind, F.lit(" "), F.col("fk"), F.lit(" -> "), F.col("ref_table"))}
        return self.open.read(only).select(*[parts[c].cast("string").alias(c) for c in ERROR_COLUMNS])

    def forget(self, before: int) -> None:
        for table in (*self.by_table.values(), self.keys, self.open):
            table.forget(before)
