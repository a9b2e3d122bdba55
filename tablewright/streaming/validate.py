"""Validate record files as they arrive.

A table's records are kept in buckets by key (`BucketTable`): a batch reads and rewrites the buckets of its own
records, under its batch number, so a batch that runs again after a failure replaces what it wrote.  References are kept
by the key they need (`ReferenceIndex`): a batch looks at the buckets of the keys that its records need or bring, and
a target that arrives late closes exactly the references filed under it.  What a batch costs follows from
its own records and the size of a bucket, not from what was stored before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import cut
from ..contract import ERROR_COLUMNS, ERROR_SCHEMA, Dataset, TableContract, union_all
from ..functions.scalars import pack_id
from ..operators.checks import _match, check_unique, last_rows
from ..operators.support import BucketTable, ReferenceIndex
from ..operators.typed import json_to_typed
from ..sources.records import documents_of

VERSION = ("_modified", "_file")
#: Buckets of a table and of the reference index.  Fixed for the life of an output folder.
BUCKETS = 64
#: A batch names its files one by one, and Spark looks them up in as many tasks as this allows: a task per file up to 10,000.
LOOKUP = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Record files under ``path`` (folders ``_a_b`` name the table ``a.b``) as a stream.

    The session looks files up in four tasks a core from here on, unless it was told another number.
    """
    if spark.conf.get(LOOKUP, None) is None:
        spark.conf.set(LOOKUP, str(4 * spark.sparkContext.defaultParallelism))
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return documents_of(reader.text(f"{path}/_*", wholetext=True))


def _stored(spark: SparkSession, out: str, contract: TableContract, buckets: int) -> BucketTable:
    schema = T.StructType([T.StructField("_file", T.StringType()), T.StructField("_modified", T.TimestampType()), *contract.schema().fields])
    return BucketTable(spark, f"{out}/{contract.name}", schema, contract.key, buckets)


def latest(spark: SparkSession, out: str, contract: TableContract, buckets: int = BUCKETS) -> DataFrame:
    """Last version of every record."""
    return _stored(spark, out, contract, buckets).read().drop("_file", "_modified")


def errors_of(spark: SparkSession, out: str) -> DataFrame:
    """Every error row ever reported, with its batch number."""
    schema = T.StructType.fromDDL(ERROR_SCHEMA).add("_batch", T.LongType())
    try:
        return spark.read.schema(schema).option("basePath", f"{out}/_errors").parquet(f"{out}/_errors")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def reference_index(spark: SparkSession, out: str, dataset: Dataset, tables: dict[str, TableContract], buckets: int = BUCKETS) -> ReferenceIndex:
    """The index of the stream's references; the keys of the fixed tables are filed when it is first opened."""
    index = ReferenceIndex(spark, f"{out}/_references", {**dataset.contracts, **tables}, buckets)
    if not index.exists():
        index.build(Dataset(dataset.contracts, dataset.frames), version=-1)
    return index


def open_reference_errors(spark: SparkSession, out: str, dataset: Dataset, tables: dict[str, TableContract], buckets: int = BUCKETS) -> DataFrame:
    """Reference errors that still hold: read from the index, where every batch closes what its records answer to."""
    return reference_index(spark, out, dataset, tables, buckets).errors().where(F.col("table").isin(*tables))


def process_batch(batch: DataFrame, batch_id: int, out: str, dataset: Dataset, tables: dict[str, TableContract],
                  on_batch: Callable[[Dataset, int], None] | None = None, buckets: int = BUCKETS) -> None:
    """Type, check and store one micro-batch.

    Errors reported with the batch are those of its own records.  Records with errors of form are not stored.
    The index follows before the records do: if a batch is cut off in between, it finds the old records again.
    """
    spark = batch.sparkSession
    index = reference_index(spark, out, dataset, tables, buckets)
    found, newest, changes = [], {}, []
    batch = cut(batch, "batch")
    for name, contract in tables.items():
        typed, errors = json_to_typed(batch.where(F.col("_table") == name), "text", contract, keep=["_file", "_modified"])
        errors = cut(errors, "errors")
        broken = errors.where(F.col("level") == "error").select(F.col("lineage").alias("_file")).distinct()
        fresh = cut(typed.join(broken, "_file", "left_anti"), "fresh")
        found += [errors, check_unique(fresh.drop("_modified").withColumn("_row", F.lit(0)), contract).select(
            *T.StructType.fromDDL(ERROR_SCHEMA).names)]
        store, rows = _stored(spark, out, contract, buckets), cut(last_rows(fresh, contract.key, VERSION), "newest")
        touched = store.buckets_of(rows)
        before = store.read(touched, batch_id)
        newest[name] = (store, rows, touched, before)
        changes.append((name, _match(before, rows.select(*contract.key), contract.key, "left_semi"), rows))
    asked = index.change(changes, batch_id)
    for name, (store, rows, touched, before) in newest.items():
        ids = rows.select(F.lit(name).alias("table"), pack_id(rows.schema, tables[name].key).alias("record_id"))
        found.append(index.errors(asked).join(ids, ["table", "record_id"], "left_semi").select(*ERROR_COLUMNS))
        key = tables[name].key
        store.write(batch_id, _match(before, rows.select(*key), key, "left_anti").unionByName(rows), touched)
    union_all(found).write.mode("overwrite").parquet(f"{out}/_errors/_batch={batch_id}")
    for store in [entry[0] for entry in newest.values()] + [index]:
        store.forget(batch_id)
    if on_batch is not None:
        frames = {**dataset.frames, **{name: latest(spark, out, contract, buckets) for name, contract in tables.items()}}
        on_batch(Dataset({**dataset.contracts, **tables}, frames), batch_id)


def stream_validate(spark: SparkSession, root: str, out: str, dataset: Dataset, tables: dict[str, TableContract],
                    checkpoint: str, on_batch: Callable[[Dataset, int], None] | None = None,
                    max_files: int | None = None, trigger: dict | None = None, buckets: int = BUCKETS):
    """Start the stream; the trigger interval is the quiet period before a reload."""
    stream = read_stream(spark, root, max_files)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, n: process_batch(df, n, out, dataset, tables, on_batch, buckets))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
