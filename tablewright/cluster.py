"""Helpers for running on a cluster: shared scratch tables and global positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tablewright-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tablewright/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Lost executors cannot take it away, loops keep a flat lineage, and the planner sees
    its exact size, so whether it is broadcast is decided by measured bytes.  ``by`` lays
    the files out by a column with few values, for reads that want some of them.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, order_by: Sequence[str | Column], name: str = "_pos",
                  label: str = "position") -> DataFrame:
    """Global 0-based row position without sending all rows through one task.

    Rows are range-partitioned and sorted; the id inside each partition comes from
    ``monotonically_increasing_id`` (partition in the upper bits, rank in the lower 33).
    Only one count per partition is summed in a single-task window.
    ``order_by`` has to be a total order for the result to be unique.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    stored = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_mono", F.monotonically_increasing_id()), label)
    part = F.shiftright("_mono", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    # One row per partition of the write: bounded by spark.sql.shuffle.partitions.
    return (stored.withColumn("_part", part).join(F.broadcast(base), "_part")
            .withColumn(name, F.col("_base") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_base", "_mono"))


def running_last(df: DataFrame, value: Column, group: Sequence[str], position: str,
                 name: str, chunk: int = 1 << 16) -> DataFrame:
    """Largest non-null ``value`` at or above each row of its group, in ``position`` order.

    ``value`` must not decrease with the position.  The scan runs per chunk of
    positions, and one row per chunk carries the state on, so a group as big as the
    whole table still spreads over all tasks.
    """
    rows = df.withColumn("_v", value).withColumn(
        "_chunk", F.floor(F.col(position) / F.lit(chunk)).cast("long"))
    keys = [*group, "_chunk"]
    carry = rows.groupBy(*keys).agg(F.max("_v").alias("_top"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*keys, F.max("_top").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_seen", F.max("_v").over(inside)).join(carry, keys)
            .withColumn(name, F.greatest("_seen", "_carry"))
            .drop("_v", "_seen", "_carry", "_chunk"))


class Scratch:
    """Written tables of one operator, each of which can go as soon as nothing reads it any more.

    Shuffle files of a write go with it: nothing runs the same frame twice.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        before = self.spark.conf.get(self._CLEAN, None)
        self.spark.conf.set(self._CLEAN, "true")
        path = scratch_path(self.spark, label)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self._CLEAN)
            else:
                self.spark.conf.set(self._CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, frame: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(frame)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
