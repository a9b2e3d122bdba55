"""Inputs that Spark derives from the star tables: grids, JSON files, planted defects.

Defects are planted by key arithmetic over the whole table, so SQL can plant the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import scratch_path
from ..functions.scalars import number_text
from ..sources.records import pack_line


def text_of(df: DataFrame) -> list[Column]:
    """Every column as the text a person would type."""
    return [(number_text(f.name) if f.dataType.typeName() == "double" else F.col(f.name).cast("string")).alias(f.name)
            for f in df.schema.fields]


def write_grid(cells: DataFrame, table: str, headers: list[list[str]], order: str, encoding: str = "UTF-8",
               rows_per_shard: int = 50_000) -> str:
    """Write text rows as CSV shards ``<table>_<n>``, each with its own header rows.

    ``cells`` has the text columns plus ``order``; the shard count grows with the rows.
    """
    spark = cells.sparkSession
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    names = [c for c in cells.columns if c != order]
    shards = cells.count() // rows_per_shard + 2
    shard = F.pmod(F.xxhash64(order), F.lit(shards)).cast("int")
    body = cells.select(shard.alias("_s"), F.lit(len(headers)).alias("_h"), F.col(order).cast("string").alias("_o"),
                        *[F.coalesce(c, F.lit("")).alias(f"c{i}") for i, c in enumerate(names)])
    top = spark.range(shards).select(F.col("id").cast("int").alias("_s"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("_h"), F.lit("").alias("_o"), *[F.lit(t).alias(f"c{j}") for j, t in enumerate(h)])
        for i, h in enumerate(headers)])).alias("x")).select("_s", "x.*")
    rows = top.unionByName(body).withColumn("t", F.concat(F.lit(table + "_"), F.col("_s").cast("string")))
    path = scratch_path(spark, "grid")
    (rows.repartition("t").sortWithinPartitions("t", "_h", "_o").drop("_s", "_h", "_o")
     .write.partitionBy("t").option("encoding", encoding).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))
    return path


def write_documents(df: DataFrame, table: str, path: str | None = None, mode: str = "errorifexists",
                    files_per_task: int = 250, pack: int = 0) -> str:
    """One JSON document per id of ``df(id, text)`` below the folder of its table; rows without a key, or with the same one, share a document.

    A document has a file of its own; with ``pack``, so many share one (see `documents_of`), and what lists, opens or remembers
    files has that many fewer.  Files are written by as many tasks as they need, however few bytes they hold.  Each task has a folder
    of its own, so the commit moves a folder per task and a reader lists as many.
    """
    path = path or scratch_path(df.sparkSession, "json")
    tasks = df.count() // (10 * pack or files_per_task) + 1
    # A number of partitions that is given stays: small ones would else be put into one task.
    lines = F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n").alias("text")
    docs = df.repartition(tasks, "id").groupBy("id").agg(lines)
    folder = F.concat(F.lit(uuid.uuid4().hex + "-"), F.spark_partition_id().cast("string"))
    name = "pack" if pack else "task"
    # The line break that ends a file belongs to its text.
    text = pack_line(F.concat("text", F.lit("\n"))) if pack else F.col("text")
    (docs.select(folder.alias(name), text.alias("text")).write.mode(mode).partitionBy(name).option("maxRecordsPerFile", pack or 1)
     .text(f"{path}/_{table.replace('.', '_')}"))
    return path
