"""A corpus made ready for training: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.cluster import cut
from tablewright.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from tablewright.llm.queries import TOKENIZER, table


#: Rows of an Arrow batch.  Texts are wide, and a batch is in memory several times, in the executor and its Python workers.
BATCH_ROWS = 2000


def lean(spark: SparkSession) -> None:
    """Small Arrow batches for this application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    lean(spark)
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document has."""
    lean(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    lean(spark)
    return simhash.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    lean(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    lean(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmarks), ("packing", sequences)]

#: Fingerprints over words, template windows and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
