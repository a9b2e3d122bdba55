"""JSON record files and file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as C
from ..contract import TableContract, error_rows
from ..functions.scalars import trim_space
from ..operators.typed import json_to_typed

# File extensions and what they hold.
FORMATS = {"txt": "tsv", "csv": "csv", "xls": "excel", "xlsx": "excel", "cfg": "cfg", "json": "json",
           "parquet": "parquet"}


# The table's folder in a path, and packs, which are files below a folder ``pack=...`` in it.
_FOLDER = r"/_([A-Za-z][^/]*)/(?:[^/]+=[^/]*/)*[^/]*$"
_PACK = r"/_[A-Za-z][^/]*/(?:[^/]+=[^/]*/)*pack=[^/]*/(?:[^/]+=[^/]*/)*[^/]*$"


def pack_line(text: Column) -> Column:
    """The line that holds a document in a pack, whatever the text is."""
    return F.to_json(F.array(text))


def documents_of(files: DataFrame) -> DataFrame:
    """``_table`` from the folder ``_a_b`` -> ``a.b``; ``name=value`` folders below it are
    partitions of the same table.  Files outside such folders are dropped.

    A file holds one document; a pack (below a folder ``pack=...``) holds one per line, blank lines left out, and has to fit
    a row.  A line is the document itself or, as line breaks need, its text in a JSON array (`pack_line`).  ``_file`` of
    a document in a pack ends with ``#`` and its line number, later ones sorting behind earlier ones.
    """
    df = files.select(F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_modification_time").alias("_modified"), F.col("value").alias("text"))
    folder = F.regexp_extract("_file", _FOLDER, 1)
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("n"), line.alias("text")))
    entries = F.when(F.col("_file").rlike(_PACK), F.filter(lines, lambda x: trim_space(x["text"]) != "")).otherwise(
        F.array(F.struct(F.lit(0).alias("n"), F.col("text").alias("text"))))
    df = df.where(folder != "").select("_file", "_modified", F.replace(folder, F.lit("_"), F.lit(".")).alias("_table"), F.explode(entries).alias("_d"))
    packed, text = F.col("_d.n") > 0, F.col("_d.text")
    name = F.when(packed, F.concat("_file", F.lit("#"), F.lpad(F.col("_d.n").cast("string"), 9, "0"))).otherwise(F.col("_file"))
    plain = F.coalesce(F.get(F.from_json(F.when(packed, text), "array<string>"), 0), text)
    return df.select(name.alias("_file"), "_modified", plain.alias("text"), "_table")


def _record_files(spark: SparkSession, path: str) -> DataFrame:
    """The folders are named by a pattern because Spark skips names with a leading underscore when it lists on its own."""
    return spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option(
        "ignoreMissingFiles", "true").text(f"{path}/_*", wholetext=True)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document below ``path``, see `documents_of`."""
    return documents_of(_record_files(spark, path))


def read_json_records(spark: SparkSession, path: str, contract: TableContract) -> tuple[DataFrame, DataFrame]:
    """(typed records with ``_file`` and ``_modified``, errors).

    A file that is not JSON gives one error and the table's default record; a file that
    is listed but cannot be read gives an error only.
    """
    files = _record_files(spark, path)
    docs = documents_of(files).where(F.col("_table") == contract.name)
    typed, errors = json_to_typed(docs, "text", contract, keep=["_file", "_modified"])
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        f"{path}/_{contract.name.replace('.', '_')}").select(_plain_path("path").alias("_path"))
    lost = listed.join(files.select(_plain_path("_metadata.file_path").alias("_read")), F.col("_path") == F.col("_read"), "left_anti")
    return typed, errors.unionByName(error_rows(lost, C.JSON_FILE_READ, contract.name, None, None, None, F.col("_path")))


def _plain_path(name: str):
    return F.regexp_replace(name, "^file:/+", "file:/")


def file_manifest(spark: SparkSession, root: str, tsv_dirs: tuple[str, ...] = ()) -> DataFrame:
    """``(path, fmt, modified, length)`` of data files; names starting with ~ or . are
    ignored, and text files count only inside the declared folders."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "modificationTime", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    fmt = F.lit(None).cast("string")
    for e, f in FORMATS.items():
        fmt = F.when(ext == e, f).otherwise(fmt)
    base = root.rstrip("/") + "/"
    rel = F.element_at(F.split("path", "\\Q" + base + "\\E", 2), -1)
    in_tsv = F.lit(False)
    for d in tsv_dirs:
        in_tsv = in_tsv | rel.startswith(d.rstrip("/") + "/")
    rows = files.select(rel.alias("path"), fmt.alias("fmt"), F.col("modificationTime").alias("modified"), "length", name.alias("_name"), in_tsv.alias("_tsv"))
    return rows.where(F.col("fmt").isNotNull() & ~F.col("_name").rlike("^[~.]") & ((F.col("fmt") != "tsv") | F.col("_tsv"))).drop("_name", "_tsv")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)``: added, removed or changed by modification time."""
    o = old.select("path", F.col("modified").alias("_old"))
    n = new.select("path", F.col("modified").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    both = o.join(n, "path", "full_outer")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("path", change.alias("change"))
