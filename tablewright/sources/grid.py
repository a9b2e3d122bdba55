"""Untyped grids: CSV/TSV files as rows of trimmed text cells.

A grid frame has ``_file``, ``_row`` (0-based line of the file), ``cells`` and, once
named, ``_table`` and ``_shard``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import cut
from ..contract import TableContract, column_of, field_span, span, ListOf, MapOf
from ..functions.packed import cast_text
from ..functions.scalars import trim_space

# Header layouts as (rows, comment row, name row, type row).
LAYOUTS = {2: (2, 0, 1, None), 3: (3, 0, 1, None), 4: (4, 3, 0, 1)}

# Type words of a four-row header.
SUGGESTED_TYPES = {
    "INT": "int", "SHORT": "int", "BYTE": "int",
    "LONG": "long", "INT64": "long",
    "FLOAT": "float",
    "BOOL": "bool",
    "STRING": "str", "SLICEBYTE": "str", "HASHID": "str",
}

# The Han ranges that end the code part of a file name.
HAN = "[\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff]"

HEADER_WARNING = "SplitDataHeaderNotEqual"


def read_grid(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "GBK",
              detect_bom: bool = True, multi_line: bool = True, width: int | None = None) -> DataFrame:
    """Read files as grids.  A UTF-8 byte order mark overrides ``encoding``.

    ``multi_line=False`` lets big files without line breaks inside cells be split over
    tasks.  The number of columns comes from a look at the separators of all lines; should
    a record still be wider, the read starts over with more columns, so no cell is lost.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    paths = [path] if isinstance(path, str) else list(path)
    width = width or _widest(spark, paths, sep)
    groups = [(encoding, paths)]
    if detect_bom:
        groups = _by_encoding(spark, paths, encoding)
    while True:
        raw = None
        for enc, files in groups:
            part = _read_cells(spark, files, sep, enc, multi_line, width)
            raw = part if raw is None else raw.unionByName(part)
        stored = cut(raw.withColumn("_mono", F.monotonically_increasing_id()), "grid")
        if stored.where("_over").isEmpty():
            return _number_rows(stored)
        width *= 2


def _widest(spark, paths, sep: str) -> int:
    """Most separators on one line, plus one; parsing only that many columns is far
    cheaper than parsing a generous fixed number."""
    lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    count = F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit("")))
    return (lines.agg(F.max(count)).first()[0] or 0) + 1


def _by_encoding(spark, paths, encoding):
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("length")
    if not sizes.where(F.col("length") >= (1 << 31) - 1).isEmpty():
        raise ValueError("a file is too big to look for a byte order mark: pass its encoding and detect_bom=False")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select("path", (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom")))
    # One row per file; contents stay on the executors.
    marked = files.collect()
    with_bom = [r["path"] for r in marked if r["bom"]]
    if not with_bom:
        return [(encoding, paths)]
    plain = [r["path"] for r in marked if not r["bom"]]
    return [g for g in (("UTF-8", with_bom), (encoding, plain)) if g[1]]


def _read_cells(spark, files, sep, encoding, multi_line, width):
    names = [f"c{i}" for i in range(width)]
    # One more column shows that a line holds more cells than were asked for.
    schema = ", ".join(f"{n} string" for n in [*names, "c_over"])
    df = (spark.read.schema(schema).option("sep", sep).option("header", "false").option("multiLine", str(multi_line).lower())
          .option("maxColumns", max(20480, width + 1)).option("encoding", encoding).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
          .option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true")
          .option("nullValue", "\u0000").option("emptyValue", "").option("recursiveFileLookup", "true").csv(files))
    # An empty cell and one beyond the end of the line both read as NULL, so the end is
    # the last filled cell; reading beyond it gives an empty cell anyway.
    row = F.array(*names)
    used = F.array_max(F.transform(row, lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0)))
    given = F.transform(F.slice(row, 1, used), lambda c: F.coalesce(c, F.lit("")))
    # A byte order mark is white space too.
    clean = F.transform(given, trim_space)
    return df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     clean.alias("cells"), F.col("c_over").isNotNull().alias("_over"))


def _number_rows(stored: DataFrame) -> DataFrame:
    """Line number inside the file: rank inside its block plus the rows of earlier blocks."""
    blocks = stored.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    ahead = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its measured size (a row per file block) decides on broadcasting.
    blocks = cut(blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base")), "blocks")
    return stored.join(blocks, ["_file", "_block"]).select(
        "_file", (F.col("_mono") - F.col("_first") + F.col("_base")).alias("_row"), "cells")


def cell(i: int) -> Column:
    """Cell ``i``; beyond the end of the row it is empty."""
    return F.coalesce(F.get("cells", i), F.lit(""))


def code_name(part: Column) -> Column:
    """Lower-cased ASCII head of a file or folder name; NULL when it starts otherwise."""
    stem = F.regexp_extract(part, r"^([^.]*)", 1)
    return F.when(part.rlike("^[A-Za-z]"), F.lower(F.regexp_replace(stem, f"_?{HAN}.*$", "")))


def with_table_name(grid: DataFrame, root: str, by_folder: bool = False) -> DataFrame:
    """Add ``_table`` and ``_shard`` from the path below ``root``.

    Path parts give code names joined by dots; a trailing ``_<int>`` is the shard number.
    Files with a part that does not start with a letter are dropped.  ``by_folder``
    names tables after their folder, for shards that are folders of part files; a
    partition folder ``name=value`` goes by its value.
    """
    # Written first: a test of the names would else be made on every row, before they are told apart.
    files = cut(grid.select("_file").distinct(), "files")
    rel = F.element_at(F.split(F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B"))),
                               _quote(root.rstrip("/") + "/"), 2), -1)
    parts = F.filter(F.split(rel, r"[/\\]"), lambda p: p != "")
    if by_folder:
        parts = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.regexp_replace(p, "^[^=]*=", ""))
    names = F.transform(parts, code_name)
    full = F.array_join(names, ".")
    tail = F.regexp_extract(full, r"_\s*([+-]?\d+)[^_]*$", 1)
    head = F.regexp_extract(full, r"^(.*)_[^_]*$", 1)
    named = (files.where(~F.exists(names, lambda n: n.isNull()))
             .select("_file", trim_space(F.when(tail != "", head).otherwise(full)).alias("_table"),
                     F.coalesce(tail.try_cast("int"), F.lit(0)).alias("_shard")))
    # Names are worked out once per file; rows pick them up from the small written list.
    return grid.join(cut(named, "names"), "_file")


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def transpose_columns(grid: DataFrame, keep: Sequence[str] = ("_file",)) -> DataFrame:
    """Swap rows and columns of tables written sideways.

    A group is one logical row: as many cells as the table has fields.
    """
    width = grid.groupBy(*keep).agg(F.max(F.size("cells")).alias("_w"))
    padded = grid.join(width, list(keep)).select(*keep, "_row", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))).alias("_c", "_cell"))
    turned = padded.groupBy(*keep, "_c").agg(F.sort_array(F.collect_list(F.struct("_row", "_cell"))).alias("_x"))
    return turned.select(*keep, F.col("_c").cast("long").alias("_row"), F.col("_x._cell").alias("cells"))


def header_of(grid: DataFrame, layout: int = 2) -> DataFrame:
    """One row per file: ``columns`` as array of (index, name, comment, type).

    Names end at the first of ``. , @``; unnamed columns are left out.
    """
    rows, comment_row, name_row, type_row = LAYOUTS[layout]
    pick = lambda r: F.max(F.when(F.col("_row") == r, F.col("cells")))
    extra = [c for c in ("_table", "_shard") if c in grid.columns]
    head = grid.where(F.col("_row") < rows).groupBy("_file", *extra).agg(
        pick(comment_row).alias("comments"), pick(name_row).alias("names"),
        (pick(type_row) if type_row is not None else F.lit(None).cast("array<string>")).alias("types"))

    def column(name, i):
        clean = trim_space(F.regexp_extract(name, r"^([^.,@]*)", 1))
        note = F.regexp_replace(F.coalesce(F.get("comments", i), F.lit("")), "\r\n|\r|\n", "--")
        note = trim_space(F.when((i == 0) & note.startswith("#"), note.substr(F.lit(2), F.length(note))).otherwise(note))
        note = F.when(F.lower(note) == F.lower(clean), "").otherwise(note)
        return F.struct(i.alias("index"), clean.alias("name"), note.alias("comment"),
                        F.coalesce(F.get("types", i), F.lit("")).alias("type"))

    # Trailing empty names do not belong to the header.
    last = F.array_max(F.transform("names", lambda n, i: F.when(n != "", i + 1).otherwise(0)))
    head = head.withColumn("names", F.slice("names", 1, last))
    columns = F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), column), lambda c: c["name"] != "")
    return head.select("_file", *extra, columns.alias("columns"), "names")


@dataclass
class Split:
    header: DataFrame
    body: DataFrame


def split_header(grid: DataFrame, layout: int = 2) -> Split:
    """Header per file, and the rows below it reduced to the named columns.

    ``_first`` keeps the physical first cell for the comment rule.
    """
    header = cut(header_of(grid, layout), "header")
    kept = header.select("_file", F.col("columns.index").alias("_kept"))
    body = grid.where(F.col("_row") >= LAYOUTS[layout][0]).join(kept, "_file")
    cells = F.transform("_kept", lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    rest = [c for c in grid.columns if c not in ("cells",)]
    return Split(header, body.select(*rest, cell(0).alias("_first"), cells.alias("cells")))


def drop_comment_and_blank_rows(body: DataFrame) -> DataFrame:
    first = F.col("_first") if "_first" in body.columns else cell(0)
    return body.where(~first.startswith("#") & F.exists("cells", lambda c: c != "")).drop("_first")


def union_shards(grid: DataFrame, table: str, layout: int = 2) -> tuple[list[dict], DataFrame, DataFrame]:
    """(header of the first shard, rows of all shards, warnings for headers that differ).

    Row order is (``_shard``, ``_file``, ``_row``).
    """
    split = split_header(grid.where(F.col("_table") == table), layout)
    first = split.header.orderBy("_shard", "_file").limit(1)
    columns = [c.asDict() for r in first.collect() for c in r["columns"]]
    lead = first.select(F.col("_file").alias("_f"), F.col("names").alias("_n"), F.lit(1).alias("_one"))
    others = split.header.withColumn("_one", F.lit(1)).join(lead, "_one")
    warnings = others.where(~F.col("names").eqNullSafe(F.col("_n"))).select(
        F.lit(HEADER_WARNING).alias("err_type"), F.lit("warning").alias("level"), F.lit(table).alias("table"),
        F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("string").alias("field"),
        F.array_join("names", ",").alias("value"), F.col("_file").alias("lineage"),
        F.concat(F.lit("differs from "), F.array_join("_n", ",")).alias("msg"))
    return columns, drop_comment_and_blank_rows(split.body), warnings


def ingest_profile(grid: DataFrame, layout: int = 2) -> DataFrame:
    """Counts per table: files, columns, data rows, ignored rows, cells by kind."""
    split = split_header(grid, layout)
    header = split.header.groupBy("_table").agg(
        F.count("*").alias("files"), F.sum(F.size("columns")).alias("columns"),
        F.sum(F.size(F.coalesce("names", F.array().cast("array<string>"))) - F.size("columns")).alias("ignored_columns"))
    comment = F.col("_first").startswith("#")
    blank = ~comment & ~F.exists("cells", lambda c: c != "")
    kept = ~comment & ~blank
    amount = lambda test: F.sum(F.when(kept, F.size(F.filter("cells", test))).otherwise(0))
    number = lambda c: c.rlike(r"^[+-]?\d+(\.\d+)?$")
    rows = split.body.groupBy("_table").agg(
        F.count_if(kept).alias("rows"), F.count_if(comment).alias("comment_rows"), F.count_if(blank).alias("blank_rows"),
        amount(lambda c: c == "").alias("empty_cells"), amount(number).alias("number_cells"),
        amount(lambda c: (c != "") & ~number(c)).alias("text_cells"))
    counts = ["rows", "comment_rows", "blank_rows", "empty_cells", "number_cells", "text_cells"]
    out = header.join(rows, "_table", "left")
    return out.select(F.col("_table").alias("table"), "files", "columns", "ignored_columns",
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
                      (F.coalesce("rows", F.lit(0)) == 0).alias("is_empty"))


def header_drift(grid: DataFrame, contracts: dict[str, TableContract], layout: int = 2) -> DataFrame:
    """Every file's header against its table's contract.

    Rows ``(table, file, column, status, suggested_type, bad_values)`` with status
    matched, grouped (a column of a repeated field), extra, missing, duplicate,
    not_identifier, or unknown_table.
    """
    split = split_header(grid, layout)
    found = split.header.select("_file", "_table", F.explode("columns").alias("c")).select(
        F.col("_table").alias("table"), F.col("_file").alias("file"), F.col("c.index").alias("index"),
        F.col("c.name").alias("column"), F.col("c.type").alias("word"))
    names, grouped = [], []
    for c in contracts.values():
        for f in c.fields:
            names.append((c.name, f.name))
            for member in _group_columns(f):
                grouped.append((c.name, member, f.name))
    spark = grid.sparkSession
    # Contract sized: one row per declared column.
    wanted = spark.createDataFrame(names, "table string, column string")
    members = spark.createDataFrame(grouped or [("", "", "")], "table string, column string, owner string")
    known = spark.createDataFrame([(n,) for n in contracts], "table string").withColumn("_known", F.lit(True))
    word = F.upper("word")
    kind = F.lit("str")
    for text, name in SUGGESTED_TYPES.items():
        kind = F.when(word == text, name).otherwise(kind)
    cols = (found.join(wanted.withColumn("_own", F.lit(True)), ["table", "column"], "left")
            .join(members, ["table", "column"], "left").join(known, "table", "left"))
    repeats = found.groupBy("table", "file", "column").agg(F.count("*").alias("_n"), F.min("index").alias("_first"))
    cols = cols.join(repeats, ["table", "file", "column"])
    status = (F.when(F.col("_known").isNull(), "unknown_table")
              .when(F.col("index") > F.col("_first"), "duplicate")
              .when(F.col("_own"), "matched").when(F.col("owner").isNotNull(), "grouped")
              .when(~F.col("column").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "not_identifier").otherwise("extra"))
    cells = drop_comment_and_blank_rows(split.body).join(
        split.header.select("_file", F.col("columns.name").alias("_names")), "_file")
    types = {(c.name, f.name): f.type for c in contracts.values() for f in c.fields if isinstance(f.type, str)}
    bad = cells.select("_file", "_table", F.explode(F.arrays_zip(F.col("_names").alias("n"), F.col("cells").alias("v"))).alias("x"))
    fits = F.lit(True)
    for (table, name), t in types.items():
        here = (F.col("_table") == table) & (F.col("x.n") == name)
        fits = F.when(here, (F.col("x.v") == "") | cast_text(F.col("x.v"), t).isNotNull()).otherwise(fits)
    bad = bad.groupBy(F.col("_file").alias("file"), F.col("x.n").alias("column")).agg(F.count_if(~fits).alias("bad_values"))
    have = cols.withColumn("status", status).join(bad, ["file", "column"], "left").select(
        "table", "file", "column", "status", kind.alias("suggested_type"),
        F.coalesce("bad_values", F.lit(0)).alias("bad_values"))
    seen = cols.select("table", "file", F.coalesce("owner", "column").alias("column")).distinct()
    files = split.header.select(F.col("_table").alias("table"), F.col("_file").alias("file"))
    missing = files.join(wanted, "table").join(seen, ["table", "file", "column"], "left_anti").select(
        "table", "file", "column", F.lit("missing").alias("status"), F.lit(None).cast("string").alias("suggested_type"),
        F.lit(0).cast("long").alias("bad_values"))
    return have.unionByName(missing)


def _group_columns(f) -> list[str]:
    """Header names that stand for a repeated field: ``x1..xN`` of ``xList``, ``k1,v1..``."""
    if f.layout != "fix":
        return []
    if isinstance(f.type, ListOf):
        stem = f.name.removesuffix("List")
        return [f"{stem}{i + 1}" for i in range(f.width)]
    if isinstance(f.type, MapOf):
        return [f"{p}{i + 1}" for i in range(f.width) for p in ("k", "v")]
    return []
