"""Repeated lines: sorted streams of line hashes find first occurrences, documents get keep bitmaps.

Lines become (hash, document, position) rows.  They are range-partitioned and sorted by all
three, so the first document of a run of equal hashes is the one that keeps the line, and a
hash that fills many partitions is split between them.  A task streams its rows and holds
one run's first document.  Only a task's first run can have begun in an earlier task: its rows
go out as open, and one row per task and edge tells which document came first.  What comes
back per document is a deflated bitmap of the lines that stay; texts take part again only
where a bitmap is applied.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .base import as_row, fresh, order_id, starts
from .quality_rules import SPACE, code_points, with_length


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return line.strip(SPACE).lower()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sum, text): an id with its text's 64-bit sum names a document; null ids count as the largest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(order_id(F.col(id_col).cast("long")).alias("doc_id"), F.xxhash64(text).alias("sum"),
                       text.cast("binary").alias("text"))


_LINES = "high long, low long, doc_id long, sum long, position int"
_ARROW_LINES = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("sum", pa.int64()),
                          ("position", pa.int32())])


def line_hashes(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points: 128 bits of its BLAKE2b digest, document, position."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owner, position = [], [], []
            for row, text in enumerate(batch.column(2)):
                for k, line in enumerate(text.as_py().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and code_points(key) >= min_chars:
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        owner.append(row)
                        position.append(k)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner = np.array(owner, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(pa.array(owner)),
                 batch.column(1).take(pa.array(owner)), pa.array(position, pa.int32())], schema=_ARROW_LINES)

    return _keyed(docs, id_col, text_col).mapInArrow(run, _LINES)


#: kind 0: a line to drop; 1: a line of a task's first run; 2: first document of a run at a task's edge.
_FOUND = "kind int, " + _LINES


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the lines after the first document of each run, in sorted order."""
    schema = pa.schema([("kind", pa.int32()), *_ARROW_LINES])
    run, first_doc, first_run = None, 0, True  # the run at hand, its first document, whether it opened the task
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, doc = (batch.column(i).to_numpy() for i in range(3))
        begin = starts(high) | starts(low)
        begin[0] = run != (high[0], low[0])
        at = np.flatnonzero(begin)
        edges = []
        if run is None:
            edges.append((high[0], low[0], doc[0]))
        elif begin[0] and first_run:
            first_run = False
        which = np.cumsum(begin) - 1  # -1: still the run from before
        firsts = np.where(which < 0, first_doc, doc[at[which]] if len(at) else first_doc)
        opening = np.zeros(len(high), bool)
        if run is None:
            opening = which == 0
        elif first_run:
            opening = which < 0
        kind = np.where(opening, 1, 0)
        pick = opening | (doc != firsts)
        keep = batch.filter(pa.array(pick))
        yield pa.RecordBatch.from_arrays([pa.array(kind[pick], pa.int32()), *keep.columns], schema=schema)
        if run is None:
            first_run = len(at) == 1
        elif first_run and len(at):
            first_run = False
        if len(at):
            first_doc = doc[at[-1]]
        run = (high[-1], low[-1])
        if edges:
            yield _edge(edges[0], schema)
    if run is not None:
        yield _edge((*run, first_doc), schema)


def _edge(row: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": 2, "high": int(row[0]), "low": int(row[1]), "doc_id": int(row[2]),
                                        "sum": 0, "position": 0}], schema=schema)


def repeated_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sum, position) of every line that a smaller document has too."""
    lines = cut(line_hashes(docs, min_chars, id_col, text_col), "line-hashes")
    order = ["high", "low", "doc_id", "sum", "position"]
    found = cut(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, _FOUND), "repeated-lines")
    # Two rows per task at most, whatever the tables hold.
    edges = found.where("kind = 2").groupBy("high", "low").agg(F.min("doc_id").alias("first"))
    late = (found.where("kind = 1").join(F.broadcast(edges), ["high", "low"]).where("doc_id != first"))
    return found.where("kind = 0").select("doc_id", "sum", "position").union(late.select("doc_id", "sum", "position"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sum, n_dropped, bitmap) of the documents that lose lines.

    Bit k of the inflated ``bitmap`` (least significant bit first) is 1 if line k stays; lines
    behind its end stay.  ``sum`` is xxhash64 of the text, so documents sharing an id keep
    apart; an array of positions is as long as one document's lines.
    """
    @F.pandas_udf("binary")
    def bitmap(positions):
        def one(drop):
            bits = np.ones((int(max(drop)) // 8 + 1) * 8, np.uint8)
            bits[drop] = 0
            return zlib.compress(np.packbits(bits, bitorder="little").tobytes())
        return positions.map(one)

    # distinct: rows repeated as a whole would name a line twice.
    dropped = (repeated_lines(docs, min_chars, id_col, text_col).groupBy("doc_id", "sum")
               .agg(F.collect_set("position").alias("positions")))
    return dropped.select("doc_id", "sum", F.size("positions").cast("long").alias("n_dropped"),
                          bitmap("positions").alias("bitmap"))


def kept_lines(text: bytes, bitmap: bytes | None) -> bytes:
    """The text without the lines whose bit is 0."""
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return b"\n".join(line for k, line in enumerate(lines) if k >= len(bits) or bits[k])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, n_dropped, bitmap): all columns of ``docs`` in ``row``, nulls where every line stays."""
    keyed = as_row(docs, doc_id=order_id(F.col(id_col).cast("long")), sum=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # The narrow side is built, so whole texts are moved once and never sorted.
    return keyed.join(bitmaps.hint("shuffle_hash"), ["doc_id", "sum"], "left").select("row", "n_dropped", "bitmap")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text",
                        length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines that a smaller document has; all columns and rows stay.

    A line's key is stripped of ASCII white space and lower-cased in A-Z; keys under
    ``min_chars`` code points always stay.  The smallest id that holds a key keeps all its lines.  Null
    and empty texts are one empty line and stay as they are.  Rows with one id are one
    document; a null id counts as the largest.  ``length_col`` follows the text.
    """
    joined = _with_bitmaps(docs, keep_bitmaps(docs, min_chars, id_col, text_col), id_col, text_col)
    joined = joined.select("row.*", F.col("bitmap").alias(fresh(docs, "bitmap")))
    n = len(docs.columns)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps, field = batch.column(n), batch.schema.field(at)
            texts = [t.as_py() if not b.is_valid or not t.is_valid
                     else kept_lines(t.as_py().encode(), b.as_py()).decode() for t, b in zip(batch.column(at), bitmaps)]
            yield batch.set_column(at, field, pa.array(texts, field.type)).select(list(range(n)))

    return with_length(joined.mapInArrow(run, docs.schema), text_col, length_col)


def line_report(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, bitmap) per row; bitmap null where every line stays."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = _with_bitmaps(narrow, keep_bitmaps(narrow, min_chars), "doc_id", "text")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, bitmap binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                       ("kept_sha256", pa.string()), ("bitmap", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, dropped, sums = [], [], []
            for text, lost, bitmap in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = text.as_py() or b""
                n_lines.append(data.count(b"\n") + 1)
                dropped.append(lost.as_py() or 0)
                sums.append(hashlib.sha256(kept_lines(data, bitmap.as_py())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()),
                                              pa.array(sums, pa.string()), batch.column(3)], schema=arrow)

    return joined.select("row.doc_id", F.col("row.text").cast("binary").alias("text"), "n_dropped", "bitmap").mapInArrow(run, schema)
