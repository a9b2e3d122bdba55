"""What several operators need: narrow inputs, Arrow batches, text helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A null id stands for the largest id there is.
NULL_ID = (1 << 63) - 1


def ids_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the id as long and the text's UTF-8 bytes, whatever else ``docs`` holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def order_id(column: str | Column = "doc_id") -> Column:
    """The id with null as the largest."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID))


_KEPT: dict = {}


def kept(key, make: Callable):
    """``make()``, kept by the worker process for its next tasks.

    Only what was asked for last stays, so the dictionaries of an application's stages do not add up.
    """
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Gives back what ``kept`` holds, and the memory of Arrow batches that are gone."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def per_text(docs: DataFrame, schema: str, fn: Callable[[bytes], tuple], id_col: str = "doc_id",
             text_col: str = "text", rows_out: int = 10_000) -> DataFrame:
    """One row per document: doc_id and the tuple that ``fn`` gives for its bytes (null text: empty).

    ``schema`` names the tuple's columns.  Rows are dealt with one by one inside Arrow
    batches, so memory follows the batch, not the partition.  Where results are as wide as
    texts, a smaller ``rows_out`` keeps the batches that go back small.
    """
    rows = ids_and_bytes(docs, id_col, text_col)
    out = rows.sparkSession.createDataFrame([], f"doc_id long, {schema}").schema
    arrow = arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, rows_out):
            made = [fn(t.as_py() or b"") for t in batch.column(1)]
            columns = list(zip(*made)) if made else [[] for _ in arrow.names[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])], schema=arrow)

    return rows.mapInArrow(run, out)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows."""
    return (b.slice(at, rows) for b in batches for at in range(0, max(b.num_rows, 1), rows))


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def starts(keys: np.ndarray) -> np.ndarray:
    """True where a sorted array begins a new value."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return first


def as_row(df: DataFrame, **keys: Column) -> DataFrame:
    """``keys`` and all columns of ``df`` as the struct ``row``, so that no name of theirs can clash."""
    return df.select(*(key.alias(name) for name, key in keys.items()), F.struct(*map(quoted, df.columns)).alias("row"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Longest key that is remembered.
LONGEST_KEY = 64


class Remembered(dict):
    """Values of ``make`` by key, in bounded memory.

    When ``size`` keys are there they become the old generation, and what is still used moves over.  Keys of over
    ``LONGEST_KEY`` bytes or characters are made anew each time, so both generations have a bound in bytes too.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
