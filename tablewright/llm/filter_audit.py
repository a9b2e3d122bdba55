"""What each filter of a chain removes, in every order: survival words and positional popcounts.

A document's failures decide which subsets of five filters it survives.  That is a 32-bit word:
bit S is set if no filter of subset S (bit k: the k-th filter) rejects the document.  A task
adds up the words of each part and label with carry-save adders: three words of one weight
become one of that weight and one of twice the weight, so a bit position's count is read off a
handful of words in the end.  What leaves a task is 32 counts per part and label.  Any order
of the filters walks a path through these subsets, so all figures follow from the counts.

Copies are found table-wide: texts meet by 128 bits of their BLAKE2b digest, grouped with partial
aggregation, and only digests that repeat are joined back to the narrow rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .base import order_id
from .quality_rules import code_points

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOL = re.compile(rb"[#$%&*|]")
#: Groups of a part and its labels that a task holds before it gives their counts away.
HELD = 4096


class Text(NamedTuple):
    """What the rules ask of a text."""

    data: bytes
    words: int
    distinct: int
    chars: int
    upper: int


#: Each filter and when a text fails it.  ``DUPLICATE`` is the fifth: the text of a smaller id, word for word.
RULES: dict[str, Callable[[Text], bool]] = {
    "A": lambda t: t.words < 50,
    "B": lambda t: 100 * t.distinct < 65 * t.words,
    "C": lambda t: 100 * t.upper > 5 * t.chars,
    "D": lambda t: _SYMBOL.search(t.data) is not None,
}
DUPLICATE = "E"


def described(data: bytes) -> Text:
    words = data.split()  # of bytes: ASCII white space only
    return Text(data, len(words), len(set(words)), code_points(data), len(data) - len(data.translate(None, _UPPER)))


def survival_word(fails: int, filters: int = 5) -> int:
    """The subsets of filters that a document survives which fails the filters of the mask ``fails``."""
    return sum(1 << subset for subset in range(1 << filters) if not subset & fails)


_FAILS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("high", pa.int64()), ("low", pa.int64()), ("fails", pa.int32())])


def survival_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                   rules: dict[str, Callable[[Text], bool]] = RULES) -> DataFrame:
    """(doc_id, part, fails, word) per row: the mask of failed filters and the survival word.

    Null texts are empty; a null part is the empty string.  A text is a copy if a smaller id
    has it too, whatever else happens to that document; a null id is the largest, and rows of one
    id are no copies of each other.  Other columns of ``docs`` are not read.  No rows: no rows.
    """
    tests = list(rules.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fails = [], []
            for text in batch.column(2):
                data = text.as_py()
                told = described(data)
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                fails.append(sum(1 << k for k, test in enumerate(tests) if test(told)))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                                              pa.array(fails, pa.int32())], schema=_FAILS)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    rows = cut(rows.mapInArrow(run, "doc_id long, part string, high long, low long, fails int"), "failures")
    firsts = (rows.groupBy("high", "low").agg(F.min(order_id()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # Written, so that the join can split a digest that many rows share.
    rows = rows.join(cut(firsts, "first-texts"), ["high", "low"], "left")
    copy = F.coalesce(order_id() > F.col("first"), F.lit(False))
    words = F.array(*[F.lit(survival_word(m)).cast("long") for m in range(1 << (len(tests) + 1))])
    return (rows.withColumn("fails", F.col("fails").bitwiseOR(F.when(copy, 1 << len(tests)).otherwise(0)))
            .select("doc_id", "part", "fails", words[F.col("fails")].alias("word")))


class Counter:
    """Positional popcount of 32-bit words, kept as carry-save words: ``levels[k]`` weigh 2 ** k each."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        k = 0
        while len(words):
            if k == len(self.levels):
                self.levels.append(np.zeros(0, np.uint32))
            held, carries = np.concatenate([self.levels[k], words]), []
            while len(held) > 2:
                n = len(held) // 3
                a, b, c = held[:3 * n].reshape(3, n)
                either = a ^ b
                carries.append((a & b) | (either & c))
                held = np.concatenate([either ^ c, held[3 * n:]])
            self.levels[k] = held
            words = np.concatenate(carries) if carries else held[:0]
            k += 1

    def counts(self) -> np.ndarray:
        """How many of the words had each bit."""
        out = np.zeros(32, np.int64)
        for k, words in enumerate(self.levels):
            bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
            out += bits.sum(axis=0, dtype=np.int64) << k
        return out


_COUNTS = pa.schema([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("subset", pa.int32()), ("n", pa.int64())])


def subset_survivors(words: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents of a part that each subset of filters leaves, all, of quality 1, toxic.

    ``words`` is what ``survival_words`` gives.  An id with several labels has what any of them says; ids without
    labels, and null ids, are in ``n`` only.
    """
    said = cut(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "marks")
    rows = words.select("doc_id", "part", "word").join(said, "doc_id", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}

        def given() -> pa.RecordBatch:
            keys = list(held)
            out = [held[key].counts() for key in keys]
            held.clear()
            columns = [pa.array([key[i] for key in keys for _ in range(32)], _COUNTS.field(i).type) for i in range(3)]
            return pa.RecordBatch.from_arrays(
                columns + [pa.array(np.tile(np.arange(32, dtype=np.int32), len(keys))),
                           pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], schema=_COUNTS)

        for batch in batches:
            part = batch.column(0).dictionary_encode()
            code = part.indices.to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy(zero_copy_only=False) * 2 + batch.column(
                2).to_numpy(zero_copy_only=False)
            word = batch.column(3).to_numpy().astype(np.uint32)
            order = np.argsort(code, kind="stable")
            code, word = code[order], word[order]
            edges = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                c = int(code[a])
                key = (part.dictionary[c >> 2].as_py(), bool(c & 2), bool(c & 1))
                held.setdefault(key, Counter()).add(word[a:b])
                if len(held) > HELD:
                    yield given()
        yield given()

    no = F.lit(False)
    counted = rows.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "word").mapInArrow(
        run, "part string, good boolean, toxic boolean, subset int, n long")
    return counted.groupBy("part", "subset").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                                                 F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(survivors: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    ``survivors`` is what ``subset_survivors`` gives: 32 rows per part.
    """
    paths = list(permutations(range(len(filters))))
    names = ["".join(filters[k] for k in path) for path in paths for _ in path]
    step = np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(paths))
    which = np.array(paths).reshape(-1)
    after = np.cumsum(1 << np.array(paths), axis=1).reshape(-1)
    before, every = after - (1 << which), (1 << len(filters)) - 1
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _FIGURES)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = (np.array([c[x] for c in counts], np.int64) for x in ("n", "good", "toxic"))
                removed = n[before] - n[after]
                shapley = np.bincount(which, weights=removed, minlength=len(filters)).astype(np.int64)
                figures = (n[after], removed, n[0] - n[1 << which] - removed, n[every ^ (1 << which)] - n[every],
                           good[before] - good[after], toxic[before] - toxic[after], shapley[which])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.string()), pa.array(names), pa.array(step),
                                                  *map(pa.array, figures)], schema=schema)

    # A part has one entry per subset of the filters.
    whole = survivors.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("counts"))
    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _FIGURES))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What every filter removes at every step of every order, per part; see ``survival_words`` and ``subset_survivors`` for odd rows."""
    return orders(subset_survivors(survival_words(docs, id_col, text_col, part_col), labels), "".join(RULES) + DUPLICATE)
