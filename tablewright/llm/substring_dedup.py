"""Repeated passages: units of lines are hashed, grouped globally, the earliest occurrence stays.

A unit is a sentence of a line, a line, or a paragraph, normalised in case and white space.  Digests of all units
are grouped; what moves is a digest, an id and a place, never text.  With ``every`` (the query and
``drop_passages``) all occurrences but the first go, also within one document and whatever
their length.  Spans refer to the characters of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .base import order_id

_UNITS = {"sentence": re.compile(r"[^\n]+?(?:[.!?…。！？]+(?=\s|$)|(?=\n|$))", re.ASCII),
          "line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"(?:[^\n]+\n?)+")}


def units_of(text: str, unit: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of each unit with a word, in characters."""
    for m in _UNITS[unit].finditer(text):
        words = m.group().lower().split()
        if words:
            yield m.start(), m.end(), " ".join(words)


_SCHEMA = "high long, low long, doc_id long, sum long, ordinal int, start int, end int, words int"
_ARROW = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("sum", pa.int64()), ("ordinal", pa.int32()),
                    ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])


def unit_digests(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per unit: 128 bits of its BLAKE2b digest, document, ordinal, span, words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, digests, ordinal, start, end, words = [], [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                for k, (a, b, clean) in enumerate(units_of(text.as_py() or "", unit)):
                    owner.append(row)
                    digests.append(hashlib.blake2b(clean.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    ordinal.append(k)
                    start.append(a)
                    end.append(b)
                    words.append(clean.count(" ") + 1)
            who = pa.array(owner, pa.int64())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(who), batch.column(1).take(who),
                 *(pa.array(x, pa.int32()) for x in (ordinal, start, end, words))], schema=_ARROW)

    text = F.col(text_col).cast("string")
    return docs.select(order_id(F.col(id_col).cast("long")).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("sum"),
                       text.alias("text")).mapInArrow(run, _SCHEMA)


def repeated_spans(docs: DataFrame, unit: str = "sentence", min_words: int = 25, id_col: str = "doc_id",
                   text_col: str = "text", every: bool = False) -> DataFrame:
    """(doc_id, sum, start, end, n_words, first_docs) of every passage to remove.

    Occurrences of a unit rank by id, ``sum`` and place (a null id is the largest).  With ``every`` only the
    smallest stays; without, a unit is repeated if a smaller id has it too, and the smallest id keeps
    all of its occurrences.  Neighbouring repeated units make a passage, which is
    reported if it has ``min_words`` words or more (1: all are).  ``start`` and ``end`` count
    characters of the original text; ``first_docs`` are the ids that keep its units.  Rows with one id are one
    document; ``sum`` (xxhash64 of the text) tells their texts apart, and rows repeated as a whole are
    reported once.  Null and empty texts have no units.
    """
    units = cut(unit_digests(docs, unit, id_col, text_col), "units")
    # Written, so that the join below deals both sides anew and a digest with many units can be split.
    if every:
        least = F.min(F.struct("doc_id", "sum", "ordinal"))
        firsts = (units.groupBy("high", "low").agg(least.alias("least"), F.count("*").alias("n")).where("n > 1")
                  .select("high", "low", F.col("least.doc_id").alias("first"), F.col("least.sum").alias("first_sum"),
                          F.col("least.ordinal").alias("first_ordinal")))
        later = "not (doc_id = first and sum = first_sum and ordinal = first_ordinal)"
    else:
        firsts = (units.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                  .where("first < last").drop("last"))
        later = "doc_id != first"
    hits = (units.join(cut(firsts, "first-units"), ["high", "low"]).where(later)
            .select("doc_id", "sum", "ordinal", "start", "end", "words", "first").distinct())
    # As many structs as one document has units: no more than its text holds.
    runs = hits.groupBy("doc_id", "sum").agg(F.array_sort(F.collect_list(
        F.struct("ordinal", "start", "end", "words", "first"))).alias("hits"))

    @F.pandas_udf("array<struct<start:int,end:int,words:int,firsts:array<bigint>>>")
    def passages(columns):
        def join(found):
            out, last = [], None
            for h in found:
                if last is not None and h["ordinal"] == last + 1:
                    out[-1]["end"] = h["end"]
                    out[-1]["words"] += h["words"]
                    out[-1]["firsts"].add(h["first"])
                else:
                    out.append({"start": h["start"], "end": h["end"], "words": h["words"], "firsts": {h["first"]}})
                last = h["ordinal"]
            return [{**o, "firsts": sorted(o["firsts"])} for o in out if o["words"] >= min_words]
        return columns.map(join)

    return (runs.select("doc_id", "sum", F.explode(passages("hits")).alias("p"))
            .select("doc_id", "sum", "p.start", "p.end", F.col("p.words").cast("long").alias("n_words"),
                    F.col("p.firsts").alias("first_docs")))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which do not overlap."""
    kept, at = [], 0
    for a, b in sorted(spans):
        kept.append(text[at:a])
        at = b
    return "".join(kept) + text[at:]


def drop_passages(docs: DataFrame, unit: str = "sentence", min_words: int = 1, id_col: str = "doc_id",
                  text_col: str = "text", every: bool = True) -> DataFrame:
    """(doc_id, kept_text, removed array<struct<start, end>>) per row; offsets are the original text's."""
    spans = (repeated_spans(docs, unit, min_words, id_col, text_col, every).groupBy("doc_id", "sum")
             .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
             .select(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum"), "removed"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    joined = rows.join(spans.hint("shuffle_hash"), (order_id("doc_id") == F.col("_id"))
                       & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_sum")), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or not r else cut_spans(t, [(x["start"], x["end"]) for x in r])
                     for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)],
                                             names=["doc_id", "kept_text", "removed"])

    return joined.select("doc_id", "text", "removed").mapInArrow(
        run, "doc_id long, kept_text string, removed array<struct<start:int,end:int>>")
