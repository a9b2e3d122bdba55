"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

Every document is reduced to some twenty statistics of its whole text.  Their random Fourier
features approximate a Gaussian kernel.  Tasks sum the normal equations of their labelled rows per fold;
the sums have a fixed size and meet row by row.  Each fold is scored by the model of the other folds, which
gives the scores that the isotonic calibration is fitted on; it sees a histogram of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .base import per_text
from .quality_rules import SPACE, code_points, repeated_words

FEATURES = ["log_words", "word_length", "distinct_words", "top_word", "repeated_windows", "symbols", "shouts", "bars",
            "digits", "capitals", "non_ascii", "commas", "full_stops", "log_lines", "line_words", "repeated_lines",
            "ended_lines", "short_lines", "longest_word", "entropy", "capital_words", "same_neighbours"]


def statistics(data: bytes) -> list[float]:
    """The FEATURES of a text; all 0 for one without words."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    size = len(data)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    used = histogram[histogram > 0] / size
    letters = int(histogram[65:91].sum() + histogram[97:123].sum()) or 1
    char = lambda marks: int(sum(histogram[c] for c in marks))
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    ended = sum(line.rstrip(SPACE)[-1:] in (b".", b"!", b"?", b":", b'"') for line in lines)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        math.log1p(n), min(code_points(data) / n, 30.0), len(counts) / n, max(counts.values()) / n, repeated_words(words) / n,
        min(char(b"#*$%&<>~^=_\\") / n, 5.0), min(char(b"!?") / n, 5.0), min(char(b"|") / n, 2.0), char(b"0123456789") / size,
        int(histogram[65:91].sum()) / letters, int(histogram[128:].sum()) / size, min(char(b",;") / n, 2.0), min(char(b".") / n, 2.0),
        math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), ended / len(lines),
        sum(len(line.split(None, 4)) < 4 for line in lines) / len(lines), math.log1p(max(map(len, counts))),
        float(-(used * np.log2(used)).sum()), sum(w[:1].isupper() for w in counts) / len(counts), same / n]


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled rows that are fitted on; beyond it a hash of the id picks."""

    features: int = 256
    width: float = 1.0          # kernel width in units of sqrt(number of statistics)
    ridge: float = 1e-4         # times the number of rows
    seed: int = 7
    bins: int = 2000            # of the calibration's histogram
    max_rows: int = 2_000_000
    tasks: int = 16             # that sum normal equations
    held_out: int = 0           # remainder of crc32(id as text) mod ``folds`` that is never learnt from
    folds: int = 5


@dataclass(frozen=True)
class Model:
    """Fixed-size numbers that score a document."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray           # raw scores and what they are calibrated to
    values: np.ndarray


def _projection(params: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(params.seed)
    d = len(FEATURES)
    return (rng.standard_normal((d, params.features)) / (params.width * math.sqrt(d)),
            rng.uniform(0, 2 * math.pi, params.features))


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, projection: tuple) -> np.ndarray:
    """Random Fourier features and a constant of standardised rows."""
    w, b = projection
    z = np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b) * math.sqrt(2 / len(b))
    return np.hstack([z, np.ones((len(x), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, len(FEATURES))


def _row_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, params: Params) -> DataFrame:
    """(fold, row, values): each fold's normal equations with the right-hand side as last column, summed."""
    projection = _projection(params)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = fourier(matrix(batch.column(0)), mean, scale, projection)
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                part = z[fold == f]
                sums[f] = sums.get(f, 0) + part.T @ np.hstack([part, y[fold == f][:, None]])
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()),
                                              pa.array(list(total), pa.list_(pa.float64()))], names=["fold", "row", "values"])

    def add(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        values = np.vstack(table.column("values").to_pylist()).sum(axis=0)
        return pa.table({"fold": table.column("fold").slice(0, 1), "row": table.column("row").slice(0, 1),
                         "values": pa.array([values], pa.list_(pa.float64()))})

    schema = "fold int, row int, values array<double>"
    # ``tasks`` rows at most for each row of a matrix of fixed size.
    return (rows.select("f", "y", "fold").repartition(params.tasks).mapInArrow(run, schema)
            .groupBy("fold", "row").applyInArrow(add, schema))


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean x, value) of each block of rising means."""
    blocks: list[list[float]] = []
    for at, s, w in zip(x, total, n):
        blocks.append([at * w, s, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f) per row, written once."""
    return cut(per_text(docs, "f array<double>", lambda data: (statistics(data),), id_col, text_col), "document-statistics")


def remainder(params: Params, id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(params.folds)).cast("int")


def fit(stats: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learns from labelled documents that are not held out.

    Labels are averaged per id and count as 1 from one half up; null labels and ids are left
    out.  Without labelled rows every score is 0.5; if all have one label, it is that label's.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
             .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
             .withColumn("fold", remainder(params)).where(F.col("fold") != params.held_out))
    n = known.count()
    if n > params.max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * params.max_rows / n))
    moments = stats.agg(*(F.avg(F.col("f")[i]).alias(f"m{i}") for i in range(len(FEATURES))),
                        *(F.stddev_pop(F.col("f")[i]).alias(f"s{i}") for i in range(len(FEATURES)))).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(len(FEATURES))])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(len(FEATURES))])
    rows = cut(stats.join(known, "doc_id").select("f", "y", "fold"), "labelled-statistics")
    parts: dict[int, np.ndarray] = {}
    side = params.features + 1
    for r in _row_sums(rows, mean, scale, params).collect():  # folds x features rows
        parts.setdefault(r["fold"], np.zeros((side, side + 1)))[r["row"]] = r["values"]
    if not parts:
        return Model(mean, scale, None, np.array([0.0]), np.array([0.5]))
    total = sum(parts.values())

    def solve(sums: np.ndarray) -> np.ndarray:
        a = sums[:, :-1]
        penalty = params.ridge * max(a[-1, -1], 1.0) * np.eye(side)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a + penalty, sums[:, -1])

    others = {f: solve(total - part) if len(parts) > 1 else solve(total) for f, part in parts.items()}
    projection = _projection(params)
    bins = params.bins

    def score_folds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = fourier(matrix(batch.column(0)), mean, scale, projection)
            fold = batch.column(2).to_numpy()
            raw = np.array([z[i] @ others[f] for i, f in enumerate(fold.tolist())], float)
            at = np.clip(np.floor((raw + 1) / 3 * bins), 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1), pa.array(raw)], names=["bin", "y", "raw"])

    histogram = (rows.select("f", "y", "fold").mapInArrow(score_folds, "bin int, y double, raw double")
                 .groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n"), F.avg("raw").alias("raw")).collect())
    histogram.sort(key=lambda r: r["bin"])
    knots, values = isotonic(*(np.array([r[c] for r in histogram], float) for c in ("raw", "y", "n")))
    return Model(mean, scale, solve(total), knots, values)


def score(stats: DataFrame, model: Model, params: Params = Params(), threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; a null id is not held out."""
    projection = _projection(params)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.weights is None:
                out = np.full(batch.num_rows, model.values[0])
            else:
                raw = fourier(matrix(batch.column(1)), model.mean, model.scale, projection) @ model.weights
                out = np.clip(np.interp(raw, model.knots, model.values), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder(params) == params.held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params(), threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Scores every row of ``docs``; the text alone decides a score, null text is empty text."""
    stats = document_statistics(docs, id_col, text_col)
    return score(stats, fit(stats, labels, params, id_col, label_col), params, threshold)
