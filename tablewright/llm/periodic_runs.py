"""Periodic runs of words: Lyndon arrays by grouping suffixes, roots extended into runs.

A run is a stretch of words with smallest period q, as long as it gets.  Its Lyndon root (the
smallest rotation of the period, under the order in which the word behind the run is the smaller
one) is the longest Lyndon word at each place where it starts inside the run.  So the Lyndon
arrays under the alphabet's order and under its reverse hold a root of every run.

The arrays come from the first phase of Baier's suffix sorter.  Suffixes are grouped by their first
word and the groups taken from the greatest down.  The suffixes of a group are complete; each
goes to the nearest unfinished suffix on its left, whose word grows by that of the group, and which
moves to a new group right above its old one.  A group's word is in the end the longest
Lyndon word at its suffixes, and its length is the array's entry.  Unfinished suffixes
are a linked list, so a suffix is taken out once and every step is constant.

Runs of at least four periods and six words hold each of their word triples three times or more.  Triples
are counted for all texts of a batch at once, and stretches without such triples, which no run can touch,
are left out before suffixes are grouped.  Counts share slots of a table, which can only leave more in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, ids_and_bytes

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Bytes of text that are looked at together.
TOGETHER = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(ranks: list[int], letters: int) -> list[int]:
    """Length of the longest Lyndon word at each place; ``ranks`` are letters below ``letters``, the text's end is below all."""
    n = len(ranks)
    group, width = list(ranks), [1] * letters
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, letter in enumerate(ranks):
        members[letter].append(i)
    below, above = list(range(-1, letters - 1)), list(range(1, letters + 1))
    left, right, waiting, out = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n, [0] * n
    g = letters - 1
    while g >= 0:
        size, grown = width[g], []
        for i in members[g]:
            if group[i] != g:
                continue
            out[i] = size
            p, q = left[i], right[i]
            if q < n:
                left[q] = p
            if p >= 0:
                right[p] = q
                if not waiting[p] and group[p] != g:
                    grown.append(p)
                # Suffixes of this group with nothing unfinished between them pass their number on.
                waiting[p] += waiting[i] + 1
        members[g] = []
        for times in sorted({waiting[j] for j in grown}, reverse=True):
            made: dict[int, int] = {}
            for j in grown:
                if waiting[j] == times:
                    old = group[j]
                    new = made.get(old)
                    if new is None:
                        new = made[old] = len(width)
                        width.append(width[old] + times * size)
                        members.append([])
                        below.append(old)
                        above.append(above[old])
                        below[above[old]] = new
                        above[old] = new
                    members[new].append(j)
                    group[j] = new
        for j in grown:
            waiting[j] = 0
        g = below[g]
    return out


def common_prefix(x: np.ndarray, a: int, b: int, limit: int) -> int:
    """Equal letters from places ``a`` and ``b`` on, at most ``limit``."""
    at, step = 0, 16
    while at < limit:
        n = min(step, limit - at)
        unlike = np.flatnonzero(x[a + at:a + at + n] != x[b + at:b + at + n])
        if len(unlike):
            return at + int(unlike[0])
        at, step = at + n, step * 4
    return limit


def runs_of(letters: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the letters, by start and period."""
    n = len(letters)
    values, ranks = np.unique(letters, return_inverse=True)
    mirror, found = ranks[::-1], set()
    for order in (ranks, len(values) - 1 - ranks):
        length = np.array(lyndon_array(order.tolist(), len(values)))
        place = np.arange(n)
        # Four periods hold three roots one behind the other.
        twice = place + 2 * length
        ok = twice < n
        ok[ok] = (length[(place + length)[ok]] == length[ok]) & (length[twice[ok]] == length[ok])
        ends: dict[int, int] = {}
        for i in np.flatnonzero(ok).tolist():
            period = int(length[i])
            if i + 2 * period <= ends.get(period, 0):
                continue
            start = i - common_prefix(mirror, n - i, n - i - period, i)
            end = i + period + common_prefix(ranks, i, i + period, n - i - period)
            if end - start >= 2 * period:
                ends[period] = end
            if end - start >= max(MIN_WORDS, MIN_PERIODS * period):
                found.add((start, end - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _stretches(letters: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Spans of letters that hold all runs: stretches in which every triple occurs three times or more.

    ``owner`` names the text of each letter; no span crosses texts.
    """
    if len(letters) < MIN_WORDS:
        return []
    triple = letters.astype(np.uint64)
    for _ in range(2):
        triple = (triple ^ (triple >> np.uint64(29))) * _ODD
        triple = triple[:-1] + letters[len(letters) - len(triple) + 1:].astype(np.uint64)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    among = owner[at].astype(np.uint64)
    for _ in range(4):
        key = (triple[at] ^ among * np.uint64(0xC2B2AE3D27D4EB4F)) * _ODD
        slot = (key >> np.uint64(64 - max(int(len(at) * 8).bit_length(), 8))).astype(np.int64)
        often = np.bincount(slot)[slot] >= MIN_PERIODS - 1 if len(at) else np.zeros(0, bool)
        n, at, among = len(at), at[often], among[often]
        if not len(at):
            return []
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (among[1:] != among[:-1])
        among = np.cumsum(new)
        long = np.bincount(among)[among] >= MIN_WORDS - 2
        at, among = at[long], among[long].astype(np.uint64)
        if len(at) == n or not len(at):
            break
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(among, prepend=among[:1] + np.uint64(1)))
    last = np.append(new[1:], len(at)) - 1
    return list(zip(at[new].tolist(), (at[last] + 3).tolist()))


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of every text's words."""
    number = count().__next__
    names: dict[bytes, int] = {}
    sizes = [len(words) for words in texts]
    letters = np.fromiter((names[w] if w in names else names.setdefault(w, number()) for words in texts for w in words), np.int64, sum(sizes))
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in _stretches(letters, owner):
        text = int(owner[a])
        shift = a - int(begin[text])
        out[text] += [(start + shift, length, period) for start, length, period in runs_of(letters[a:b])]
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one blank between them, without those behind the first period of a run."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: its runs by start and period, and the text that keeps each run's first period.

    Words are separated by ASCII white space and compared as they are; a run has four periods and six words or more.
    ``edit`` may change a document's words first.  Null and empty texts have no words, no runs and an
    empty collapsed text.  Every row stands for itself, so repeated rows and ids give repeated results; other
    columns are not read.  Memory follows the longest text.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, texts, size = [], [], 0
            for k, (doc_id, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                data = data.as_py() or b""
                words = data.split()
                texts.append(edit(doc_id, words) if edit else words)
                ids.append(doc_id)
                size += len(data)
                if size >= TOGETHER or k == batch.num_rows - 1:
                    yield rows_of(ids, texts)
                    ids, texts, size = [], [], 0

    def rows_of(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(texts)
        flat = np.array([run for runs in found for run in runs], np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(runs) for runs in found]))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
            [pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN)))
        kept = pa.array([collapsed(words, runs) for words, runs in zip(texts, found)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), runs, kept],
                                          schema=_ARROW)

    return ids_and_bytes(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    """``found`` of ``periodic_runs`` as figures: number of runs, the longest one (ties: smallest start, then period), and digests."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
