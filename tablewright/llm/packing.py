"""Packing token sequences: Karmarkar-Karp differencing gives near-equal windows.

Documents are tokenised once.  Every full window of a document is a sequence by itself; what
is left over is cut into pieces of at most ``piece`` tokens, so that windows balance well.
Pieces go to groups of bounded size by a hash.  In a group, multiway differencing starts from one partial
partition per piece and always merges the two with the largest spread, the fullest windows of
one with the emptiest of the other.  If a window exceeds the capacity the group gets one
window more.  A group's shortfall is under one window plus what the windows rose by, so
padding is about one window in the some hundreds of a group.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .base import Remembered, ids_and_bytes, kept

#: Words, and parts of words, in a generation of a worker's dictionaries; two are kept.
CACHE_WORDS = 250_000

# Letters and numerals below U+0180, and how the tokenizer splits a word of such characters.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMERALS = "0-9²³¹¼½¾"
_PLAIN_WORD = re.compile("[!-~¡-ſ]+")
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMERALS}]|[^{_LETTERS}{_NUMERALS}]+")


_MARKS = frozenset(b".,:;!?")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Token ids of texts by way of dictionaries of words and their parts.

    For tokenizers that drop white space, never join words across it, and lower-case and split as
    the lower-casing word BPE does.  Words are cut at ASCII spaces and line ends; those of plain
    characters below U+0180 go to the model part by part, any other goes through the whole tokenizer.  Ids
    are kept as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Remembered(self._word, CACHE_WORDS)
        self.parts = Remembered(self._part, CACHE_WORDS)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return _packed([t.id for t in self.model.tokenize(letters)])

    def _word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # of bytes: ASCII letters only
            return self.parts[raw.lower().decode()]
        if raw[:-1].isalpha() and raw[-1] in _MARKS:
            return self.parts[raw[:-1].lower().decode()] + self.parts[chr(raw[-1])]
        word = raw.decode("utf-8", "replace")
        if not word:
            return b""
        if _PLAIN_WORD.fullmatch(word) and "İ" not in word and not ("<" in word and any(s in word for s in self.special)):
            low = word.lower()
            if low.isalpha():
                return self.parts[low]
            if low[-1] in ".,:;!?" and low[:-1].isalpha():
                return self.parts[low[:-1]] + self.parts[low[-1]]
            return b"".join(map(self.parts.__getitem__, _PART.findall(low)))
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace(b"\n", b" ").split(b" ")))


def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker process, so that tasks share its dictionaries."""
    return kept(("encoder", path), lambda: WordEncoder(path))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, piece: int = 1024, end_id: int = 2,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every row's ids, the end id included; null text gives the end id alone.

    ``with_ids`` adds the ids of each piece as an array.
    """
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                data = encoder.encode(text.as_py() or b"") + end
                n = len(data) // 4
                for a, size in _cuts(n, capacity, piece):
                    owner.append(row)
                    start.append(a)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * a:4 * (a + size)]))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(data, "<u4", size, 4 * a).astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int64())),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names)

    return ids_and_bytes(docs, id_col, text_col).mapInArrow(run, schema)


def _cuts(n: int, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    """(start, length): whole windows first, then parts of at most ``piece``."""
    a = 0
    while a < n:
        size = capacity if n - a >= capacity else min(piece, n - a)
        yield a, size
        a += size


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in at most ``windows`` lists of near-equal sums.

    A partial partition lists (negative sum, name) of the windows that hold something, fullest first;
    the windows it does not list are empty.
    """
    sizes = sizes.tolist()
    members = [[i] for i in range(len(sizes))]
    tie = count()
    heap = [(-s if windows > 1 else 0, next(tie), [(-s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        # Fullest of one meets emptiest of the other: only the last windows of both have a partner.
        shared = max(0, len(one) + len(other) - windows)
        met = []
        for (s, a), (t, b) in zip(one[len(one) - shared:], reversed(other[len(other) - shared:])):
            if len(members[a]) < len(members[b]):
                a, b = b, a
            members[a] += members[b]
            met.append((s + t, a))
        if len(other) == 1 and shared:
            one.pop()
            insort(one, met[0])
        else:
            one = sorted(one[:len(one) - shared] + other[:len(other) - shared] + met)
        low = one[-1][0] if len(one) == windows else 0
        heapq.heappush(heap, (one[0][0] - low, next(tie), one))
    return [members[i] for _, i in heap[0][2]] if heap else []


def windows_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each size; as few windows as differencing fits in ``capacity``."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        parts = differencing(sizes, k)
        if max(int(sizes[p].sum()) for p in parts) <= capacity:
            break
        k += 1
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for w, part in enumerate(parts):
        window[part] = w
        offset[part] = np.cumsum(sizes[part]) - sizes[part]
    return window, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, piece: int = 1024, end_id: int = 2,
         group: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Every row of ``docs`` is tokenised, ``end_id`` closes it; null text is empty.  Rows with one
    id, or none, are documents of their own.  ``group`` is the mean number of pieces that one differencing
    run gets; groups are dealt by a hash over pieces, so no key decides their size.
    A group's number stands in the upper bits of ``sequence_id``; ids have gaps.
    """
    cuts = cut(pieces(docs, tokenizer_path, capacity, piece, end_id, id_col, text_col), "pieces")
    rest = cuts.where(F.col("length") < capacity)
    n = max(1, -(-rest.count() // group))
    # Stable, as the written table is read in the same splits by every attempt of a job.
    numbered = cuts.withColumn("_row", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == capacity).select(
        *cuts.columns, (F.lit(1 << 62) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = numbered.where(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(n)))
    names = [*cuts.columns, "sequence_id", "offset"]

    def differenced(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_row", "ascending")])
        window, offset = windows_of(rows.column("length").to_numpy(), capacity)
        return pa.Table.from_arrays([*(rows.column(c) for c in cuts_columns), pa.array(window + (key[0].as_py() << 32)),
                                     pa.array(offset)], names=names)

    cuts_columns = cuts.columns
    packed = dealt.groupBy("_group").applyInArrow(differenced, f"{_PIECES}, sequence_id long, offset long")
    return whole.unionAll(packed)
