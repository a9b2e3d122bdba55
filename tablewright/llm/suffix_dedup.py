"""Repeated byte strings by a distributed difference cover.

Text is compared as bytes, ``length`` at a time.  The suffixes of all texts are brought in order as far as that many
bytes, from a sample of them that is a difference cover: equal strings have a sampled suffix at the same distance
from their beginnings.

* Sampled are anchors, the least hashed short substring in every ``length`` bytes.  Unlike places modulo 3 they depend on the bytes
  alone, and of strings of 50 bytes there are one in sixteen instead of two in three.
* The sampled suffixes, and what follows them in steps of three letters, are sorted by their first three letters of eight bytes.
  Place in that order is the suffix's name; names spell a string three times as coarse, whose triples are sorted in
  turn, until they cover ``length`` bytes.
* The remaining suffixes are merged as (bytes before the next sampled suffix, order of that suffix).
* Strings of ``length`` bytes that are equal are neighbours now; neighbours' prefixes are compared, and all but those
  in the smallest document of such a stretch go.

Sorts are range partitioned, so neither a common string nor a common letter ends up in one task: stretches that touch
the edge of an Arrow batch are settled by a grouped minimum with partial aggregation.

Only strings that may repeat take part.  Equal strings have equal anchors, so anchors that are in one document only rule out all
strings around them.  What is left is cut at anchors into blocks, and equal blocks take part once, for the smallest
document that has them (in all others, such a block is repeated as a whole).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import Scratch
from .base import forget, order_id, slices, starts

#: Bytes of a letter; three letters fit one sorted row.
LETTER = 8
#: Bytes that are hashed together, and texts above which they are taken in pieces.
PIECE = 1 << 16
#: One anchor in so many ends a block; no block has more strings than this.
ENDS, BLOCK = 16, 1 << 13
#: Bytes of blocks that share a row, and bits of a place in it.
CHUNK, PLACE_BITS = 192 << 10, 20
_ODD, _TWIST = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_LETTERS = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ np.uint64(0xD6E8FEB86659FD93)


def anchor_bytes(length: int) -> int:
    """Bytes of an anchor: the longer, the fewer anchors are in two documents by chance; the shorter, the fewer there are."""
    return max(2 * length // 5, 1)


def sliding(x: np.ndarray, n: int, op: Callable) -> np.ndarray:
    """``op`` over every ``n`` neighbours (over spans that overlap, where ``n`` is no power of two)."""
    size = 1
    while 2 * size <= n:
        x = op(x[:len(x) - size], x[size:])
        size *= 2
    return op(x[:len(x) - (n - size)], x[n - size:]) if n > size else x


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(3) + b
    x ^= x >> _TWIST
    x *= _ODD
    return x ^ (x >> np.uint64(32))


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every ``n`` bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    return sliding(_LETTERS[data], n, _mixed)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (text, start, first place of its own, end) of about ``PIECE`` bytes; parts of one text overlap."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PIECE):
            group.append((k, max(at - length, 0), at, min(at + PIECE, len(text))))
            size += min(PIECE, len(text) - at)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def least_places(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of ``length`` bytes, the place of its least substring of ``gram`` bytes by hash, the first of several.

    The upper bits of a hash and the place are compared as one number, which depends on the string's bytes alone.
    """
    at = np.arange(max(len(data) - gram + 1, 0), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    return (sliding((window_hashes(data, gram) & ~low) | at, length - gram + 1, np.minimum) & low).astype(np.int64)


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors: of each string of ``length`` bytes, the substring of ``gram`` bytes with the least hash."""
    out = []
    for group in _pieces(texts, length):
        parts = [texts[k][a:min(end + length, len(texts[k]))] for k, a, _, end in group]
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(data) < length:
            continue
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.concatenate(([0], np.cumsum(sizes)))
        part = np.repeat(np.arange(len(parts)), sizes)
        least = least_places(data, length, gram)
        least = least[np.arange(len(least)) + length <= begin[1:][part[:len(least)]]]
        at = np.unique(least)
        which = part[at]
        owner, first, own, end = (np.array(x, np.int64)[which] for x in zip(*group))
        place = at - begin[which] + first
        keep = (place >= own) & (place < end)
        out.append((owner[keep], place[keep], window_hashes(data, gram)[at][keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*out)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, sum, text): the id (null: the largest) and 64 bits of the text name a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(order_id(F.col(id_col).cast("long")).alias("doc"), F.xxhash64(text).alias("sum"), text.cast("binary").alias("text"))


def _shared_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, place) of anchors that are in two documents.

    What two documents of a thousand share is known at once, and one row of it goes on to tell others; so an anchor has
    no more rows that meet than there are thousands of documents (and places in one).  No anchor is hot then.  Anchors travel
    packed, eight buckets per shuffle partition, and a partition is sorted in memory: some 30 bytes per anchor.
    """
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 1000):
            owner, place, hashes = anchors([t.as_py() for t in batch.column(1)], length, gram)
            order = np.lexsort((owner, hashes))
            owner, place, hashes = owner[order], place[order], hashes[order]
            doc = batch.column(0).to_numpy()[owner]
            at = np.flatnonzero(starts(hashes))
            which = np.cumsum(starts(hashes)) - 1
            several = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))[which] if len(at) else np.zeros(0, bool)
            told = at[several[at]]
            known = np.append(several, np.zeros(len(told), bool))
            hashes, doc, place = (np.append(x, x[told]) for x in (hashes, doc, place.astype("<i4")))
            # What is known goes anywhere; what has yet to meet, by its hash.
            key = np.where(known, _mixed(hashes, place.astype(np.uint64)), hashes) >> np.uint64(32)
            bucket = (key * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            packed = [b"".join(x[order[i:j]].tobytes() for x in (hashes, doc, place, known)) for i, j in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edge[:-1]]]), pa.array(packed, pa.binary())], names=["bucket", "rows"])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for rows in batch.column(1).to_pylist():
                n = len(rows) // 21
                parts.append((np.frombuffer(rows, "<u8", n), np.frombuffer(rows, "<i8", n, 8 * n), np.frombuffer(rows, "<i4", n, 16 * n),
                              np.frombuffer(rows, np.bool_, n, 20 * n)))
        if not parts:
            return
        hashes, doc, place, known = map(np.concatenate, zip(*parts))
        parts.clear()
        order = np.argsort(hashes)
        at = np.flatnonzero(starts(hashes[order]))
        met = doc[order]
        many = (np.minimum.reduceat(met, at) != np.maximum.reduceat(met, at)) | np.logical_or.reduceat(known[order], at)
        pick = order[np.repeat(many, np.diff(np.append(at, len(order))))]
        for k in range(0, len(pick), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(doc[pick[k:k + (1 << 16)]]), pa.array(place[pick[k:k + (1 << 16)]])], names=["doc", "place"])

    rows = docs.select("doc", "text").mapInArrow(found, "bucket int, rows binary")
    return rows.repartition("bucket").mapInArrow(shared, "doc long, place int")


def cut_blocks(text: bytes, places: np.ndarray, length: int, gram: int) -> list[tuple[int, int]]:
    """(first, last) strings of the blocks of a text that hold all strings around the anchors at ``places``."""
    wide = length - gram
    last = len(text) - length
    if last < 0 or not len(places):
        return []
    places = np.unique(places)
    first, until = np.maximum(places - wide, 0), np.minimum(places, last)
    new = np.ones(len(places), bool)
    new[1:] = first[1:] > until[:-1] + 1
    begin = np.flatnonzero(new)
    ends = [p for p in places.tolist() if xxhash.xxh64_intdigest(text[p:p + gram]) % ENDS == 0]
    out, k = [], 0
    for a, b in zip(first[begin].tolist(), until[np.append(begin[1:], len(places)) - 1].tolist()):
        while k < len(ends) and ends[k] <= a:
            k += 1
        stops = []
        while k < len(ends) and ends[k] <= b:
            stops.append(ends[k])
            k += 1
        for x, y in zip([a, *stops], [*stops, b + 1]):
            out += [(at, min(at + BLOCK, y) - 1) for at in range(x, y, BLOCK)]
    return out


_BLOCK = "high long, low long, doc long, sum long, start int, strings int, data binary"
_ARROW_BLOCK = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc", pa.int64()), ("sum", pa.int64()), ("start", pa.int32()),
                          ("strings", pa.int32()), ("data", pa.binary())])


def _blocks(docs: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per block: digest, document, first string, number of strings, bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 500):
            owner, digest, start, strings, data = [], [], [], [], []
            for row, (text, places) in enumerate(zip(batch.column(2), batch.column(3))):
                text = text.as_py()
                for a, b in cut_blocks(text, places.values.to_numpy(), length, gram):
                    block = text[a:b + length]
                    owner.append(row)
                    digest.append(hashlib.blake2b(block, digest_size=16).digest())
                    start.append(a)
                    strings.append(b - a + 1)
                    data.append(block)
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            who = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(who), batch.column(1).take(who),
                 pa.array(start, pa.int32()), pa.array(strings, pa.int32()), pa.array(data, pa.binary())], schema=_ARROW_BLOCK)

    # A document has as many anchors as its text has room for.
    return docs.join(places.hint("shuffle_hash"), "doc").select("doc", "sum", "text", "places").mapInArrow(run, _BLOCK)


_CHUNK = "chunk long, data binary, starts array<int>, sizes array<int>, docs array<long>, sums array<long>"
_ARROW_CHUNK = pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
                          ("docs", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])


def _chunks(texts: DataFrame, pad: int) -> DataFrame:
    """Blocks (doc, sum, text) put together in rows of about ``CHUNK`` bytes, ``pad`` zero bytes before and behind each block."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        data, blocks = bytearray(pad), []

        def row() -> pa.RecordBatch:
            columns = list(zip(*blocks))
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW_CHUNK.names, ((task << 22) + number, bytes(data), *columns)))],
                                              schema=_ARROW_CHUNK)

        for batch in batches:
            for doc, sum_, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                blocks.append((len(data), len(block), doc, sum_))
                data += block + bytes(pad)
                if len(data) >= CHUNK:
                    yield row()
                    number += 1
                    data, blocks = bytearray(pad), []
        if blocks:
            yield row()

    return texts.select("doc", "sum", "text").mapInArrow(run, _CHUNK)


class _Chunk:
    """A chunk's bytes, its blocks, and the sampled suffixes."""

    def __init__(self, row: dict, letter: int, length: int):
        self.base = row["chunk"] << PLACE_BITS
        self.data = np.frombuffer(row["data"], np.uint8)
        self.starts, self.sizes = np.array(row["starts"], np.int64), np.array(row["sizes"], np.int64)
        self.docs = np.array(row["docs"], np.int64)
        self.letter, self.length, self.gram = letter, length, anchor_bytes(length)
        self.wide = length - self.gram + 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, most, least, doc) of the anchors: how many bytes before one its first and its last string begin."""
        least = least_places(self.data, self.length, self.gram)
        strings = np.maximum(self.sizes - self.length + 1, 0)
        block = np.repeat(np.arange(len(strings)), strings)
        first = np.concatenate(([0], np.cumsum(strings)))[:-1]
        at = np.arange(len(block)) - first[block] + self.starts[block]
        anchor = least[at]
        begin = np.flatnonzero(starts(anchor) | starts(block)) if len(at) else np.zeros(0, np.int64)
        until = np.append(begin[1:], len(at)) - 1 if len(at) else begin
        place = anchor[begin]
        return place, place - at[begin], place - at[until], self.docs[block[begin]]

    def sampled(self, cover: int) -> np.ndarray:
        """Places of the anchors and, ``cover`` bytes apart, of what follows them in their strings."""
        anchor = self.anchors()[0]
        return np.unique(np.concatenate([anchor + at for at in _offsets(cover, self.letter, self.length)]))

    def letters(self) -> np.ndarray:
        """The letter at each place, as a long of the same order."""
        x, step = self.data.astype(np.uint64), 1
        while step < 8:
            x = (x[:len(x) - step] << np.uint64(8 * step)) | x[step:]
            step *= 2
        return ((x >> np.uint64(8 * (8 - self.letter))) ^ np.uint64(1 << 63)).view(np.int64)


_ROW = "a long, b long, c long, pos long, part int"
_ARROW_ROW = pa.schema([*((c, pa.int64()) for c in ("a", "b", "c", "pos")), ("part", pa.int32())])
_NAMED = "pos long, name long, a long, b long, c long"
_ARROW_NAMED = pa.schema([(c, pa.int64()) for c in ("pos", "name", "a", "b", "c")])
#: One chunk in so many is looked at for the ranges, and the rows of it that are kept per range.
LOOKED_AT, PER_RANGE = 16, 100


def _part(bounds: list[tuple], *columns: np.ndarray) -> np.ndarray:
    """The range that each row (a, b, c, pos) belongs to."""
    first = np.array([b[0] for b in bounds], np.int64)
    low, high = np.searchsorted(first, columns[0], "left"), np.searchsorted(first, columns[0], "right")
    for k in np.flatnonzero(low != high).tolist():
        low[k] = bisect_left(bounds, tuple(int(c[k]) for c in columns), int(low[k]), int(high[k]))
    return low.astype(np.int32)


def _sorted(chunks: DataFrame, rows_of: Callable[[DataFrame, list[tuple]], DataFrame]) -> DataFrame:
    """Rows of all chunks in ranges by (a, b, c, pos), sorted.

    The ranges' bounds come from a sample of rows of a sample of chunks, so the rest is made once.  ``pos`` tells equal keys
    apart, so many of them are several ranges.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = chunks.count()
    some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(LOOKED_AT)) == 0) if count >= 8 * LOOKED_AT else chunks
    every = max(min(count, max(count // LOOKED_AT, 1)) * CHUNK // 8 // (n * PER_RANGE), 1)
    seen = rows_of(some, []).where(F.pmod(F.xxhash64("pos"), F.lit(every)) == 0).select("a", "b", "c", "pos")
    seen = sorted(tuple(r) for r in seen.collect())
    bounds = [seen[len(seen) * k // n] for k in range(1, n)] if seen else []
    return rows_of(chunks, bounds).repartitionById(n, "part").drop("part").sortWithinPartitions("a", "b", "c", "pos")


def _in_order(rows: DataFrame) -> DataFrame:
    """(pos, name) of sorted rows (a, b, c, pos); names begin at 1, grow with the order, and are equal for equal triples.

    Rows without ``pos`` tell the first and last triple of a task: a stretch of equal triples may go on in the next one.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, last = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, c = (batch.column(i).to_numpy() for i in range(3))
            begin = starts(a) | starts(b) | starts(c)
            begin[0] = last != (a[0], b[0], c[0])
            name = task + count + np.cumsum(begin)
            if last is None:
                yield _edge(name[0], a[0], b[0], c[0])
            count, last = int(name[-1] - task), (a[-1], b[-1], c[-1])
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(name), none, none, none], schema=_ARROW_NAMED)
        if last is not None:
            yield _edge(task + count, *last)

    return rows.mapInArrow(run, _NAMED)


def _edge(name, *key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (None, int(name), *map(int, key))], schema=_ARROW_NAMED)


def _same_names(named: DataFrame) -> dict[int, int]:
    """Names that a task gave to what the task before had named already.  Two rows per task are read."""
    out: dict[int, int] = {}
    edges = sorted(tuple(r) for r in named.where("pos is null").select("name", "a", "b", "c").collect())
    for (before, *key), (name, *other) in zip(edges, edges[1:]):
        if key == other and name != before:
            out[name] = out.get(before, before)
    return out


def _offsets(cover: int, letter: int, length: int) -> list[int]:
    """Places behind an anchor that have names of ``cover`` bytes; what is left behind the last is a letter, its own name."""
    return [at for at in range(0, length, cover) if at == 0 or length - at > letter]


def _triples_of_letters(chunks: DataFrame, bounds: list[tuple], letter: int, length: int) -> DataFrame:
    """Triples of letters of the sampled suffixes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, letter, length)
                place, letters = chunk.sampled(3 * letter), chunk.letters()
                yield from _row_batch(bounds, letters[place], letters[place + letter], letters[place + 2 * letter], place + chunk.base).to_batches()

    return chunks.mapInArrow(run, _ROW)


def _row_batch(bounds: list[tuple], *columns: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([*(pa.array(np.ascontiguousarray(c, np.int64)) for c in columns), pa.array(_part(bounds, *columns))],
                                schema=_ARROW_ROW)


#: Anchors with their triple, the strings around them (the first begins ``most`` bytes before the anchor), and the bytes of all of them.
_ANCHORED = "a long, b long, c long, doc long, pos long, most int, data binary, part int"
_ARROW_ANCHORED = pa.schema([*((c, pa.int64()) for c in ("a", "b", "c", "doc", "pos")), ("most", pa.int32()), ("data", pa.binary()),
                             ("part", pa.int32())])


def _triples_of_names(chunks: DataFrame, bounds: list[tuple], named: DataFrame, same: dict[int, int], cover: int, letter: int,
                      length: int) -> DataFrame:
    """Triples of names that cover ``cover`` bytes: of the sampled suffixes of the next level, or, in the end, of the anchors."""
    last = 3 * cover >= length

    def run(left: pa.Table, names: pa.Table) -> pa.Table:
        if not left.num_rows:  # not in the sample
            return (_ARROW_ANCHORED if last else _ARROW_ROW).empty_table()
        chunk = _Chunk(left.to_pylist()[0], letter, length)
        name = names.column("name").to_numpy()
        if same:
            name = name.copy()
            for k in np.flatnonzero(np.isin(name, list(same))):
                name[k] = same[int(name[k])]
        at = np.zeros(len(chunk.data) + 2 * cover, np.int64)
        at[names.column("place").to_numpy()] = name
        letters, named_at = chunk.letters(), set(_offsets(cover, letter, length))

        def triple(place, offset):
            # What follows a suffix of the next level at its anchor's ``offset``.
            return [at[place + k * cover] if offset + k * cover in named_at else
                    letters[place + k * cover] >> max(8 * (letter + offset + k * cover - length), 0) if offset + k * cover < length else
                    np.zeros(len(place), np.int64) for k in range(3)]

        if last:
            place, most, least, doc = chunk.anchors()
            sizes = most - least + length
            edge = np.concatenate(([0], np.cumsum(sizes)))
            rows = chunk.data[np.arange(edge[-1]) + np.repeat(place - most - edge[:-1], sizes)]
            data = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(rows)])
            key, pos = triple(place, 0), place + chunk.base
            return pa.Table.from_arrays([*map(pa.array, (*key, doc, pos)), pa.array(most.astype(np.int32)), data, pa.array(_part(bounds, *key, pos))],
                                        schema=_ARROW_ANCHORED)
        anchor, _, _, _ = chunk.anchors()
        parts = [(anchor + offset, offset) for offset in _offsets(3 * cover, letter, length)]
        parts = [_row_batch(bounds, *triple(place, offset), place + chunk.base) for place, offset in parts]
        return _once(pa.concat_tables(parts))

    place = F.col("pos").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    names = named.where("pos is not null").select(F.shiftright("pos", PLACE_BITS).alias("chunk"), place.alias("place"), "name")
    # Of the sample, only the names in it; its chunks are one in LOOKED_AT.
    names = names if bounds else names.join(chunks.select("chunk"), "chunk", "left_semi")
    return chunks.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(run, _ANCHORED if last else _ROW)


_HIT = "pos long, n int, hash long, doc long"
_ARROW_HIT = pa.schema([("pos", pa.int64()), ("n", pa.int32()), ("hash", pa.int64()), ("doc", pa.int64())])


def _judged(rows: DataFrame, length: int, wide: int) -> DataFrame:
    """Strings that a smaller document has: ``n`` from place ``pos`` on; with ``hash`` and ``doc``, strings yet to be settled.

    Anchors are sorted by what follows them.  A string is some bytes before its anchor and what follows up to its end, so equal
    strings are in a stretch of anchors that agree that far.  An Arrow batch settles all but the strings of its smallest document in
    stretches that touch its first or last row.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            doc, pos, most = (batch.column(i).to_numpy() for i in range(3, 6))
            texts = batch.column(6).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, n)
            least = most - sizes + length
            # One column per anchor, which stands in row ``wide`` - 1; zeros where its strings do not reach.
            data, edge = np.zeros((n, wide - 1 + length), np.uint8), np.cumsum(sizes) - sizes
            data.reshape(-1)[np.arange(sizes.sum()) + np.repeat(np.arange(n) * data.shape[1] + wide - 1 - most - edge, sizes)] = np.frombuffer(
                b"".join(texts), np.uint8)
            data = np.ascontiguousarray(data.T)
            # Row t: the string that begins t bytes before its anchor.  A few hundred columns at a time stay in the processor's cache.
            hashes = np.concatenate([sliding(_LETTERS[data[:, k:k + 256]], length, _mixed) for k in range(0, n, 256)], axis=1)[::-1]
            before = np.arange(wide)[:, None]
            here = (before <= most) & (before >= least)
            after, known = data[wide - 1:], length - least

            def agree(k: int) -> np.ndarray:
                """Bytes that follow anchors as they follow the k-th; all, if they agree as far as that one's are known."""
                same = np.logical_and.accumulate(after == after[:, k:k + 1]).sum(axis=0)
                return np.where(same >= known[k], length, same)

            far = np.maximum(agree(0), agree(n - 1))
            t, k = np.nonzero(here)
            value, whose = hashes[t, k], doc[k]
            order = np.argsort(value)
            first = np.flatnonzero(starts(value[order]))
            if not len(first):
                continue
            smallest = np.empty(len(t), np.int64)
            smallest[order] = np.repeat(np.minimum.reduceat(whose[order], first), np.diff(np.append(first, len(order))))
            hit = np.zeros((wide + 1, n), bool)
            hit[t, k] = whose > smallest
            # The smallest document of this batch may not be the smallest of a stretch that goes on beyond it.
            ahead = (whose == smallest) & (length - t <= far[k])
            yield pa.RecordBatch.from_arrays([pa.array(pos[k[ahead]] - t[ahead]), pa.array(np.ones(int(ahead.sum()), np.int32)),
                                              pa.array(value[ahead].view(np.int64)), pa.array(whose[ahead])], schema=_ARROW_HIT)
            # Runs of hits before one anchor, from the far end to the near one.
            k, t = np.nonzero((hit & ~np.vstack((hit[1:], np.zeros((1, n), bool)))).T)
            _, near = np.nonzero((hit & ~np.vstack((np.zeros((1, n), bool), hit[:-1]))).T)
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pos[k] - t), pa.array((t - near + 1).astype(np.int32)), none, none], schema=_ARROW_HIT)

    return rows.mapInArrow(run, _HIT)


def _hit_strings(chunks: DataFrame, scratch: Scratch, letter: int, length: int) -> DataFrame:
    """(pos, n) of neighbouring strings that a smaller document has, from the order of all suffixes."""
    letters = _sorted(chunks, lambda some, bounds: _triples_of_letters(some, bounds, letter, length))
    names, cover = scratch.write(_in_order(letters), "names"), 3 * letter

    def coarser() -> DataFrame:
        same = _same_names(names)
        return _sorted(chunks, lambda some, bounds: _triples_of_names(some, bounds, names, same, cover, letter, length))

    while 3 * cover < length:
        longer = scratch.write(_in_order(coarser()), "names")
        scratch.drop(names)
        names, cover = longer, 3 * cover
    found = scratch.write(_judged(coarser(), length, length - anchor_bytes(length) + 1), "hits")
    scratch.drop(names)
    unsettled = found.where("hash is not null")
    least = scratch.write(unsettled.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                          .where("first < last").drop("last"), "least")
    late = unsettled.join(least, "hash").where("doc > first")
    return found.where("hash is null").select("pos", "n").union(late.select("pos", "n"))


def _once(rows: pa.Table) -> pa.Table:
    """Rows of each place once."""
    _, first = np.unique(rows.column("pos").to_numpy(), return_index=True)
    return rows.take(pa.array(first))


_SPAN = "doc long, sum long, starts array<int>, ends array<int>"
_ARROW_SPAN = pa.schema([("doc", pa.int64()), ("sum", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def merged(starts_: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans with those that touch or overlap made one, in order."""
    if not len(starts_):
        return starts_, ends
    order = np.argsort(starts_, kind="stable")
    a, b = starts_[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(a)) - 1]


def _block_spans(chunks: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """(doc, sum, starts, ends): spans of bytes to remove of each block that has any."""
    def run(left: pa.Table, found: pa.Table) -> pa.Table:
        if not left.num_rows or not found.num_rows:
            return _ARROW_SPAN.empty_table()
        row = left.to_pylist()[0]
        place = found.column("pos").to_numpy() - (row["chunk"] << PLACE_BITS)
        # Blocks are further apart than their spans reach, so that spans of two never meet.
        a, b = merged(place, place + found.column("n").to_numpy() + (length - 1))
        begins = np.array(row["starts"], np.int64)
        block = np.searchsorted(begins, a, side="right") - 1
        at = np.flatnonzero(starts(block))
        out = [(row["docs"][k], row["sums"][k], a[i:j] - begins[k], b[i:j] - begins[k])
               for i, j, k in zip(at.tolist(), np.append(at[1:], len(block)).tolist(), block[at].tolist())]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_ARROW_SPAN)], schema=_ARROW_SPAN)

    keyed = hits.select(F.shiftright("pos", PLACE_BITS).alias("chunk"), "pos", "n")
    return chunks.groupBy("chunk").cogroup(keyed.groupBy("chunk")).applyInArrow(run, _SPAN)


def removed_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", letter: int = LETTER) -> DataFrame:
    """(doc, sum, starts, ends) of texts that lose bytes: spans of bytes, which may overlap.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  Strings are judged on the
    texts as they come, and none crosses texts.  Null texts are empty, texts under ``length`` bytes lose nothing.  A null id is the
    largest (``doc`` 2 ** 63 - 1).  Rows of one id are one document: they do not lose to each other, and rows repeated as a whole are
    reported once.  ``sum`` is xxhash64 of the text.  No rows: no rows.  Runs jobs; other columns are not read.
    """
    if not 1 <= letter <= 8 or length <= 3 * letter:
        raise ValueError("letters have 1 to 8 bytes, strings more than three letters")
    scratch = Scratch(docs.sparkSession)
    return _spans(_keyed(docs, id_col, text_col), length, letter, scratch)


def _spans(texts: DataFrame, length: int, letter: int, scratch: Scratch) -> DataFrame:
    """(doc, sum, starts, ends) of spans to remove of ``texts`` (doc, sum, text)."""
    gram, cover = anchor_bytes(length), letter
    while cover < length:
        cover *= 3
    places = scratch.write(_shared_anchors(texts, length, gram).groupBy("doc").agg(F.collect_list("place").alias("places")), "anchors")
    blocks = scratch.write(_blocks(texts, places, length, gram), "blocks")
    scratch.drop(places)
    # Equal digests have equal bytes, so any row's will do; aggregated before the shuffle, however often a block is there.
    distinct = blocks.groupBy("high", "low").agg(F.min("doc").alias("doc"), F.any_value("data").alias("text"))
    chunks = scratch.write(_chunks(distinct.select("doc", F.col("low").alias("sum"), "text"), cover + length), "chunks")
    narrow = scratch.write(blocks.drop("data"), "block-places")
    scratch.drop(blocks)
    inner = scratch.write(_block_spans(chunks, _hit_strings(chunks, scratch, letter, length), length), "spans")
    scratch.drop(chunks)
    firsts = narrow.groupBy("high", "low").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    whole = (narrow.join(scratch.write(firsts, "firsts"), ["high", "low"]).where("doc > first")
             .select("doc", "sum", F.array("start").alias("starts"), F.array(F.col("start") + F.col("strings") + (length - 1)).alias("ends")))
    shift = lambda c: F.transform(c, lambda x: x + F.col("start"))
    inside = narrow.join(inner.withColumnRenamed("sum", "low"), ["doc", "low"]).select(
        "doc", "sum", shift("starts").alias("starts"), shift("ends").alias("ends"))
    out = scratch.write(whole.unionByName(inside).groupBy("doc", "sum").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "removed")
    for frame in (narrow, inner):
        scratch.drop(frame)
    return out


def drop_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", letter: int = LETTER) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept) per row: bytes removed in order, and the rest as bytes.

    See ``removed_spans`` for which go.  Every row of ``docs`` comes back, with its own id; what is left of a text
    may end inside a character, so ``kept`` is binary.
    """
    spans = removed_spans(docs, length, id_col, text_col, letter)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), order_id(F.col(id_col).cast("long")).alias("doc"),
                       F.xxhash64(text).alias("sum"), text.cast("binary").alias("text"))
    joined = rows.join(spans.hint("shuffle_hash"), ["doc", "sum"], "left").select("doc_id", "text", "starts", "ends")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 1000):
            sizes, removed, kept = [], [], []
            for text, a, b in zip(batch.column(1), batch.column(2), batch.column(3)):
                data, spans = text.as_py(), []
                sizes.append(len(data))
                if a.is_valid:
                    spans = list(zip(*(x.tolist() for x in merged(a.values.to_numpy().astype(np.int64), b.values.to_numpy().astype(np.int64)))))
                    edges = [0, *(e for s in spans for e in s), len(data)]
                    data = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                removed.append([{"start": x, "end": y} for x, y in spans])
                kept.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)),
                                              pa.array(kept, pa.binary())], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
