"""SimHash near duplicates: fingerprints, grid range-join on segment popcounts, components.

A fingerprint is embedded as the bit counts of its 2-bit segments.  The Manhattan distance of
two embeddings is at most the Hamming distance of the fingerprints, so only embeddings within
``max_bits`` can belong together.  The axes fall into ``max_bits + 3`` blocks; embeddings
within ``max_bits`` agree on three blocks at least, so the grid has one cell for each choice of
three blocks and their exact counts, and neighbours meet in at least one cell.  Inside a cell
the exact distance is verified in the join itself.

Cells that hold more than ``CELL`` fingerprints would pair up quadratically.  Their fingerprints are
linked through midpoints instead: two values are within 2h bits exactly if some value is
within h bits of both.  A midpoint has at most as many fingerprints around it as there are
such values, so this stays linear and loses no link.

Two bits are far less than what texts of similarity 0.8 differ in (mostly 3 to 11), and at such
distances no bit counts prune.  ``keep_one`` therefore adds the links of shingle sets that are
at least that similar: candidates share a band of minima, and each is verified on the whole sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import cut
from .base import as_row, fresh, per_text

#: Fingerprints in a cell beyond which midpoints take the place of pairs.
CELL = 32
#: Words in a shingle of the similarity that ``keep_one`` goes by.
SHINGLE = 5
#: Bands and minima per band: sets of similarity 0.8 share a band in 99.96 of 100 cases.
BANDS, ROWS = 20, 5
#: Four bits of each minimum make a sketch.  At similarity 0.8 its bits differ in 40 places on average; over 90 has a chance
#: of some 1 in 5 million, while sets of similarity 0.4 differ in 120.
SKETCH_LONGS, SKETCH_BITS = -(-BANDS * ROWS * 4 // 64), 90
_BITS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", i) | 1 for i in range(BANDS * ROWS)], np.uint64)
_OFFSETS = np.array([xxhash.xxh64_intdigest(b"offset", i) for i in range(BANDS * ROWS)], np.uint64)


def _hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of every word shingle of the text, in order, as big-endian unsigned longs."""
    words = data.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(begins[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())],
                    ">u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(data: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles; no words: 0."""
    return _majority(_hashes(data, width))


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The different shingles of five words (of all words, where there are fewer), as sorted hashes.

    A shingle of five words is known by the ``width``-word shingles in it, so no word is hashed again.
    """
    hashes = hashes.astype(np.uint64)
    inner = min(SHINGLE - width, max(len(hashes) - 1, 0))
    n = len(hashes) - inner
    out = hashes[:n]
    for j in range(1, inner + 1):
        out = (out ^ (out >> np.uint64(29))) * _ODD + hashes[j:j + n]
    return np.unique(out)


def _signed(data: bytes, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(data, seed)).astype(np.int64))


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of BANDS * ROWS functions."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 10):
        least = np.minimum(least, (shingles[at:at + (1 << 10), None] * _FACTORS + _OFFSETS).min(axis=0))
    return least


def _bands(minima: np.ndarray) -> list[int]:
    """One hash per band: equal with chance s ** ROWS for shingle sets of similarity s."""
    return [_signed(band.tobytes(), i) for i, band in enumerate(minima.reshape(BANDS, ROWS))]


def _sketch(minima: np.ndarray) -> list[int]:
    """Four bits of each minimum, as longs."""
    four = ((minima * _ODD) >> np.uint64(60)).astype(np.uint8)
    packed = np.zeros(SKETCH_LONGS * 8, np.uint8)
    packed[:len(four) // 2] = four[::2] << 4 | four[1::2]
    return packed.view(np.int64).tolist()


def _close(a: Column, b: Column) -> Column:
    """Whether sketches differ in at most ``SKETCH_BITS`` bits."""
    bits = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_LONGS)]
    return sum(bits[1:], bits[0]) <= SKETCH_BITS


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; null text is empty text."""
    return per_text(docs, "fp long", lambda data: (fingerprint(data, width),), id_col, text_col)


def _profiles(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, set_id, n, bands, sketch): fingerprint, and id, size, bands and sketch of the shingle set."""
    def profile(data):
        hashes = _hashes(data, width)
        shingles = _shingles(hashes, width)
        minima = _minima(shingles)
        bands, sketch = (_bands(minima), _sketch(minima)) if len(shingles) else ([], [])
        return _majority(hashes), _signed(shingles.tobytes()), len(shingles), bands, sketch

    return per_text(docs, "fp long, set_id long, n long, bands array<long>, sketch array<long>", profile, id_col, text_col)


def _segment_counts(block: Column) -> Column:
    """Bit counts of the 2-bit segments of a long, each in its two bits."""
    ones = F.lit(0x5555555555555555)
    low, high = block.bitwiseAND(ones), F.shiftrightunsigned(block, 1).bitwiseAND(ones)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _blocks(count: int) -> list[int]:
    """Masks of ``count`` runs of whole segments, as signed longs."""
    edges = [round(i * _BITS / 2 / count) * 2 for i in range(count + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << _BITS) if m >> (_BITS - 1) else m for m in masks]


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    """(cell, counts, fp): every grid cell that a fingerprint lies in."""
    counts = _segment_counts(F.col("fp"))
    keys = [F.struct(F.lit(i).cast("short").alias("grid"), F.col("counts").bitwiseAND(F.lit(_or(chosen))).alias("counts"))
            for i, chosen in enumerate(combinations(_blocks(max_bits + 3), 3))]
    return fps.withColumn("counts", counts).select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _or(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def near_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp``, enough to connect all within ``max_bits``.

    Every pair in a cell of up to ``CELL`` fingerprints is verified; those of fuller cells
    are linked through shared midpoints, which connects exactly the same fingerprints.
    ``max_bits`` has to be even.
    """
    if max_bits % 2:
        raise ValueError("max_bits has to be even: midpoints lie at half of it")
    cells = cut(_cells(fps, max_bits), "grid")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut(sizes, "grid-sizes")
    few = cells.join(sizes.where(F.col("n") <= CELL), "cell")
    # One list per cell of at most CELL fingerprints; pairs come out verified only.
    lists = few.groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = (lists.select(F.posexplode("fps").alias("at", "a"), "fps")
             .select("a", F.explode(F.filter(
                 F.slice("fps", F.col("at") + 2, F.size("fps")),
                 lambda b: F.bit_count(b.bitwiseXOR(F.col("a"))) <= max_bits)).alias("b")))
    crowded = cells.join(sizes.where(F.col("n") > CELL), "cell", "left_semi").select("fp").distinct()
    flips = [0] + [_or(c) for k in range(1, max_bits // 2 + 1)
                   for c in combinations([1 << i if i < _BITS - 1 else -(1 << i) for i in range(_BITS)], k)]
    near = crowded.select("fp", F.explode(F.transform(
        F.array(*map(F.lit, flips)), lambda x: x.bitwiseXOR(F.col("fp")))).alias("middle"))
    # At most len(flips) fingerprints share a midpoint, so its window is small.
    stars = near.select(F.min("fp").over(Window.partitionBy("middle")).alias("a"), F.col("fp").alias("b")).where("a != b")
    return pairs.union(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches.

    Alternates large and small stars until nothing changes; every round is written, so lineage stays flat.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .where("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each smaller neighbour, and the node itself, moves to the node's smallest neighbour.
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        edges = cut(small, "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def similar_links(docs: DataFrame, profiles: DataFrame, similarity: float, width: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(a, b) links between fingerprints of texts whose sets of five-word shingles are similar enough.

    ``profiles`` is what ``_profiles`` gives for ``docs``, written.  Equal sets are one node.  All
    pairs of a band of up to ``CELL`` sets are verified.  In a fuller one every set is held against
    one hub; after that only sets in another component than the hub's meet the rest of their band,
    so a group of close copies costs one comparison each.  Of these pairs those with close sketches go on
    to be verified: different texts around one common passage share bands, yet their sketches are far apart.
    """
    sets = cut(profiles.where("n > 0").dropDuplicates(["set_id"]).select("set_id", "n", "fp", "bands", "sketch"), "shingle-sets")
    equal = (profiles.where("n > 0").select("set_id", F.col("fp").alias("b")).distinct()
             .join(sets.select("set_id", F.col("fp").alias("a")), "set_id").where("a != b").select("a", "b"))
    node = F.struct("set_id", "n", "fp").alias("node")
    cells = cut(sets.select(F.explode("bands").alias("band"), node), "bands")
    sizes = cut(cells.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1"),
                "band-sizes")

    def alike(a: Column, b: Column) -> Column:
        """Whether sizes, and the nodes themselves, leave a chance."""
        return (F.least(a["n"], b["n"]) / F.greatest(a["n"], b["n"]) >= similarity) & (a["fp"] != b["fp"])

    lists = (cells.join(sizes.where(F.col("members") <= CELL).select("band"), "band")
             .groupBy("band").agg(F.array_sort(F.collect_list("node")).alias("nodes")))
    pairs = (lists.select(F.posexplode("nodes").alias("at", "a"), "nodes")
             .select("a", F.explode(F.filter(F.slice("nodes", F.col("at") + 2, F.size("nodes")),
                                             lambda b: alike(F.col("a"), b))).alias("b")))
    crowded = cut(cells.join(sizes.where(F.col("members") > CELL).select("band", "hub"), "band"), "crowded-bands")
    stars = crowded.select(F.col("hub").alias("a"), F.col("node").alias("b")).where(alike(F.col("a"), F.col("b")))
    links = _verified(docs, profiles, pairs.unionAll(stars).distinct(), similarity, width, id_col, text_col)
    if crowded.isEmpty():
        return links.unionAll(equal)
    roots = components(links.unionAll(equal)).select(F.col("node").alias("of"), "root")
    own = crowded.join(roots, F.col("node.fp") == F.col("of"), "left").select(
        "band", "node", "hub", F.coalesce("root", "node.fp").alias("own_root"))
    rooted = own.join(roots, F.col("hub.fp") == F.col("of"), "left").select(
        "band", "node", F.col("own_root").alias("root"), F.coalesce("root", "hub.fp").alias("hub_root"))
    sketches = sets.select(F.col("set_id").alias("of_set"), "sketch")
    rooted = cut(rooted.join(sketches, F.col("node.set_id") == F.col("of_set")).drop("of_set"), "rooted-bands")
    apart = rooted.where("root != hub_root").select("band", F.col("node").alias("a"), F.col("root").alias("a_root"),
                                                    F.col("sketch").alias("a_sketch"))
    rest = rooted.select("band", F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("sketch").alias("b_sketch"))
    across = (apart.join(rest, "band")
              .where((F.col("a_root") != F.col("b_root")) & alike(F.col("a"), F.col("b"))
                     & _close(F.col("a_sketch"), F.col("b_sketch")))
              .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return links.unionAll(_verified(docs, profiles, across, similarity, width, id_col, text_col)).unionAll(equal)


def _verified(docs: DataFrame, profiles: DataFrame, pairs: DataFrame, similarity: float, width: int, id_col: str,
              text_col: str) -> DataFrame:
    """(a, b) fingerprints of the ``pairs`` of nodes whose whole shingle sets are similar enough."""
    pairs = cut(pairs, "candidates")
    wanted = cut(pairs.select(F.explode(F.array("a.set_id", "b.set_id")).alias("set_id")).distinct(), "wanted-sets")
    # One text per set is read again; which sets the rows without an id have shows only then.
    ids = (profiles.select("set_id", "doc_id").where("doc_id is not null").join(wanted, "set_id", "left_semi")
           .groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(cut(ids, "wanted-ids"), "doc_id", "left_semi").unionAll(rows.where("doc_id is null"))

    def shingles(data):
        found = _shingles(_hashes(data, width), width)
        return _signed(found.tobytes()), found.view(np.int64)

    sets = cut(per_text(rows, "set_id long, shingles array<long>", shingles, rows_out=64).join(wanted, "set_id", "left_semi")
               .dropDuplicates(["set_id"]).select("set_id", "shingles"), "wanted-shingles")
    left = sets.select(F.col("set_id").alias("a_id"), F.col("shingles").alias("a_shingles"))
    right = sets.select(F.col("set_id").alias("b_id"), F.col("shingles").alias("b_shingles"))
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    enough = shared / (F.col("a.n") + F.col("b.n") - shared) >= similarity
    return cut(pairs.join(left, F.col("a.set_id") == F.col("a_id")).join(right, F.col("b.set_id") == F.col("b_id"))
               .where(enough).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")), "similar")


def grouped(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
            similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) per row, and (fp, root, component_id) per distinct fingerprint.

    With ``similarity`` the links of ``similar_links`` count too.
    """
    if similarity is None:
        prints = profiles = cut(fingerprints(docs, width, id_col, text_col), "fingerprints")
    else:
        profiles = cut(_profiles(docs, width, id_col, text_col), "profiles")
        prints = profiles.select("doc_id", "fp")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = near_links(distinct.select("fp"), max_bits)
    several = (prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
               .where("a != b").select("doc_id", "a"))
    same_id = prints.join(several, "doc_id").select("a", F.col("fp").alias("b")).where("a != b")
    if similarity is not None:
        links = links.unionAll(similar_links(docs, profiles, similarity, width, id_col, text_col))
    roots = components(links.unionAll(same_id))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, cut(rooted.join(smallest, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``.

    ``component_id`` is the smallest id reachable over fingerprints that differ in at most
    ``max_bits`` bits, the row's own included.  Null and empty texts have fingerprint 0 and
    are linked like any other.  Rows with one id are linked too, being one document; null ids
    stay rows of their own and take the smallest id they reach, or null if there is none.
    """
    prints, named = grouped(docs, width, max_bits, id_col, text_col)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
             similarity: float | None = 0.8) -> DataFrame:
    """One row of each group of near duplicates, all columns as they are: a row of the smallest id.

    Near are fingerprints within ``max_bits`` bits, and texts whose different five-word shingles
    have a Jaccard similarity of ``similarity`` or more (None: fingerprints alone).  ``width`` is 5
    at most.  Rows without an id stay only where the group has no id at all; then one of them does.
    """
    prints, named = grouped(docs, width, max_bits, id_col, text_col, similarity)
    smallest = named.select(F.col("component_id").alias("keep_id")).where("keep_id is not null").distinct()
    # Copies of the kept row are merged map side before they meet.
    kept = (as_row(docs, keep_id=F.col(id_col).cast("long")).join(smallest, "keep_id", "left_semi").dropDuplicates(["keep_id"])
            .select("row.*"))
    if prints.where("doc_id is null").isEmpty():
        return kept
    loose = docs.where(F.col(id_col).isNull())
    at, mark = docs.columns.index(text_col), fresh(docs, "mark")

    def run(batches):
        for batch in batches:
            marks = pa.array([fingerprint((t or "").encode(), width) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, mark])

    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])
    alone = named.where("component_id is null").select("fp", "root")
    marked = as_row(loose.mapInArrow(run, schema), fp=F.col(mark))
    return kept.unionAll(marked.join(alone, "fp").dropDuplicates(["root"]).select("row.*").drop(mark))
