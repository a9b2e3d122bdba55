"""Benchmark decontamination by templates: typed placeholders, hashed windows, slot consistency.

Texts become tokens.  Numbers, units behind numbers and capitalised names inside a sentence turn into typed
placeholders; other words are lower-cased without the marks around them.  Each window of
tokens has a hash, once as a template and once with its names read as plain words (so a
change of case hides nothing).  Windows of documents pass a bit table built from the
benchmark's hashes, as large as their number asks for, and what passes joins the benchmark's windows.  Windows of a
passage count if slots that are equal on one side are equal on the other, in a window and from window to window, so one
question with other numbers is caught and an unlike use of the same template is not.  Items that these
readings do not hold (short, full of numbers, or written without spaces) are matched word by
word, marks and numbers as they stand.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .base import Remembered, as_row, kept, order_id

# Unit words that become a placeholder behind a number.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles mg g kg lb lbs oz ton tons gram grams "
         "kilogram kilograms pound pounds ml l liter liters litre litres gallon gallons second seconds sec minute minutes "
         "min hour hours day days week weeks month months year years percent % dollar dollars euro euros cent cents usd eur "
         "meter meters metre metres kilometer kilometers kilometre kilometres degree degrees mph kmh watt watts volt volts").split()

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|k|m)?")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
# Kinds of tokens; PLAIN is everything else.
PLAIN, NUMBER, UNIT, CAPITAL, _MARK = 0, 1, 2, 3, 4
_ASCII_MARKS = string.punctuation
#: Stands for a line end among words; its byte occurs in no UTF-8 text.
_LINE_END = b" \xff "
_HASH_BITS = np.uint64((1 << 64) - 16)
_UNIT_WORDS = frozenset(UNITS)
# Scripts written without spaces between words: Thai to Tibetan, Myanmar, Khmer, kana, ideographs.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u3029\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af]")
_LEADS = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")
#: Readings: numbers and units are slots; names too; nothing is.
PLAINLY, TEMPLATE, LITERAL = 0, 1, 2
_PLACEHOLDER = {NUMBER: "<number>", UNIT: "<unit>", CAPITAL: "<name>"}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


_KIND_HASH = np.array([0] + [_hash(_PLACEHOLDER[k]) for k in (NUMBER, UNIT, CAPITAL)], np.uint64)


def token(raw: bytes) -> int:
    """What a raw word stands for: the hash of its plain form above four bits of kind and whether it ends a sentence.

    Marks alone are no words; the line end is a mark that ends a sentence.  A signed long, as arrays take it.
    """
    text = raw.decode("utf-8", "replace")
    ends = raw == _LINE_END.strip()
    if text.isalpha():
        core = text
    else:
        core = text.strip(_ASCII_MARKS)
        if core and not (core[0].isalnum() and core[-1].isalnum()):
            core = _EDGE.sub("", core)
        ends = ends or text.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", "…")
    plain = core.lower()
    if not core:
        kind = _MARK
    elif not core.isalpha() and _NUMBER.fullmatch(core):
        kind = NUMBER
    elif plain in _UNIT_WORDS:
        kind = UNIT
    else:
        kind = CAPITAL if core[0].isupper() and not core.isupper() else PLAIN
    value = _hash(plain or text) & ~15 | kind << 1 | ends
    return value - (1 << 64) if value >> 63 else value


def known_tokens() -> Remembered:
    """One dictionary of words per worker process."""
    return kept("tokens", lambda: Remembered(token, 250_000))


def canonical(text: bytes, tokens: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, kind of each word); marks standing alone are left out.

    Capitals that open a line or sentence are plain, units count behind a number only.
    """
    words = text.replace(b"\n", _LINE_END).split()
    codes = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words)).view(np.uint64)
    hashes, flags = codes & _HASH_BITS, (codes & np.uint64(15)).astype(np.int8)
    kinds, ends = flags >> 1, (flags & 1).astype(bool)
    word = np.flatnonzero(kinds != _MARK)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    # A word opens a sentence if anything since the word before it ended one.
    closed = np.concatenate(([0], np.cumsum(ends)))
    opening = closed[word] > closed[np.concatenate(([0], word[:-1]))]
    opening[0] = True
    kinds = kinds[word]
    after = np.concatenate(([False], kinds[:-1] == NUMBER))
    kinds[(kinds == CAPITAL) & opening | (kinds == UNIT) & ~after] = PLAIN
    return hashes[word], kinds


def literal_words(text: bytes, tokens: Remembered) -> tuple[np.ndarray, bool]:
    """(hash of each word or mark as it stands, whether a script without spaces is in it).

    Characters of such scripts are words of their own, as what stands beside a copy is not set off.
    """
    unspaced = False
    if _LEADS.search(text):
        apart, n = _UNSPACED.subn(r" \g<0> ", text.decode("utf-8", "replace"))
        if unspaced := n > 0:
            text = apart.encode("utf-8")
    words = text.split()
    codes = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words)).view(np.uint64)
    return codes, unspaced


def literal_item(text: bytes, tokens: Remembered) -> tuple[np.ndarray, bool]:
    """The same of an item: marks at its ends are left out, as a copy can have others there."""
    codes, unspaced = literal_words(text, tokens)
    word = np.flatnonzero((codes & np.uint64(15)) >> np.uint64(1) != _MARK)
    return (codes[word[0]:word[-1] + 1] if len(word) else codes) & _HASH_BITS, unspaced


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
            out ^= out >> np.uint64(29)
    return out


def shapes(values: np.ndarray) -> list[int]:
    """Which slots are equal: for each, the place of the first with its value."""
    seen: dict = {}
    return [seen.setdefault(v, i) for i, v in enumerate(values.tolist())]


def _windows(hashes: np.ndarray, kinds: np.ndarray, width: int, literal: int):
    """(reading, slots, window hashes, allowed) for the plain (0) and the template (1) reading.

    Allowed windows have ``literal`` plain words or more, as placeholders alone prove nothing;
    template windows without a name are left to the plain reading, which has them too.
    """
    names = np.concatenate(([0], np.cumsum(kinds == CAPITAL)))
    for reading in (0, 1) if names[-1] else (0,):
        slot = (kinds == NUMBER) | (kinds == UNIT) | ((kinds == CAPITAL) if reading else False)
        codes = np.where(slot, _KIND_HASH[np.where(slot, kinds, 0)], hashes)
        plain = np.concatenate(([0], np.cumsum(~slot)))
        allowed = plain[width:] - plain[:-width] >= min(literal, width)
        if reading:
            allowed &= names[width:] > names[:-width]
        yield reading, slot, window_hashes(codes, width), allowed


_FIELDS = "owner long, sum long, position int, n_tokens int, reading short, hash long, shape array<short>, slots array<long>, firsts array<int>"
_ARROW = pa.schema([("owner", pa.int64()), ("sum", pa.int64()), ("position", pa.int32()), ("n_tokens", pa.int32()),
                    ("reading", pa.int16()), ("hash", pa.int64()), ("shape", pa.list_(pa.int16())), ("slots", pa.list_(pa.int64())),
                    ("firsts", pa.list_(pa.int32()))])


def template_windows(texts: DataFrame, width: int = 8, literal: int = 5, id_col: str = "doc_id", text_col: str = "text",
                     widths: list[int] | None = None, table: bytes | None = None, literal_widths: list[int] = (),
                     min_tokens: int = 1) -> DataFrame:
    """(owner, sum, position, n_tokens, reading, hash, shape, slots, firsts) of each window.

    Without ``widths`` texts are items: one of fewer than ``width`` words is one window.  Items of fewer than
    ``min_tokens`` words, without an allowed window, or with a script without spaces have literal windows;
    the first two have no others.  With ``widths``,
    windows of each of these widths are made (literal ones of ``literal_widths``, each once), and only hashes marked in ``table`` pass.
    ``slots`` are the hashes of what stands in the window's slots, ``shape`` says which of them are equal; ``firsts``, of items, where
    in the text each stands first.  ``sum`` is xxhash64 of the text.
    """
    shared = texts.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = known_tokens()
        bits = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for batch in batches:
            owner, position, length, readings, found, shape, slots, firsts = [], [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                data = text.as_py() or b""
                hashes, kinds = canonical(data, tokens)
                n, before = len(hashes), len(owner)
                first: dict = {}
                if widths is None:
                    for i, h in enumerate(hashes.tolist()):
                        first.setdefault(h, i)
                for w in widths if widths is not None else [min(width, n)]:
                    if not 0 < w <= n or widths is None and n < min_tokens:
                        continue
                    for reading, slot, made, allowed in _windows(hashes, kinds, w, literal):
                        if bits is not None:
                            allowed &= marked(bits, made)
                        for p in np.flatnonzero(allowed).tolist():
                            owner.append(row)
                            position.append(p)
                            length.append(n)
                            readings.append(reading)
                            found.append(made[p])
                            values = hashes[p:p + w][slot[p:p + w]]
                            shape.append(shapes(values))
                            slots.append(values.view(np.int64))
                            firsts.append([first[v] for v in values.tolist()] if first else [])
                if widths is None:
                    codes, unspaced = literal_item(data, tokens)
                    wanted = [min(width, len(codes))] if unspaced or len(owner) == before else []
                elif wanted := literal_widths:
                    codes = literal_words(data, tokens)[0] & _HASH_BITS
                for w in wanted:
                    if not 0 < w <= len(codes):
                        continue
                    made = window_hashes(codes, w)
                    places = np.arange(len(made))
                    if bits is not None:
                        places = np.flatnonzero(marked(bits, made))
                        places = places[np.unique(made[places], return_index=True)[1]]
                    owner += [row] * len(places)
                    position += places.tolist()
                    length += [len(codes)] * len(places)
                    readings += [LITERAL] * len(places)
                    found += made[places].tolist()
                    shape += [[]] * len(places)
                    slots += [[]] * len(places)
                    firsts += [[]] * len(places)
            who = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(who), batch.column(1).take(who), pa.array(position, pa.int32()), pa.array(length, pa.int32()),
                 pa.array(readings, pa.int16()), pa.array(np.array(found, np.uint64).view(np.int64)),
                 pa.array(shape, pa.list_(pa.int16())), pa.array(slots, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int32()))], schema=_ARROW)

    text = F.col(text_col).cast("string")
    rows = texts.select(order_id(F.col(id_col).cast("long")).alias("owner"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("sum"),
                        text.cast("binary").alias("text"))
    return rows.mapInArrow(run, _FIELDS)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set in a table of a power of two of bits."""
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Bits of the table per window of the benchmark, and the logarithms of its least and its greatest size.  Where a benchmark
#: has more windows than that, more windows of documents pass on to the join; what is found stays the same.
BITS_PER_WINDOW, LEAST_LOG, MOST_LOG = 256, 24, 28


def bit_table(hashes: DataFrame) -> bytes:
    """A power of two of bits with those of ``hash`` set: a row per 64 bits comes to the driver, 2 ** 22 at most."""
    log_bits = min(max((hashes.count() * BITS_PER_WINDOW).bit_length(), LEAST_LOG), MOST_LOG)
    words = (hashes.select(F.shiftrightunsigned("hash", 6).bitwiseAND((1 << (log_bits - 6)) - 1).alias("word"),
                           F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    table = np.zeros(1 << (log_bits - 6), np.int64)
    for row in words:
        table[row["word"]] = row["bits"]
    return table.astype("<i8").tobytes()


def _consistent(hits: DataFrame) -> DataFrame:
    """Hits whose slots do not contradict each other.

    Windows of one passage lie as far from each other in the document as in the item.  Among those, what stands in an item's
    slot has to stand for one thing of the document, and the other way round; windows that hold something with
    two counterparts do not count.
    """
    passage = ["owner", "sum", "item_id", "item_sum", "literal", "shift"]
    hits = cut(hits.withColumn("shift", F.col("position") - F.col("item_position")), "window-hits")
    pairs = cut(hits.select(*passage, F.explode(F.arrays_zip("item_slots", "slots")).alias("p"))
                .select(*passage, F.col("p.item_slots").alias("theirs"), F.col("p.slots").alias("ours")).distinct(), "slot-pairs")

    def twice(one: str, other: str) -> DataFrame:
        """Per passage what has several counterparts: no more than the slots of an item's passage."""
        found = pairs.groupBy(*passage, one).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b")
        return found.groupBy(*passage).agg(F.collect_set(one).alias(f"bad_{one}"))

    bad = twice("theirs", "ours").join(twice("ours", "theirs"), passage, "full")
    none = F.array().cast("array<long>")
    marked_ = hits.join(cut(bad, "contradictions"), passage, "left")
    return marked_.where(~F.arrays_overlap("item_slots", F.coalesce("bad_theirs", none))
                         & ~F.arrays_overlap("slots", F.coalesce("bad_ours", none)))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, literal: int = 5, share: float = 0.3, enough: int = 40,
          min_tokens: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", members: bool = True) -> DataFrame:
    """(doc_id, sum, item_id, n_windows, n_item_windows, share) of each document and item it holds.

    A pair is reported if ``share`` of the item's windows, or ``enough`` of them, occur in the
    document with slots that are consistent over a whole passage.  Items that are the same template in all their words are joined once, as one class,
    and reported each (without ``members`` only the smallest).  Items of fewer than ``width`` words are one window.  Items of fewer than
    ``min_tokens`` words, without an allowed window (``literal``), or in a script without spaces are matched word by word, by a
    count of their own; the greater share is given.  Null or empty texts match nothing.  A null id is
    reported as the largest id; ``sum`` (xxhash64 of the text) tells rows with one id apart.
    """
    items = template_windows(benchmark, width, literal, item_col, item_text_col, min_tokens=min_tokens)
    items = cut(items.withColumn("literal", F.col("reading") == LITERAL).distinct(), "benchmark-windows")
    kinds = (items.groupBy("owner", "sum", "literal").agg(
        F.count(F.when(F.col("reading") != TEMPLATE, 1)).alias("n_item_windows"),
        F.sum(F.xxhash64("position", "reading", "hash", "shape", "firsts").cast("decimal(38,0)")).alias("template")))
    # Items with the same windows at the same places, and slots that are equal in the same places, are one class.
    classes = (kinds.groupBy("literal", "template", "n_item_windows").agg(F.min(F.struct("owner", "sum")).alias("first")))
    same = kinds.join(classes, ["literal", "template", "n_item_windows"]).select(
        F.col("first.owner").alias("item_id"), F.col("first.sum").alias("item_sum"), "literal",
        F.col("owner").alias("member_id"), F.col("sum").alias("member_sum"))
    templates = items.join(classes.select("first.owner", "first.sum", "literal", "n_item_windows"), ["owner", "sum", "literal"])
    templates = cut(templates.select(F.col("owner").alias("item_id"), F.col("sum").alias("item_sum"), F.col("position").alias("item_position"),
                           "reading", "hash", "shape", F.col("slots").alias("item_slots"), "literal", "n_item_windows", F.least("n_tokens", F.lit(width)).alias("width")), "templates")
    made = templates.select("literal", "width").distinct().collect()  # at most twice ``width`` of them
    widths, literal_widths = ([r["width"] for r in made if r["literal"] == kind] for kind in (False, True))
    found = template_windows(docs, width, literal, id_col, text_col, widths, bit_table(templates), literal_widths)
    hits = _consistent(found.join(templates.drop("width"), ["hash", "reading", "shape"]))
    # Partial counts per item place come before the shuffle; an item has few places.
    pairs = (hits.groupBy("owner", "sum", "item_id", "item_sum", "literal", "n_item_windows", "item_position").agg(F.lit(1))
             .groupBy("owner", "sum", "item_id", "item_sum", "literal", "n_item_windows").agg(F.count("*").alias("n_windows")))
    part = F.col("n_windows") / F.greatest("n_item_windows", F.lit(1))
    held = pairs.withColumn("share", part).where((F.col("share") >= share) | (F.col("n_windows") >= enough))
    if members:
        held = held.join(cut(same, "members"), ["item_id", "item_sum", "literal"])
    else:
        held = held.withColumns({"member_id": F.col("item_id"), "member_sum": F.col("item_sum")})
    best = F.max(F.struct("share", "n_windows", "n_item_windows")).alias("best")
    return (held.groupBy("owner", "sum", "member_id", "member_sum").agg(best)
            .select(F.col("owner").alias("doc_id"), "sum", F.col("member_id").alias("item_id"), "best.n_windows", "best.n_item_windows", "best.share"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are.  Options as for ``leaks``."""
    bad = cut(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **{"members": False, **options}).select("doc_id", "sum").distinct(), "leaks")
    keyed = as_row(docs, doc_id=order_id(F.col(id_col).cast("long")), sum=F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(bad.hint("shuffle_hash"), ["doc_id", "sum"], "left_anti").select("row.*")
