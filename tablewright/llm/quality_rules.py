"""Line-first cleaning: rules per line, failed lines go, documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, per_text, slices

# Characters that the base metrics count as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of site furniture, matched in lines of few words.
BOILERPLATE = ("all rights reserved", "copyright", "licensed under", "terms of service", "terms of use",
               "privacy policy", "cookie", "javascript", "lorem ipsum", "subscribe", "newsletter", "click here",
               "read more", "share this", "sign in", "log in", "sign up", "powered by")
SPACE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    """Thresholds.  Shares are of a line's or a document's words or word characters."""

    line_symbols: float = 0.5      # symbols per word above which a line fails
    line_shouts: float = 0.5       # exclamation and question marks per word
    line_bars: float = 0.15        # vertical bars per word
    line_one_word: float = 0.5     # share of one word in a line of ``repeat_words`` words or more
    repeat_words: int = 10
    nav_words: int = 12            # lines up to this length may be navigation
    separators: int = 2            # separators that make a line navigation
    boilerplate_words: int = 30    # longest line that a phrase can make boilerplate
    max_lost: float = 0.5          # a document losing more of its word characters is rejected
    min_words: int = 10
    max_repeat_percent: int = 20


_ENDS = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_SEPARATOR = re.compile(r"[|»›•·]|(?:^|\s)[>/-](?=\s|$)")


def line_fails(line: bytes, rules: Rules) -> str | None:
    """The rule that a line with words breaks: punctuation, repetition, navigation or boilerplate."""
    words = line.split()
    n = len(words)
    symbols = sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"~", b"^", b"=", b"\\")))
    if symbols > rules.line_symbols * n:
        return "navigation" if line.count(b"|") * 2 >= symbols else "punctuation"
    if n > 2 and line.count(b"|") > rules.line_bars * n:
        return "navigation"
    if n > 2 and line.count(b"!") + line.count(b"?") > rules.line_shouts * n:
        return "punctuation"
    # A word cannot come oftener than what the different ones leave.
    if n >= rules.repeat_words and n - len(set(words)) + 1 > rules.line_one_word * n:
        if max(Counter(words).values()) > rules.line_one_word * n:
            return "repetition"
    if n <= max(rules.nav_words, rules.boilerplate_words):
        text = line.decode("utf-8", "replace").strip()
        if n <= rules.nav_words and len(_SEPARATOR.findall(text)) >= rules.separators:
            return "navigation"
        if n <= rules.boilerplate_words and _PHRASES.search(text):
            return "boilerplate"
        if n <= rules.nav_words and not _ENDS.search(text):
            return "punctuation"
    return None


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words stand in a window of ``width`` words that the text has twice or more."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    windows, kinds = ids, len(seen)
    base = len(seen)
    for k in range(1, width):
        if kinds > (1 << 62) // max(base, 1):  # pack again, so that a number still names one window
            _, windows = np.unique(windows, return_inverse=True)
            kinds = len(windows)
        windows = windows[:-1] * base + ids[k:]
        kinds *= base
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows) + 1, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice[:len(windows)])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def clean_text(data: bytes, rules: Rules) -> tuple[bytes, int, int, int, int]:
    """(text without failed lines, lines with words, failed lines, word characters, lost word characters)."""
    kept, n_lines, failed, total, lost = [], 0, 0, 0, 0
    for line in data.split(b"\n"):
        if not line.strip(SPACE):
            kept.append(line)
            continue
        n_lines += 1
        size = code_points(line) - sum(map(line.count, (b" ", b"\t", b"\r", b"\x0b", b"\x0c")))
        total += size
        if line_fails(line, rules):
            failed += 1
            lost += size
        else:
            kept.append(line)
    return b"\n".join(kept), n_lines, failed, total, lost


def judge_text(data: bytes, rules: Rules) -> tuple:
    words = data.split()
    n = len(words)
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    _, n_lines, failed, chars, lost = clean_text(data, rules)
    kept = not base_failed and lost <= rules.max_lost * chars
    symbols = sum(data.count(c.encode()) for c in SYMBOLS)
    return n, chars, symbols, dup, repeat, base_failed, kept, n_lines, failed, lost


METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, lost_chars long")


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics and verdict of every document, one row per input row.

    Null text is empty text: no words, ``base_failed``.  Null ids and repeated rows are
    judged like any other row; further columns are ignored.  Nothing is shuffled.
    """
    return per_text(docs, METRICS, lambda data: judge_text(data, rules), id_col, text_col)


def clean(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents that pass, without their failed lines; all columns stay as they are.

    ``length_col``, if there, is set to the new number of characters.  Documents are judged
    on the whole text, before lines go.  Null texts are rejected.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 500):  # a batch of texts is in memory several times
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            keep = [judge_text(d, rules)[6] for d in data]
            texts = [clean_text(d, rules)[0].decode("utf-8", "replace") for d, k in zip(data, keep) if k]
            field = batch.schema.field(at)
            yield batch.filter(pa.array(keep, pa.bool_())).set_column(at, field, pa.array(texts, field.type))

    out = docs.mapInArrow(run, docs.schema)
    return with_length(out, text_col, length_col)


def with_length(docs: DataFrame, text_col: str, length_col: str | None) -> DataFrame:
    """``length_col`` follows the text, in its own type, where there is such a column."""
    if length_col is None or length_col not in docs.columns:
        return docs
    return docs.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
