"""Extracting, applying and checking translations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as C
from ..cluster import cut
from ..contract import Dataset, TableContract, union_all
from ..functions.scalars import normalise_newlines, pack_id, trim_space
from .recursive import rewritten
from .search import leaves, text_leaves

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Characters of words and their translations that are sent to every task.
SENT_WORDS = 8_000_000


def _texts(dataset: Dataset) -> DataFrame:
    """Text leaves of tables that have any text field."""
    return union_all(leaves(dataset.frames[n], dataset.contracts[n], ("text",))
                     for n in dataset.names() if _has_text(dataset.contracts[n]))


def _has_text(contract: TableContract) -> bool:
    return any(_has_text_inside(f.type) for f in contract.fields)


def _has_text_inside(kind, seen: frozenset = frozenset()) -> bool:
    if isinstance(kind, str):
        return kind == "text"
    if id(kind) in seen:
        return False
    return any(_has_text_inside(k, seen | {id(kind)}) for k in _inner(kind))


def _inner(kind):
    for name in ("item", "key", "value"):
        if hasattr(kind, name):
            yield getattr(kind, name)
    for f in getattr(kind, "fields", ()):
        yield f.type
    yield from getattr(kind, "impls", ())


def extract_texts_by_value(dataset: Dataset) -> DataFrame:
    """``(table, original, translated)`` for every text that is not blank or has a translation, repeats included.

    A text has one where its table carries ``<field>_original`` beside a field that says something else, as
    `translate_by_value` and `translate_by_id` leave it; then the original is what that column says.
    """
    out = []
    for name in dataset.names():
        df, contract = dataset.frames[name], dataset.contracts[name]
        if not _has_text(contract):
            continue
        both = [n for n in contract.texts() if f"{n}_original" in df.columns]
        rest = contract.with_fields(f for f in contract.fields if f.name not in both or f.name in contract.key)
        if _has_text(rest):
            found = leaves(df, rest, ("text",))
            if both:
                found = found.where(~F.col("field_chain").isin(*both))
            out.append(found.select("table", trim_space("value").alias("original"), F.lit("").alias("translated")))
        for n in both:
            original, now = trim_space(f"{n}_original"), trim_space(n)
            out.append(df.select(F.lit(name).alias("table"), F.coalesce(original, F.lit("")).alias("original"),
                                 F.when(F.col(n).eqNullSafe(F.col(f"{n}_original")), "").otherwise(F.coalesce(now, F.lit(""))).alias("translated")))
    return union_all(out).where("original <> '' or translated <> ''")


def text_rows(dataset: Dataset) -> DataFrame:
    """``(table, pk, field_chain, original)``, line ends normalised, blanks left out."""
    found = _texts(dataset)
    return found.select("table", "pk", F.replace("field_chain", F.lit("."), F.lit("-")).alias("field_chain"),
                        normalise_newlines(trim_space("value")).alias("original")).where("original <> ''")


def extract_texts_by_id(dataset: Dataset, table: str, description: str | None = None,
                        translations: DataFrame | None = None, chains: Sequence[str] | None = None) -> DataFrame:
    """Wide sheet of one table: id, description, then per field chain the original and
    ``t(chain)``.

    Chains of nested lists depend on the data; name them in ``chains`` to save the pass
    that looks for them.  Column count follows the contract, not the rows.
    """
    one = Dataset({table: dataset.contracts[table]}, {table: dataset.frames[table]})
    rows = text_rows(one)
    contract, df = dataset.contracts[table], dataset.frames[table]
    if chains is None:
        flat = [f.name for f in contract.fields if f.type == "text"]
        nested = any(not isinstance(f.type, str) for f in contract.fields)
        chains = [r[0] for r in rows.select("field_chain").distinct().orderBy("field_chain").collect()] if nested else flat
    if translations is not None:
        done = translations.where(F.col("table") == table).select("pk", "field_chain", "translated")
        rows = rows.join(done, ["pk", "field_chain"], "left")
    else:
        rows = rows.withColumn("translated", F.lit(""))
    cols = []
    for c in chains:
        mine = F.col("field_chain") == c
        cols += [F.max(F.when(mine, F.col("original"))).alias(c),
                 F.max(F.when(mine, F.coalesce("translated", F.lit("")))).alias(f"t({c})")]
    sheet = rows.groupBy(F.col("pk").alias("id")).agg(*cols)
    if description:
        names = df.select(pack_id(df.schema, contract.key).alias("id"), F.col(description).cast("string").alias(description))
        sheet = sheet.join(names, "id", "left")
        return sheet.select("id", description, *[x for c in chains for x in (f"`{c}`", f"`t({c})`")])
    return sheet


def last_translations(entries: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One translation per key; of repeats the last by ``order`` (or by text) stays."""
    by = F.struct(F.col(order), F.col("translated")) if order else F.struct("translated")
    return entries.groupBy(*keys).agg(F.max_by("translated", by).alias("translated"))


def _replaced(c: Column, kind, path: Column, table: Column) -> Column:
    """The value with texts replaced by what ``table`` (field chain -> text) has for their place."""
    if isinstance(kind, str):
        return F.coalesce(table[path], c) if kind == "text" else c
    step = lambda name: F.concat(path, F.lit("."), name if isinstance(name, Column) else F.lit(name))
    if isinstance(kind, C.ListOf):
        return F.transform(c, lambda e, i: _replaced(e, kind.item, step(i.cast("string")), table))
    if isinstance(kind, C.MapOf):
        return F.transform(c, lambda e, i: F.struct(
            _replaced(e["key"], kind.key, step(F.concat(i.cast("string"), F.lit("k"))), table).alias("key"),
            _replaced(e["value"], kind.value, step(F.concat(i.cast("string"), F.lit("v"))), table).alias("value")))
    if isinstance(kind, C.Union):
        if kind.recursive:
            return c
        return F.when(c.isNotNull(), F.struct(c["type"].alias("type"), *[_replaced(c[i.name], i, path, table).alias(i.name) for i in kind.impls]))
    return F.when(c.isNotNull(), F.struct(*[_replaced(c[f.name], f.type, step(f.name), table).alias(f.name) for f in kind.fields]))


def _translate_inside(df: DataFrame, contract: TableContract, look_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replaces texts inside nested and recursive fields.

    ``look_up`` gets (_rid, _at, _pk, field_chain, value) of texts and gives (_rid, _at, new) of those that change.  A record's
    new texts come back as one map, as long as its own texts; recursive values are opened, and built again with them.
    """
    deep = [f for f in contract.fields if not isinstance(f.type, str) and _has_text_inside(f.type)]
    plain = [f for f in deep if not (isinstance(f.type, C.Union) and f.type.recursive)]
    out = df.withColumn("_pk", pack_id(df.schema, contract.key)) if deep else df
    if plain:
        rows = cut(out.withColumn("_rid", F.monotonically_increasing_id()), "rows")
        parts = F.concat(*[text_leaves(F.col(f.name), f) for f in plain])
        found = rows.select("_rid", "_pk", F.explode(parts).alias("l")).select("_rid", F.col("l.field_chain").alias("_at"), "_pk", "l.field_chain", "l.value")
        new = look_up(found).groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("_at", "new"))).alias("_new"))
        named = {f.name: f for f in plain}
        out = rows.join(new, "_rid", "left").select(*[
            F.when(F.col("_new").isNull(), F.col(c)).otherwise(_replaced(F.col(c), named[c].type, F.lit(c), F.col("_new"))).alias(c)
            if c in named else F.col(c) for c in out.columns])
    for f in deep:
        if f not in plain:
            out = rewritten(out, f.name, f.type, lambda leaves: look_up(leaves.where("type = 'text'")), ["_pk"])
    return out.drop("_pk")


def _sent(words: DataFrame) -> DataFrame:
    """Written ``words`` that are sent to every task if they are short, and else met by key.

    The texts they are joined with come from files of few repeated values, much smaller than what they hold: they are never sent.
    """
    words = cut(words, "words")
    size = words.agg(F.sum(F.length(F.to_json(F.struct(*words.columns))))).first()[0] or 0
    return words.hint("broadcast" if size <= SENT_WORDS else "merge")


def translate_by_value(df: DataFrame, contract: TableContract, dictionary: DataFrame,
                       order: str | None = None) -> DataFrame:
    """Replace text fields, at any depth, by their translation; ``<field>_original`` keeps the source of a record's own fields.

    The dictionary is keyed by table and original; an empty translation counts as none.
    It is small for most datasets and broadcast then; otherwise both sides are shuffled.
    """
    mine = dictionary.where(F.col("table") == contract.name).withColumn("_o", normalise_newlines("original"))
    best = last_translations(mine, ["_o"], order)
    words = best.select(F.col("_o").alias("_key"), F.nullif("translated", F.lit("")).alias("_t"))

    def look_up(texts: DataFrame) -> DataFrame:
        return (texts.join(_sent(words.where("_t is not null")), normalise_newlines("value") == F.col("_key"))
                .select("_rid", "_at", F.col("_t").alias("new")))

    out = _translate_inside(df, contract, look_up)
    for name in contract.texts():
        # The normalised text is a join expression, not one more column to move.
        out = out.join(words, normalise_newlines(name) == F.col("_key"), "left")
        out = out.withColumn(f"{name}_original", F.col(name)).withColumn(
            name, F.coalesce("_t", F.col(name))).drop("_key", "_t")
    return out


def translate_by_id(df: DataFrame, contract: TableContract, dictionary: DataFrame,
                    order: str | None = None) -> DataFrame:
    """Translation by (record, field chain), at any depth, used only while the stored original still matches."""
    mine = dictionary.where(F.col("table") == contract.name)
    by = F.struct(F.col(order), F.col("translated")) if order else F.struct("original", "translated")

    def look_up(texts: DataFrame) -> DataFrame:
        words = (mine.groupBy(F.col("pk").alias("_key"), F.col("field_chain").alias("_chain"))
                 .agg(F.max_by(F.struct("original", "translated"), by).alias("_w")))
        found = texts.join(_sent(words), (F.col("_pk") == F.col("_key")) & (F.replace("field_chain", F.lit("."), F.lit("-")) == F.col("_chain")))
        same = normalise_newlines("_w.original") == normalise_newlines("value")
        return found.where(same & (F.col("_w.translated") != "")).select("_rid", "_at", F.col("_w.translated").alias("new"))

    out = _translate_inside(df, contract, look_up)
    out = out.withColumn("_pk", pack_id(df.schema, contract.key))
    for name in contract.texts():
        words = (mine.where(F.col("field_chain") == name).groupBy(F.col("pk").alias("_key"))
                 .agg(F.max_by(F.struct("original", "translated"), by).alias("_w")))
        out = out.join(words, F.col("_pk") == F.col("_key"), "left")
        same = normalise_newlines("_w.original") == normalise_newlines(name)
        out = out.withColumn(f"{name}_original", F.col(name)).withColumn(
            name, F.coalesce(F.when(same, F.nullif(F.col("_w.translated"), F.lit(""))), F.col(name))).drop("_key", "_w")
    return out.drop("_pk")


def _said(text: str) -> Column:
    return F.unhex(F.sha2(normalise_newlines(text), 256))


def translations_matrix(dataset: Dataset, dictionaries: dict[str, DataFrame], order: str | None = None) -> DataFrame:
    """``(table, pk, field_chain, original, <lang>…)``; a missing translation shows the
    original, an empty original leaves all columns empty.

    All languages are folded into one wide dictionary first, so texts are joined once, by the
    SHA-256 of what they say: of an entry only its translation travels.  Of repeated entries the last by ``order`` wins, or the greatest text without it.
    """
    found = _texts(dataset).select("table", "pk", "field_chain", F.col("value").alias("original"))
    place = F.col(order) if order else F.lit(0)
    tagged = union_all(d.select("table", _said("original").alias("_o"), "translated", place.alias("_place"), F.lit(lang).alias("_lang"))
                       for lang, d in dictionaries.items())
    wide = tagged.groupBy("table", "_o").agg(*[
        F.max(F.when(F.col("_lang") == lang, F.struct("_place", "translated")))["translated"].alias(lang) for lang in dictionaries])
    wide = wide.withColumnRenamed("table", "_table")
    joined = found.join(wide, (F.col("table") == F.col("_table")) & (_said("original") == F.col("_o")), "left")
    return joined.select("table", "pk", "field_chain", "original", *[
        F.when(F.col("original") == "", "").otherwise(F.coalesce(F.nullif(lang, F.lit("")), F.col("original"))).alias(lang)
        for lang in dictionaries])


# Lengths of the text windows that terms are looked up by, longest first.
WINDOWS = (32, 16, 8, 4, 2, 1)

# Up to this many characters of terms are shipped to every task.
TERMS_LIMIT = 8_000_000


def find_terms(texts: DataFrame, terms: DataFrame, limit: int = TERMS_LIMIT) -> DataFrame:
    """Pairs ``(text_id, term)`` where the text contains the term, without a cross join.

    The distinct terms are written and measured.  A list within ``limit`` characters goes
    to every task and each text is scanned once; a longer one is joined by windows.
    """
    words = cut(terms.where(F.length("term") > 0).select("term").distinct(), "terms")
    size = words.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if ahocorasick is not None and size <= limit:
        return _scan_terms(texts, [r[0] for r in words.collect()])
    return _join_terms(texts, words)


def _scan_terms(texts: DataFrame, words: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for word in shared.value:
            machine.add_word(word, word)
        machine.make_automaton()
        for batch in batches:
            yield batch.map(lambda t: list({w for _, w in machine.iter(t)}) if t and len(machine) else [])

    return texts.select("text_id", F.explode(found("text")).alias("term"))


def _join_terms(texts: DataFrame, words: DataFrame, salt: int = 16) -> DataFrame:
    """Each term is filed under its leading window of 32, 16, 8, 4, 2 or 1 characters, the
    longest it fills.  Texts give their distinct windows, an equi-join brings them to the
    terms that start so, and `contains` settles it.  Windows are salted and the terms
    repeated per salt, so a window that many texts share is spread.
    """
    size = F.lit(WINDOWS[-1])
    for w in reversed(WINDOWS):
        size = F.when(F.length("term") >= w, w).otherwise(size)
    keyed = words.withColumn("_w", size).withColumn("_gram", F.expr("substring(term, 1, _w)"))
    # At most one row per window length.
    lengths = sorted(r[0] for r in keyed.select("_w").distinct().collect())
    if not lengths:
        return texts.select("text_id", F.lit("").alias("term")).where(F.lit(False))
    spread = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    out = []
    for w in lengths:
        # The lookahead gives every overlapping window in one pass over the text.
        grams = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{w}}}))"), F.lit(1)))
        have = texts.select("text_id", F.explode(grams).alias("_gram")).withColumn(
            "_salt", F.pmod(F.xxhash64("text_id"), F.lit(salt)).cast("int"))
        mine = spread.where(F.col("_w") == w).select("term", "_gram", "_salt")
        # The join carries ids only; texts come back once for the few candidates.
        out.append(have.join(mine, ["_gram", "_salt"]).select("text_id", "term"))
    pairs = cut(union_all(out).distinct(), "candidates")
    return texts.join(pairs, "text_id").where(F.contains("text", F.col("term"))).select("text_id", "term")


def check_terms(texts: DataFrame, terms: DataFrame, mode: str = "all") -> DataFrame:
    """Texts whose original contains a glossary term but whose translation lacks the
    term's own translation.

    ``texts(table, pk, field_chain, original, translated)``, ``terms(term, translated)``.
    Mode ``pending`` looks at untranslated texts only: they show which terms to mind.
    """
    rows = texts.where(F.coalesce("translated", F.lit("")) == "") if mode == "pending" else texts
    keys = ["table", "pk", "field_chain"]
    named = rows.withColumn("text_id", F.concat_ws("\u0001", *keys))
    pairs = find_terms(named.select("text_id", F.col("original").alias("text")), terms)
    words = last_translations(terms, ["term"]).withColumnRenamed("translated", "term_translated")
    out = named.join(pairs, "text_id").join(words, "term")
    missing = ~F.contains(F.coalesce("translated", F.lit("")), F.col("term_translated"))
    return out.where((F.col("term_translated") != "") & missing).select(*keys, "term", "term_translated")


def split_todo(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(untranslated rows, translated rows for reference)."""
    empty = F.coalesce("translated", F.lit("")) == ""
    return rows.where(empty), rows.where(~empty)


def merge_todo(dictionary: DataFrame, todo: DataFrame, order: str | None = None) -> DataFrame:
    """Take over non-empty translations whose target exists with the same original.

    Of repeated rows the last by ``order`` wins, or the greatest text without it.
    """
    keys = ["table", "pk", "field_chain"]
    answered = todo.where(F.coalesce("translated", F.lit("")) != "")
    new = last_translations(answered, [*keys, "original"], order).withColumnRenamed("translated", "_new")
    return dictionary.join(new, [*keys, "original"], "left").select(
        *keys, "original", F.coalesce("_new", "translated").alias("translated"))


def reuse_translations(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Fill pending rows from a finished row with the identical original; of several the
    smallest (table, pk, field_chain) is taken."""
    order = F.struct("table", "pk", "field_chain")
    pick = (done.where(F.coalesce("translated", F.lit("")) != "")
            .groupBy("original").agg(F.min_by("translated", order).alias("_t")))
    out = todo.join(pick, "original", "left")
    filled = F.when(F.coalesce("translated", F.lit("")) == "", F.coalesce("_t", F.lit(""))).otherwise(F.col("translated"))
    return out.select("table", "pk", "field_chain", "original", filled.alias("translated"))


def translation_coverage(rows: DataFrame) -> DataFrame:
    """Texts and untranslated texts per table."""
    return rows.groupBy("table").agg(F.count("*").alias("texts"),
                                     F.count_if(F.coalesce("translated", F.lit("")) == "").alias("untranslated"))
