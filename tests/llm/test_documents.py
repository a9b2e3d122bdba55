"""Operators on documents against plain versions, and the odd cases of their input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import line_dedup, quality_classifier, quality_rules, simhash
from tests.llm import brute

ODD = [(1, None), (2, ""), (3, " \t\n\n "), (4, "One two three four five six seven eight nine ten eleven."), (5, "x" * 300_000),
       (6, "\n".join(["a b c d e f g"] * 20)), (7, "A common line of text.\nown seven"), (8, "  a COMMON line of text. \nown eight\n"),
       (9, "a common line of text.\na common line of text.\n\x0bfoo"), (10, "É é nbsp word\r\nEnd!"), (11, "a common line of text.")]


def frame(spark, rows, types="doc_id long, text string"):
    """Clashing extra columns included."""
    return spark.createDataFrame(rows, types).withColumns(
        {c: F.lit("other") for c in ("fp", "sum", "kept", "_keep_id", "_line_id", "position", "label", "a b")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_fingerprints(docs, texts):
    for r in simhash.fingerprints(docs).collect():
        assert r["fp"] % (1 << 64) == brute.simhash(texts[r["doc_id"]])


def test_near_duplicates(docs, texts):
    wanted = brute.component_ids({d: brute.simhash(t) for d, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == wanted


def test_near_links_connect_like_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains and dense groups of near fingerprints
        prints.append(rng.choice(prints) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(64)))
    core = rng.getrandbits(64)
    prints += [core ^ (1 << i) for i in range(64)]
    prints = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    signed = {p - (1 << 64) if p >> 63 else p: i for i, p in prints.items()}
    wanted = brute.component_ids(prints)
    for cell in (2, simhash.CELL, 1000):
        monkeypatch.setattr(simhash, "CELL", cell)
        fps = spark.createDataFrame([(p,) for p in signed], "fp long")
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(fps)).collect()}
        groups = {}
        for p, i in signed.items():
            groups.setdefault(roots.get(p, p), set()).add(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == wanted


def test_keep_one(spark):
    rows = ODD + [(12, ODD[3][1]), (12, ODD[3][1]), (12, "quite another text with some words"), (None, ODD[3][1]), (None, "lonely text here"),
                  (None, "lonely text here")]
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns[:2] == ["doc_id", "text"] and "a b" in kept.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda x: (x[0] is None, x))
    ids = [d for d, _ in got]
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 11, None] and got[-1][1] == "lonely text here"


def family(rng, first_id, size, changes, length=120):
    """A text and its near copies."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    rows = [(first_id, " ".join(base))]
    for i in range(1, size):
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(length)] = f"v{rng.randrange(5000)}"
        rows.append((first_id + i, " \n".join(copy)))
    return rows


@pytest.mark.parametrize("cell", [2, 32])
def test_keep_one_of_similar_texts(spark, monkeypatch, cell):
    rng = random.Random(5)
    rows = sum((family(rng, 100 * i, 8, c) for i, c in enumerate([1, 2, 3, 4, 8])), [])
    rows += [(1000, "a b c d"), (1001, "A  b c d"), (1002, "a b c e"), (1003, "a b c"), (1004, None), (1005, "")]
    rows += [(None, rows[0][1] + " more"), (None, "alone " + rows[8][1])]
    monkeypatch.setattr(simhash, "CELL", cell)
    wanted = brute.kept_ids([r for r in rows if r[0] is not None])
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == wanted


def test_keep_one_of_nothing(spark):
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_lines(spark, docs, texts):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_report(docs).collect()}
    assert got == brute.line_report(list(texts.items()))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_report(frame(spark, ODD)).collect()}
    assert got == brute.line_report(ODD)


def test_lines_over_many_tasks(spark):
    """A run that fills several tasks is resolved by the rows at the tasks' edges."""
    rows = [(i, f"the very common line\nown line number {i}\nanother common line" + "\nthe very common line" * (i % 3)) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"])
               for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute.line_report(rows)


def test_lines_with_shared_and_missing_ids(spark):
    rows = [(3, "a line for everyone"), (3, "A line for everyone \nx"), (3, "a line for everyone"), (None, "a line for everyone\nmine"), (9, None)]
    got = line_dedup.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [
        ("3", "A line for everyone \nx"), ("3", "a line for everyone"), ("3", "a line for everyone"), ("9", "None"), ("None", "mine")]
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


def test_base_metrics(spark, docs, texts):
    for source, known in ((docs, texts), (frame(spark, ODD), dict(ODD))):
        for r in quality_rules.judge(source).collect():
            got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
            assert got == brute.base_metrics(known[r["doc_id"]]), r["doc_id"]
            assert not (r["base_failed"] and r["kept"])


def test_repeated_words_of_many_kinds():
    rng = random.Random(3)
    for size in (5, 6, 40, 3000):
        words = [str(rng.randrange(3 if size < 50 else 5000)).encode() for _ in range(size)]
        words += words[:7]
        assert quality_rules.repeated_words(words) == brute.base_metrics(b" ".join(words).decode())[4]


@pytest.mark.parametrize("line, rule", [
    ("Home | About | Contact | Imprint", "navigation"), ("word *** word ### word $$$", "punctuation"),
    ("BUY!! NOW!! TODAY!! ONLY!!", "punctuation"), ("Copyright 2020 Some Firm. All rights reserved.", "boilerplate"),
    ("la la la la la la la la la la la", "repetition"), ("Some menu entry", "punctuation"),
    ("A plain sentence, as people write them, ends with a full stop.", None)])
def test_line_rules(line, rule):
    assert quality_rules.line_fails(line.encode(), quality_rules.Rules()) == rule


def test_clean(spark):
    text = "A plain sentence of a clean document ends with a full stop.\nHome | About | Contact\nAnother plain sentence follows it here."
    rows = [(1, text, 5), (2, "BUY!! NOW!!", 5), (3, None, 5)]
    got = quality_rules.clean(frame(spark, rows, "doc_id long, text string, n_chars int")).collect()
    want = "\n".join(text.split("\n")[::2])
    assert [(r["doc_id"], r["text"], r["n_chars"], r["a b"]) for r in got] == [(1, want, len(want), "other")]


def test_classifier(spark, sf):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[r["doc_id"]]["score"], got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, _, q in held if q == 1], [s for s, _, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([p == q for _, p, q in held]) > 0.93


def test_classifier_never_sees_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    turned = labels.withColumn("quality", F.when(remainder == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    params = quality_classifier.Params(features=32)
    score = lambda known: {r["doc_id"]: round(r["score"], 6) for r in quality_classifier.classify(docs, known, params).collect()}
    assert score(labels) == score(turned)


def test_classifier_odd_cases(spark):
    params = quality_classifier.Params(features=8)
    docs = frame(spark, ODD + [(None, "no id"), (4, "again")])
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (4, 1)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.classify(docs, none, params).collect()} == {0.5}
    assert all(r["score"] > 0.99 for r in quality_classifier.classify(docs, labels, params).collect())
    assert quality_classifier.classify(frame(spark, []), none, params).count() == 0


def test_isotonic_rises():
    x = np.arange(6.0)
    knots, values = quality_classifier.isotonic(x, np.array([0, 2, 1, 3, 2, 4.0]), np.full(6, 4.0))
    assert list(values) == sorted(values) and len(knots) == len(values) == 4


def test_every_word_of_a_line_counts():
    """One word eight times in thirteen, wherever it stands."""
    rng = random.Random(2)
    for _ in range(50):
        words = ["same"] * 8 + ["one", "two", "three", "four", "five"]
        rng.shuffle(words)
        assert quality_rules.line_fails(" ".join(words).encode() + b".", quality_rules.Rules()) == "repetition"
    fine = ["same"] * 6 + [f"w{i}" for i in range(7)]
    assert quality_rules.line_fails(" ".join(fine).encode() + b".", quality_rules.Rules()) is None


def test_long_words_are_not_remembered():
    from tablewright.llm.base import Remembered
    held = Remembered(len, 1000)
    words = [("%06d" % i) * 34 for i in range(20_000)] + ["%d" % i for i in range(5_000)]
    assert [held[w] for w in words] == list(map(len, words))
    assert len(held) + len(held.old) <= 2000 and all(len(w) <= 64 for w in (*held, *held.old))
