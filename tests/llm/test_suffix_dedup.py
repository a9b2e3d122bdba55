"""Repeated byte strings against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from tablewright.llm import queries, suffix_dedup
from tests.llm.test_documents import ODD, frame


def plain(docs, length=50):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] of [(doc_id, text)]; null ids last."""
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            first[s] = min(first.get(s, float("inf")), key(d))
    out = []
    for d, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < key(d):
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((str(d), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df, **how):
    out = []
    for r in suffix_dedup.drop_repeats(df, **how).collect():
        gone = sum(s["end"] - s["start"] for s in r["spans"])
        assert len(r["kept"]) == r["n_bytes"] - gone
        out.append((str(r["doc_id"]), r["n_bytes"], gone, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
    return sorted(out)


def invented(rng, n):
    """Texts with passages in common, cut and joined anywhere; copies and periodic stretches included."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(8)] + ["ab" * 150, "\x00" * 90]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(p[a:a + rng.randrange(20, 400)] if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(30))))
        out.append(rng.choice(("", " ", "\n")).join(parts))
    return out + out[:5]


@pytest.mark.parametrize("length, letter, batch", [(50, 8, 10000), (50, 8, 64), (20, 5, 100)])
def test_invented_texts(spark, length, letter, batch):
    rng = random.Random(length + batch)
    texts = invented(rng, 60)
    docs = [(rng.randrange(10**6) if rng.random() < 0.95 else rng.choice((3, None)), t) for t in texts]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found(frame(spark, docs).repartition(3), length=length, letter=letter) == plain(docs, length)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_small_letters_recurse(spark):
    """Letters of two bytes: names cover 6, 18 and 54 bytes."""
    docs = list(enumerate(invented(random.Random(9), 40)))
    spans = {r["doc"]: (r["starts"], r["ends"]) for r in suffix_dedup.removed_spans(frame(spark, docs), letter=2).collect()}
    for d, size, gone, n, _ in plain(docs):
        a, b = (np.array(x, np.int64) for x in spans.get(int(d), ((), ())))
        a, b = suffix_dedup.merged(a, b)
        assert (int((b - a).sum()), len(a)) == (gone, n)


def test_odd_rows(spark):
    passage = "a passage that is somewhat longer than fifty bytes, so that it counts"
    odd = ODD + [(None, passage), (None, "x" + passage), (20, passage + "!"), (20, "?" + passage), (21, passage[:49]), (21, passage[:49]),
                 (22, "x" * 60), (23, "é" * 40), (24, "e" + "é" * 40), (25, "ё" * 30 + "é" * 40)]
    assert found(frame(spark, odd)) == plain(odd)
    assert found(frame(spark, odd).limit(0)) == []
    with pytest.raises(ValueError):
        suffix_dedup.removed_spans(frame(spark, odd), length=20)


def test_query(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                 for r in queries.op13_suffix_dedup(spark, sf).collect())
    assert got == plain(texts)


def test_anchors_of_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(4000))) for _ in range(5)] + [b"", b"x" * 49, b"y" * 300]
    whole = sorted(zip(*(x.tolist() for x in suffix_dedup.anchors(texts, 50, 26))))
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    assert sorted(zip(*(x.tolist() for x in suffix_dedup.anchors(texts, 50, 26)))) == whole
    # Every string has an anchor in it.
    for k, text in enumerate(texts):
        at = np.array([p for t, p, _ in whole if t == k])
        assert all(((at >= i) & (at + 26 <= i + 50)).any() for i in range(len(text) - 49))
