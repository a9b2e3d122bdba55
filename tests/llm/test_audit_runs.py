"""Filter audit and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import filter_audit, periodic_runs, queries
from tests.llm.brute import words
from tests.llm.test_documents import ODD, frame


def plain_fails(docs):
    """{row: failed letters} of [(doc_id, text, source)]."""
    out = []
    for d, text, _ in docs:
        text, found = text or "", words(text)
        fails = set()
        if len(found) < 50:
            fails.add("A")
        if 100 * len(set(found)) < 65 * len(found):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        key = float("inf") if d is None else d
        if any((float("inf") if e is None else e) < key and (other or "") == text for e, other, _ in docs):
            fails.add("E")
        out.append(fails)
    return out


def plain_audit(docs, labels):
    fails = plain_fails(docs)
    good, toxic = ({d for d, *said in labels if said[i] == 1 and d is not None} for i in (0, 1))
    rows = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(d, f) for (d, _, s), f in zip(docs, fails) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                before = set(order[:k])
                removed = [d for d, f in mine if letter in f and not f & before]
                total[letter] += len(removed)
                rows[part, order, k + 1] = [
                    sum(not f & (before | {letter}) for _, f in mine), len(removed), sum(letter in f and bool(f & before) for _, f in mine),
                    sum(f == {letter} for _, f in mine), sum(d in good for d in removed), sum(d in toxic for d in removed)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(total[order[step - 1]])
    return rows


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit._FIGURES] for r in df.collect()}


def test_audit_odd_rows(spark):
    rng = random.Random(3)
    docs = [(d, t, "a" if d % 2 else None) for d, t in ODD] + [(None, "x", "a"), (None, "x", ""), (4, ODD[3][1], "b")]
    docs += [(20 + i, " ".join(rng.choice(["Alpha", "beta", "c#", "d", "e%s" % i]) for _ in range(rng.randrange(120))), "b") for i in range(30)]
    docs += [(70 + i, docs[20 + i][1], "c") for i in range(12)]
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d in (1, 2, 3, 4, 4, 21, 22, 23, 75, 76, 9999)] + [(None, 1, 1), (8, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("part", "first", "good", "word")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert audited(filter_audit.audit(df, marks)) == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert {tuple(v[:4]) for v in audited(filter_audit.audit(df, marks.limit(0))).values()} == {
        tuple(v[:4]) for v in plain_audit(docs, []).values()}


def test_positional_popcount():
    rng = np.random.default_rng(1)
    counter, every = filter_audit.Counter(), []
    for size in (0, 1, 2, 3, 1000, 77, 4096):
        block = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        counter.add(block)
        every.append(block)
    bits = (np.concatenate(every)[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    assert counter.counts().tolist() == bits.sum(axis=0).tolist()
    assert all(len(level) <= 2 for level in counter.levels)


def plain_lyndon(s):
    out = []
    for i in range(len(s)):
        j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        out.append(j - i)
    return out


def plain_runs(s):
    n, out = len(s), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and all(any(s[k] != s[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    """Letters with runs inside runs."""
    s = [rng.randrange(rng.choice((1, 2, 3, 8))) for _ in range(rng.randrange(12))]
    for _ in range(rng.randrange(4)):
        s = s * rng.randrange(1, 6) + [rng.randrange(3) for _ in range(rng.randrange(4))]
        s = s[:160]
    return s


def test_lyndon_arrays_and_runs():
    rng = random.Random(11)
    for _ in range(1500):
        s = periodic(rng)
        if s:
            dense = np.unique(s, return_inverse=True)[1].tolist()
            assert periodic_runs.lyndon_array(dense, max(dense) + 1) == plain_lyndon(dense)
            assert periodic_runs.runs_of(np.array(s)) == plain_runs(s), s


def test_runs_of_batches():
    rng = random.Random(12)
    texts = [[b"%d" % x for x in periodic(rng)] + [b"w%d" % rng.randrange(50) for _ in range(rng.randrange(60))] for _ in range(400)]
    assert periodic_runs.find_runs(texts) == [plain_runs(t) for t in texts]
    assert periodic_runs.find_runs([]) == [] and periodic_runs.find_runs([[], [b"a"] * 6]) == [[], [(0, 6, 1)]]


def plain_row(doc_id, text):
    found = words(text)
    n, h = len(found), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(found)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(found) if i not in drop)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_query(spark, sf):
    short = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic_runs.run_digests(
        periodic_runs.periodic_runs(short, edit=queries.planted_period)).collect()}
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    assert len(texts) > 100 and got == {d: plain_row(d, t) for d, t in texts.items()}
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_periodic_runs_odd_rows(spark):
    odd = ODD + [(None, "a a a a a a b"), (50, "a " * 3000), (50, "a " * 3000), (51, "x y " * 40 + "z " + "x y " * 9), (52, "    " * 8)]
    got = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in periodic_runs.run_digests(
        periodic_runs.periodic_runs(frame(spark, odd), edit=queries.planted_period)).collect())
    assert got == sorted((str(d), *plain_row(d, t)) for d, t in odd)
    assert periodic_runs.periodic_runs(frame(spark, odd).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", None])
def test_no_words(spark, text):
    row = periodic_runs.periodic_runs(frame(spark, [(1, text)])).first()
    assert (row["n_words"], row["runs"], row["collapsed"]) == (0, [], "")
