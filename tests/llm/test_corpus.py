"""Packing, decontamination, repeated passages and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import decontaminate, packing, substring_dedup
from tablewright.llm.queries import TOKENIZER
from tests.llm.test_documents import ODD, frame


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def packed_right(rows, texts, capacity=4096):
    """Pieces cover every document's ids once, in place, and fill sequences without gaps."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    of_doc, of_sequence = {}, {}
    for r in rows:
        of_doc.setdefault(r["doc_id"], []).append(r)
        of_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(of_doc) == set(texts)
    for d, pieces in of_doc.items():
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in of_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(of_sequence)


def test_packing(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs, TOKENIZER).collect()
    n = packed_right(rows, texts)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // 4096) + 2


def test_packing_odd_cases(spark):
    odd = [(100, "<|endoftext|> x<|startoftext|>y"), (101, "a\u00a0b\u2003c\x0bd\x1ce\rf"), (102, "e\u0301 \u0301x ﬁ ΑΣ ΑΣ. İ"), (103, "it's we'll 12345")]
    rows = packing.pack(frame(spark, ODD + odd), TOKENIZER, group=5).collect()
    packed_right(rows, dict(ODD + odd))
    twice = packing.pack(frame(spark, [(1, "two words"), (1, "two words"), (None, None)]), TOKENIZER).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in twice) == [("1", 3), ("1", 3), ("None", 1)]
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 2000)
    for k in (1, 2, 7, 250, 3000):
        parts = packing.differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(2000)) and len(parts) <= k
        sums = [int(sizes[p].sum()) for p in parts]
        if k <= 250:
            assert max(sums) - min(sums) < 40
    window, offset = packing.windows_of(sizes, 4096)
    assert np.bincount(window, sizes).max() <= 4096 and len(set(window)) <= -(-int(sizes.sum()) // 4096) + 1
    assert set(packing.windows_of(np.array([3000, 3000, 3000]), 4096)[0]) == {0, 1, 2}


QUESTION = "John has 12 apples and gives 5 apples to Mary before noon. How many apples does John have after 3 days?"


def test_templates_catch_other_numbers_and_names(spark):
    bench = [(1, QUESTION), (2, None), (3, ""), (4, "too short"), (5, "one two three four five six seven"), (6, QUESTION)]
    docs = [(1, "Before it. " + QUESTION + " After it."), (2, "so Bill has 70 apples and gives 9 apples to Ann before noon. how many apples does Bill have after 8 days?"),
            (3, QUESTION.upper()), (4, "He has 12 ideas and gives talks."), (5, None), (6, ""), (7, "then One, two; three four five six SEVEN came"),
            (8, "<> 12 13 14 15 16 17 18 19 20 21 22"), (None, QUESTION), (9, QUESTION.replace("12 apples", "pears"))]
    benchmark = spark.createDataFrame(bench, "item_id long, text string").withColumn("owner", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, docs), benchmark).collect()}
    assert {(1, 1), (3, 1), (7, 5), (decontaminate_null(), 1)} <= got
    assert (2, 1) in got
    assert not {d for d, _ in got} & {4, 5, 6, 8}
    left = decontaminate.without_leaks(frame(spark, docs), benchmark)
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted({4, 5, 6, 8, 9} - {d for d, _ in got})
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, docs), nothing).count() == 0 and decontaminate.leaks(frame(spark, []), benchmark).count() == 0


def decontaminate_null():
    return (1 << 63) - 1


def test_items_without_templates_match_literally(spark):
    """Numbers and units only, few words, or no spaces: a verbatim copy is found, other numbers or words are not."""
    items = {1: "Calculate 12 + 7 * 3 - 5 / 2", 2: "add 3 kg 5 g to 7 kg 9 g and 2 kg", 3: "Name two rivers", 4: "今天的天气怎么样？明天会下雨吗？",
             5: "+ - * /", 6: "พรุ่งนี้ฝนจะตกไหม", 7: "x=(a+b)", 8: "Explain 为什么 the sky over 北京 is often blue in autumn, please", 9: " "}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    around = {i: f"Before this. {t} ! After it." for i, t in items.items() if i not in (4, 6)}
    docs = [*around.items(), (4, f"他问{items[4]}然后走了。"), (6, f"เขาถามว่า{items[6]}แล้วไป"), (11, "Calculate 99 + 8 * 4 - 6 / 1"), (12, "add 4 kg 6 g to 8 kg 1 g and 3 kg"),
            (13, "Name two of the rivers"), (14, "今天的天气很好"), (15, "Calculate 12\n+ 7 * 3 -\n5 / 2"), (16, None), (17, "")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, docs), benchmark).collect()}
    assert got == {(i, i) for i in items if i not in (5, 9)} | {(5, 5), (15, 1)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(frame(spark, docs), benchmark).collect()} == {9, 11, 12, 13, 14, 16, 17}


def test_every_item_of_a_class_is_reported(spark):
    """Documents are linked to all items of one template, also where two texts or two readings make the links."""
    family = [(i, QUESTION.replace("12", str(10 + i)).replace("3 days", f"{i} days")) for i in (5, 7, 9)] + [(20, QUESTION.replace("Mary", "Ann")), (21, "so it is"), (22, "So, it is!")]
    benchmark = spark.createDataFrame(family, "item_id long, text string")
    docs = frame(spark, [(1, "Before it. " + family[2][1]), (2, "I say so it is now."), (3, "nothing here")])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect())
    assert got == [(1, 5), (1, 7), (1, 9), (1, 20), (2, 21), (2, 22)]
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()] == [3]


def test_slots_have_to_agree(spark):
    benchmark = spark.createDataFrame([(1, "take 5 steps left then take 5 steps right again")], "item_id long, text string")
    docs = frame(spark, [(1, "take 9 steps left then take 9 steps right again"), (2, "take 9 steps left then take 8 steps right again")])
    assert [r["doc_id"] for r in decontaminate.leaks(docs, benchmark, enough=99, share=0.9).collect()] == [1]


def test_leaks_like_plain_windows(spark, sf, docs):
    """Every document that holds an item word by word is found, and no other."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    squeeze = lambda t: " ".join((t or "").split())
    items = {r["item_id"]: squeeze(r["text"]) for r in bench.collect()}
    wanted = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in squeeze(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == wanted and wanted


PASSAGE = " ".join(f"Word{i} stands in a sentence." for i in range(12))


def test_repeated_passages(spark):
    docs = [(1, "Own start of one.\n" + PASSAGE + "\nOwn end."), (2, "Other things first. " + PASSAGE + " Other things last."), (3, "A clean text. With its own sentences."),
            (4, None), (5, ""), (6, "A clean text. Something else."), (7, "x " * 100_000), (8, PASSAGE.upper().replace(" ", "  ")), (8, PASSAGE), (None, PASSAGE), (None, PASSAGE)]
    texts = {d: t for d, t in docs}
    got = substring_dedup.repeated_spans(frame(spark, docs)).collect()
    assert sorted({r["doc_id"] for r in got}) == [2, 8, decontaminate_null()] and {tuple(r["first_docs"]) for r in got} == {(1,)}
    span = next(r for r in got if r["doc_id"] == 2)
    assert texts[2][span["start"]:span["end"]].strip() == PASSAGE and span["n_words"] == 60
    cleaned = {r["doc_id"]: r["kept_text"] for r in substring_dedup.drop_passages(frame(spark, docs)).where("doc_id < 8").collect()}
    assert cleaned[1] == texts[1] and cleaned[3] == texts[3] and cleaned[4] is None and PASSAGE[:40] not in cleaned[2]
    assert substring_dedup.repeated_spans(frame(spark, [])).count() == 0


def plain_spans(docs, min_words=25):
    holders = {}
    units = {d: list(substring_dedup.units_of(t or "", "sentence")) for d, t in docs}
    for d, found in units.items():
        for _, _, clean in found:
            holders.setdefault(clean, set()).add(d)
    out = set()
    for d, found in units.items():
        run = []
        for a, b, clean in found + [(0, 0, None)]:
            if clean is not None and min(holders[clean]) < d:
                run.append((a, b, len(clean.split())))
                continue
            if sum(w for *_, w in run) >= min_words:
                out.add((d, run[0][0], run[-1][1]))
            run = []
    return out


def test_repeated_passages_like_plain(docs):
    wanted = plain_spans([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {(r["doc_id"], r["start"], r["end"]) for r in substring_dedup.repeated_spans(docs).collect()} == wanted and wanted


def windows(text, width=50):
    words = text.lower().split()
    return [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]


def test_only_the_first_occurrence_stays(spark):
    """Also inside one document, and short units beside others."""
    page = " ".join(f"Word{i} stands in a sentence." for i in range(20))
    docs = [(3, page + " Own words. " + page), (5, "Yes indeed. Own start. " + page + " Rest"), (7, "Begin here. Yes indeed. Word3 stands in a sentence."),
            (7, "Yes indeed. Other text."), (9, "\n".join([page.upper()] * 300)), (None, "Last one. Last one.")]
    kept = substring_dedup.drop_passages(frame(spark, docs)).collect()
    texts = [r["kept_text"] for r in sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))]
    assert texts[0] == page + " Own words." and " ".join(texts[1].split()) == "Yes indeed. Own start. Rest"
    assert sorted(t.strip() for t in texts[2:4]) == ["Begin here.", "Other text."]
    assert texts[4].strip() == "" and texts[5].strip() == "Last one."
    seen = [w for t in texts for w in windows(t)]
    assert len(seen) == len(set(seen))


def test_no_long_window_stays_twice(docs):
    """Windows of 50 words, whatever the units: what is left twice is a word or two, over and over inside one unit."""
    kept = substring_dedup.drop_passages(docs).collect()
    left = Counter(w for r in kept for w in windows(r["kept_text"] or ""))
    before = Counter(w for r in docs.collect() for w in windows(r["text"] or ""))
    long = lambda counts: sum(n > 1 and len(set(w.split())) > 2 for w, n in counts.items())
    assert long(before) > 1000 and long(left) == 0


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_other_units(spark, unit):
    docs = frame(spark, [(1, f"{PASSAGE}\nend\n\nmore"), (2, f"{PASSAGE}\nend\n\nother")])
    got = substring_dedup.repeated_spans(docs, unit).collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(2, 0)]


def test_pipeline(spark, sf, docs):
    """Stages keep the columns; what each drops is what its operator says."""
    d, before = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == before, name
        out = spark.createDataFrame(out.collect(), out.schema)
        assert 0.6 * d.count() < out.count() <= d.count(), name
        assert out.where(F.length("text") != F.col("n_chars")).isEmpty(), name
        d = out
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    packed_right(corpus_pipeline.STAGES[-1][1](spark, d, sf).collect(), texts)


def test_pipeline_of_odd_documents(spark, sf):
    d = frame(spark, ODD * 2 + [(None, "No id here. But a text of more than ten words, which is clean and stays.")])
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf)
        d = spark.createDataFrame(d.collect(), d.schema)
    assert {r["doc_id"] for r in d.collect()} >= {4, None}


LONG_ITEM = ("we heard that Anna went to Paris and later Anna met Bob near the old bridge where they had to wait for the long train "
             "from there and wait for Carl and Anna to come back again with Bob to the town")


def test_slots_agree_over_a_passage(spark):
    """A name of the item stands for one name of the document, also where no window holds both places."""
    rename = lambda text, **names: " ".join(names.get(w, w) for w in text.split())
    other = LONG_ITEM.replace("and Anna to come", "and Dora to come")
    benchmark = spark.createDataFrame([(1, LONG_ITEM), (2, other)], "item_id long, text string")
    mixed = rename(LONG_ITEM, Anna="Mary", Bob="Tom", Carl="Ed").replace("Ed and Mary", "Ed and Zoe").replace("with Tom", "with Max")
    cut_up = " ".join(LONG_ITEM.split()[:20]) + " something else entirely " + " ".join(rename(LONG_ITEM, Anna="Zoe", Bob="Max", Carl="Ed").split()[20:])
    docs = [(1, LONG_ITEM), (2, "so " + rename(LONG_ITEM, Anna="Mary", Bob="Tom", Carl="Ed", Paris="Rome") + " so"), (3, mixed), (4, other), (5, cut_up)]
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.leaks(frame(spark, docs), benchmark, share=0.5).collect()}
    assert {(1, 1), (2, 1), (4, 2)} <= set(got) and got[1, 1] == got[2, 1] == got[4, 2] == 1
    assert (3, 1) not in got


def test_bit_table_grows_with_the_benchmark(spark):
    few, many = (spark.range(n).select(F.xxhash64("id").alias("hash")) for n in (10, 40_000))
    assert len(decontaminate.bit_table(few)) * 8 == 1 << decontaminate.LEAST_LOG
    table = np.frombuffer(decontaminate.bit_table(many), np.uint8)
    assert len(table) * 8 >= 40_000 * decontaminate.BITS_PER_WINDOW
    hashes = np.array([r["hash"] for r in many.collect()], np.int64).view(np.uint64)
    assert decontaminate.marked(table, hashes).all()
