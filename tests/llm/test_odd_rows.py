"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns in operators and stages; the pipeline."""

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamgraph.llm import chat, common, decontaminate, html, jaccard, mixing, quality, sharding, spans, toxicity, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "row key part whole copies size k d _d shard virtual_slot spread text_hash _row _nth n cls copies_ salt found span pattern quality_ kept _u".split()


def long_text(n):
    rng = np.random.default_rng(9)
    return " ".join(f"w{k}" for k in rng.integers(0, 10**6, n)) + "."


def odd_docs(spark):
    long = long_text(120_000)  # about 900 KB
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (2, " \n ", None), (3, "one two three", "a"), (3, "one two three", "a"), (3, "other words here", "b"), (4, long, "b"), (None, long, "b"), (5, long + " end", None), (6, "x" * 300_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), *(F.lit(7).alias(c) for c in CLASHING))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns(spark, name, stage):
    docs = odd_docs(spark)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    left = got.collect()
    assert all(r[c] == 7 for r in left for c in CLASHING)
    assert stage(spark, docs.limit(0), SF).count() == 0
    texts = Counter(len(r.text or "") for r in left)
    if name == "n-gram Jaccard join":
        assert len(left) == 8 and texts[len(long_text(120_000))] == 1  # the wordless four, two short texts, one long, one word
    if name == "benchmark decontamination":
        assert len(left) == docs.count()


def test_last_stage(spark):
    docs = odd_docs(spark)
    got = sharding.stage(spark, docs, SF)
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == docs.count()
    assert got.select("shard").distinct().count() > 1 and sharding.stage(spark, docs.limit(0), SF).count() == 0
    assert got.where("text = 'one two three'").select("shard").distinct().count() == 1


def test_operators_on_long_texts(spark):
    docs = odd_docs(spark)
    n = docs.count()
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(docs).collect()}
    assert got[5, 119_998] == got[4, 119_997] == got[None, 119_997] == 4
    cut = spans.dedup(docs).collect()
    assert len(cut) == n and sum(len(r.text or "") > 500_000 for r in cut) == 1
    model = toxicity.fit(pa.array(["a bad idiot", "good day"] * 9), np.array([1, 0] * 9))
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == n
    measured = {r.doc_id: r for r in quality.judge(docs).collect() if r.doc_id}
    assert measured[4].n_words == 120_000 and measured[6].word_chars == 300_000 and not measured[1].kept
    items = spark.createDataFrame([("i", " ".join(long_text(120_000).split()[60_000:60_030]))], "item_id string, text string")
    assert sorted((r.doc_id or 0) for r in decontaminate.search(docs, items).collect()) == [0, 4, 5]
    page = "<article><p>" + long_text(60_000) + "</p></article>"
    pages = spark.createDataFrame([(1, "http://" + "a" * 50_000 + ".com/" + "b" * 50_000, page)], "page_id long, url string, html string")
    assert html.extract(pages).first().text == long_text(60_000)
    assert len(urls.judge(pages).first().path) == 50_001


def test_texts_hash_blocks_alike(monkeypatch):
    """Hashes don't depend on where blocks end."""
    texts = pa.array([long_text(300), None, "x" * 900, " a  b\n", long_text(40)])
    whole = common.Texts(texts).word_hashes()
    monkeypatch.setattr(common, "_BLOCK", 64)
    monkeypatch.setattr(common, "_POWERS", [])
    assert (common.Texts(texts).word_hashes() == whole).all()


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "hi"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 2, "assistant", None), (2, 1, None, "x" * 200_000), (3, 5, "assistant", "</turn>\\### "), (3, 5, "assistant", "</turn>\\### ")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (2, 2), 1: (3, 0), 2: (1, 0), 3: (2, 24)}
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


def test_training_on_odd_labels(spark):
    docs = spark.createDataFrame([(i, t) for i in range(60) for t in (("you idiot" if i % 2 else "good day"), None)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    low, high = model(common.Texts(pa.array(["good day", "you idiot"]), lower=True))
    assert low < 0.5 < high
    for none in (labels.limit(0), labels.where("toxic = 1")):
        assert 0 <= toxicity.train(docs, none)(common.Texts(pa.array([None], pa.string()), lower=True))[0] <= 1


def test_url_training_on_odd_labels(spark):
    known = spark.createDataFrame([("x://a.com/", 1), ("x://a.com/", None), (None, 1), ("", 0)] * 3, "url string, y int")
    assert urls.train(known).trees and urls.train(known.limit(0)).trees


def test_extra_columns_of_pages(spark):
    pages = spark.createDataFrame([(None, None, "<p>a <b>b", "x", 1), (1, "u", "<article><p>c &amp; d</p><script>x</p></script></article><footer>z", "y", 2)], "page_id long, url string, html string, text string, n_chars int")
    assert {r.page_id: r.text for r in html.extract(pages).collect()}[1] == "c & d"
    assert html.extract(pages.limit(0)).count() == 0 and mixing.mix(odd_docs(spark).limit(0)).count() == 0


def test_without_the_subpackage(monkeypatch):
    """The entry hides the absence of the subpackage, and no other error in it."""
    import importlib

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "loamgraph.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    entry = importlib.reload(__spark_entry__)
    assert "pipeline" not in entry.queries() and "f_chain_sorted" in entry.queries()
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(__spark_entry__).queries()


def test_pipeline(spark):
    """Each stage against plain Python, on all rows of the smallest tables."""
    docs, seen = common.table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF))
        seen.append([r.asDict() for r in docs.collect()])
    first, joined, clean, mixed, placed = seen
    everything = [r.asDict() for r in common.table(spark, SF, "documents").collect()]
    judged = {r.doc_id for r in quality.judge(common.table(spark, SF, "documents")).where("kept").collect()}
    assert Counter(map(repr, first)) == Counter(repr(r) for r in everything if r["doc_id"] in judged) and 0 < len(first) < len(everything)

    def sets(text, k=5):
        w = WORD.findall(text.translate(urls._LOWER))
        return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}

    own = {r["doc_id"]: sets(r["text"]) for r in first}
    group = {i: i for i in own}
    for a in sorted(own):
        for b in own:
            if b < a and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    assert {r["doc_id"] for r in joined} == set(group.values()) and len(joined) == len(set(group.values()))
    items = [sets(r.text) for r in common.table(spark, SF, "benchmark").where("text is not null").collect() if len(WORD.findall(r.text)) >= 5]
    tainted = {i for i, s in own.items() if any(5 * len(s & x) >= 4 * len(x) for x in items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in joined} - tainted
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in clean}
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in placed) == copies and {r["shard"] for r in placed} <= set(range(40))
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(clean, docs.drop("shard", "virtual_slot").schema)).collect()}
    assert {i: n for i, n in want.items() if n} == copies
    assert all(zlib.crc32(r["text"].encode()) >= 0 for r in placed)
