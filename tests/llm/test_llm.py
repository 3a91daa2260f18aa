import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pathlib import Path

from loamgraph.llm import chat, decontaminate, html, jaccard, mixing, quality, queries, sharding, spans, toxicity, urls
from loamgraph.llm.common import Texts, components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, slot long"
ODD = [(1, None, "en", "a", 0, "k", 1, 1), (2, "", "en", None, 0, None, 2, 2), (3, "one two three", None, "a", 3, "k", 3, 3), (3, "one two three", None, "a", 3, "k", 3, 3), (None, "w " * 5000, "en", "b", 9, "k", 4, 4)]


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs, names: sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rs)
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), list(want.columns))


def test_odd_rows(spark):
    """Nulls, empty and repeated rows, columns of clashing names, and an empty table."""
    odd = spark.createDataFrame(ODD, DOCS)
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        assert mixing.mix(docs).count() == n
        assert quality.judge(docs).count() == n
        assert jaccard.join(docs).count() == n
        assert spans.dedup(docs).count() == n
        placed, _ = sharding.assign(sharding.sized(docs), 4)
        assert sharding.numbered(placed).count() == n
        assert toxicity.score(docs, toxicity.fit(pa.array(["a bad idiot", "good day"]), np.array([1, 0]))).count() == n
        assert decontaminate.search(docs, spark.createDataFrame([(1, "w " * 9), (2, None)], "item_id long, text string")).count() == (1 if n else 0)
    pages = spark.createDataFrame([(1, None, None, 1), (None, "x", "<p>hi", 1), (1, None, None, 1)], "page_id long, url string, html string, text int")
    assert {r.text for r in html.extract(pages).collect()} <= {"", "hi"}
    assert urls.judge(pages).count() == 3 and urls.judge(pages.limit(0)).count() == 0


def test_base_measures_brute_force():
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [None, "", "a b a b a b a b a b a b", "x # é\nx # é\n\n \nq", "ü" * 30 + " b\tc\rd", "a b c d e f g h i a b c d e f g h z " * 3]
    m = quality.measures(Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        t = t or ""
        ws = word.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        at = {}
        for k in range(len(ws) - 7):
            at.setdefault(tuple(ws[k : k + 8]), []).append(k)
        cover = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert tuple(int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_tree_join_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = [np.unique(rng.integers(0, 500, rng.integers(1, 60))) for _ in range(4)]
        sets = []
        for _ in range(rng.integers(2, 90)):
            b = base[rng.integers(0, 4)]
            for _ in range(rng.integers(0, 4)):
                b = np.unique(np.append(b[rng.random(len(b)) > 0.03], rng.integers(0, 900)))
            sets.append(b)
        own = [set(s.tolist()) for s in sets]
        want = {(i, j) for j in range(len(own)) for i in range(j) if 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])}
        assert set(jaccard.tree_join(sets, np.array([len(s) for s in sets]), 85)) == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and got[100] == got[95] == 90


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok", "\\", "", "a</turn>\n### user: b", "\\\\</turn", "### ### x"])
def test_chat_round_trip(text):
    turns = [("user", text), ("assistant", text), ("a:b", text)]
    assert chat.parse("".join("".join(chat.turn(r, t)) for r, t in turns)) == turns


def test_spans_keep_first(spark):
    passage = " ".join(f"Word{i} is number {i} in this very line." for i in range(9))
    docs = spark.createDataFrame([(1, "Alpha begins here. " + passage), (2, "Beta is other text. " + passage + " Gamma ends it here."), (3, "Clean words only. Nothing is said twice. All good.")], "doc_id long, text string")
    got = {r.doc_id: r for r in spans.dedup(docs).collect()}
    assert got[1].cut_words == got[3].cut_words == 0 and got[1].text.endswith(passage)
    assert got[2].text == "Beta is other text. Gamma ends it here."


def test_spans_passages_at_every_offset(spark):
    """Copies of 51 words that start and end inside sentences of 8 to 16 words, at every offset."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    rows = []
    for size in (8, 14, 15, 16):
        for at in range(size * 3):
            source = [w + "." * (k % size == size - 1) for k, w in enumerate(words(size * 9))]
            rows.append((2 * len(rows), " ".join(source)))
            rows.append((2 * len(rows) + 1, " ".join(words(5) + source[at : at + 51] + words(7))))
    got = {r.doc_id: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].cut_words == 0 for k, _ in rows[::2])
    assert min(got[k].cut_words for k, _ in rows[1::2]) >= 20
    assert max(got[k].cut_words for k, _ in rows[1::2]) <= 51
    for k, text in rows:
        assert len(got[k].text.split()) == len(text.split()) - got[k].cut_words


def test_spans_tell_rows_apart(spark):
    """Null and repeated ids: a row loses only what it repeats, and one copy of everything stays."""
    line = lambda name: " ".join(f"{name}{i} is number {i} in the line of {name}." for i in range(8))
    rows = [(None, line("Aa") + " " + line("Bb")), (None, line("Cc") + " " + line("Aa")), (None, line("Dd") + " " + line("Ee"))]
    rows += [(None, line("Ff"))] * 3 + [(7, line("Gg") + " " + line("Hh")), (7, line("Ii") + " " + line("Gg")), (8, line("Hh")), (9, line("Jj")), (9, line("Jj"))]
    got = [r.text for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    everything = " ".join(got)
    for name in "Aa Bb Cc Dd Ee Ff Gg Hh Ii".split():
        assert everything.count(line(name)) == everything.count(f"of {name}.") // 8 == 1, name
    assert got.count(line("Jj")) == 2  # a row that is there twice


def test_shards(spark):
    rows = sharding.op7_virtual_slots(spark, SF).toPandas()
    assert sorted(rows["shard"].unique()) == list(range(40))
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_slot_map_moves_little(spark):
    loads = spark.range(400).selectExpr("cast(id as int) virtual_slot", "1000L + id bytes")
    one = sharding.edit_map(loads, 8)
    two = sharding.edit_map(loads, 9, one, version=1)
    a, b = (dict(m.select("virtual_slot", "shard").collect()) for m in (one, two))
    moved = [s for s in a if a[s] != b[s]]
    assert 0 < len(moved) < 70 and set(b.values()) == set(range(9))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op10_subword_softmax(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    clean = got[got["toxic"] == 0]
    assert (clean["predicted"] == 0).mean() > 0.95
    assert got[got["toxic"] == 1]["score"].mean() > clean["score"].mean() + 0.3


def test_toxicity_of_repeated_words():
    """A text scores alike beside any other, and a repeated insult as the insult."""
    m = toxicity.fit(pa.array(["you idiot", "good day"] * 20), np.array([1, 0] * 20))
    texts = ["idiot", "idiot", "idiot you", "you idiot", "idiot", "idiot idiot idiot idiot", "you you idiot"]
    got = m(Texts(pa.array(texts)))
    assert np.allclose(got, [m(Texts(pa.array([t])))[0] for t in texts])
    assert np.allclose(got[[0, 1, 4, 5]], got[0]) and got[0] > m(Texts(pa.array([""])))[0]


def test_pages_main_text(spark):
    got = html.op9_dom_tree_model(spark, SF).toPandas()
    page = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id").html
    assert (got["n_chars"] > 0).mean() > 0.95
    for r in got.itertuples():
        title = re.search(r"<h1>([^<&]*)</h1>", page[r.page_id])
        if title and title[1].strip() and r.text:
            assert " ".join(title[1].split()) in r.text and "©" not in r.text


@pytest.mark.parametrize("start", ["<head><title>T</title>", "<html><head><meta charset=x><noscript><body>", "<head><template><body>", "<head><link href=x></head><body>"])
def test_head_left_open(start):
    nodes, runs = html.parse(start + "<article><p>Main text</p></article>")
    assert [t for _, t in runs] == ["Main text"] and "article" in [x.tag for x in nodes]


def test_every_class_word_is_a_feature():
    nodes, _ = html.parse('<div class="aa bb cc dd ee ff gg hh sidebar">x</div>')
    assert "c:sidebar" in html.features(nodes)[1]
