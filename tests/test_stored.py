"""Versioned tables, the inverted index, stored adjacency and lists of vectors."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.operators import rank, traverse
from loamgraph.operators.adjacency import Adjacency
from loamgraph.operators.nearest import VectorIndex
from loamgraph.operators.postings import Index
from loamgraph.sources.store import Commit, Conflict, Store
from loamgraph.streaming import changes


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.update(lambda now: now.create("t", "id long, v string", ["id"], 8))
    return s


def test_versions(spark, store):
    put = lambda *rows: spark.createDataFrame(rows, "id long, v string")
    store.update(lambda now: now.append("t", put((1, "a"), (2, "b"))))
    store.update(lambda now: now.append("t", put((3, "c"))))
    assert rows_of(store.read("t")) == [(1, "a"), (2, "b"), (3, "c")] and rows_of(store.read("t", 2)) == [(1, "a"), (2, "b")]
    merged = store.update(lambda now: now.merge("t", put((2, "B"), (9, "z"))), ("stream", 7))
    assert rows_of(store.read("t")) == [(1, "a"), (2, "B"), (3, "c"), (9, "z")]
    # The same batch again, and one before it, change nothing.
    for n in (7, 6):
        assert store.update(lambda now: now.merge("t", put((2, "again"))), ("stream", n)) == merged
    store.update(lambda now: now.merge("t", put((1, None), (2, "x")).withColumn("gone", F.col("id") == 1), "gone"))
    assert rows_of(store.read("t")) == [(2, "x"), (3, "c"), (9, "z")] and rows_of(store.read("t", merged))[0] == (1, "a")
    store.update(lambda now: now.reset("t"))
    assert store.read("t").count() == 0 and store.read("t", merged).count() == 4
    with pytest.raises(KeyError):
        store.state(99)


def test_merge_rewrites_only_what_it_touches(spark, store):
    store.update(lambda now: now.append("t", spark.range(1000).select("id", F.lit("a").alias("v"))))
    before = store.state().tables["t"].folders
    touched = []
    store.update(lambda now: touched.extend(now.merge("t", spark.createDataFrame([(5, "b")], "id long, v string"))))
    after = store.state().tables["t"].folders
    assert len(touched) == 1 and [b for b in before if before[b] != after[b]] == [str(touched[0])]
    plan = store.state().read("t", touched)._jdf.queryExecution().toString()
    assert plan.count("_bucket=") == 0 or "1 paths" in plan
    assert store.state().read("t", touched).count() == spark.range(1000).where(F.pmod(F.xxhash64("id"), F.lit(8)) == touched[0]).count()


def test_two_writers_and_a_dead_one(spark, store):
    row = lambda v: spark.createDataFrame([(1, v)], "id long, v string")
    first, second = store.state(), store.state()
    for now, v in ((first, "a"), (second, "b")):
        now.append("t", row(v))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert rows_of(store.read("t")) == [(1, "a")]
    # A writer that comes second works on what the first has left.
    calls = []

    def change(now: Commit):
        calls.append(now.version)
        if len(calls) == 1:
            store.update(lambda other: other.merge("t", row("between")))
        now.merge("t", spark.createDataFrame([(2, "mine")], "id long, v string"))

    store.update(change)
    assert len(calls) == 2 and rows_of(store.read("t")) == [(1, "between"), (2, "mine")]
    # A commit that was cut off while it was written isn't one.
    last = store.versions()[-1]
    (Path(store.at) / "_log" / f"{last + 1:020d}.json").write_text('{"tables": {')
    assert store.versions()[-1] == last and store.state().version == last


def test_vacuum(spark, store):
    for v in "abc":
        store.update(lambda now, v=v: now.merge("t", spark.createDataFrame([(1, v)], "id long, v string")))
    assert store.vacuum(keep=1) >= 2 and rows_of(store.read("t")) == [(1, "c")] and len(store.versions()) == 1


def test_stream_into_a_store(spark, store, tmp_path):
    """Files arrive twice in other micro-batches; a batch that is applied again after a loss counts once."""
    src = tmp_path / "src"
    for k, rows in enumerate(([("a.md", 1, "one")], [("a.md", 2, "two"), ("b.md", 1, "b")])):
        spark.createDataFrame(rows, "path string, modificationTime long, v string").coalesce(1).write.parquet(str(src / f"d{k}"))
    store.update(lambda now: now.create("files", "path string, modificationTime long, v string", ["path"], 4))

    def apply(batch, number):
        for _ in range(2):
            store.update(lambda now: now.merge("files", batch), ("files", number))

    stream = spark.readStream.schema("path string, modificationTime long, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    changes.index_stream(stream, str(tmp_path / "state"), apply).awaitTermination()
    assert {r.path for r in store.read("files").collect()} == {"a.md", "b.md"}
    assert store.state().batches["files"] == len(store.versions()) - 3


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(f"d{i}", " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rnd.randrange(1, 60)))) for i in range(n)]


def test_index_equals_scan(spark, tmp_path):
    texts = corpus(600)
    df = spark.createDataFrame([*texts, ("empty", None), (None, "w1 w2")], "id string, text string")
    index = Index(Store(spark, str(tmp_path / "i")), blocks=24)
    index.put(df.where("id is null or id < 'd4'"))
    index.put(df.where("id >= 'd4'"))

    def scan(rows, query):
        got = rank.bm25(rows.where("id is not null"), query).where("lexical > 0").collect()
        return sorted(((r.id, round(r.lexical, 9)) for r in got), key=lambda x: (-x[1], x[0]))

    def stored(query, take=None):
        return sorted(((r.id, round(r.lexical, 9)) for r in index.search(query, take).collect()), key=lambda x: (-x[1], x[0]))

    for q in ("w1 w50", "w3", "w7 w7 w20 w59", "nothing the", ""):
        assert stored(q) == scan(df, q)
        assert stored(q, 10) == scan(df, q)[:10]
    # Replaced, taken out, put in again: figures of the corpus follow.
    changed = {**dict(texts), "d7": "w50 w50 w50", "d9": "w1"}
    del changed["d11"], changed["d450"]
    index.put(spark.createDataFrame([("d7", "w50 w50 w50"), ("d9", "w2"), ("d11", "x")], "id string, text string"))
    index.remove(spark.createDataFrame([("d11",), ("d450",), ("unknown",)], "id string"))
    version = index.put(spark.createDataFrame([("d9", "w1")], "id string, text string"))
    now = spark.createDataFrame([*changed.items(), ("empty", None)], "id string, text string")
    for q in ("w1 w50", "w3 x"):
        assert stored(q) == scan(now, q) and stored(q, 7) == scan(now, q)[:7]
    index.compact()
    assert stored("w1 w50") == scan(now, "w1 w50") and stored("w1 w50", 7) == scan(now, "w1 w50")[:7]
    assert index.store.state().read("gone").count() == 0 and index.search("w1", version=version).count() == index.search("w1").count()


def test_index_reads_the_terms_buckets_only(spark, tmp_path):
    index = Index(Store(spark, str(tmp_path / "i")))
    index.put(spark.createDataFrame(corpus(200), "id string, text string"))
    now = index.store.state()
    bucket = now.bucket_of("postings", "w3")
    files = {f for f in now.read("postings", [bucket]).inputFiles()}
    assert files and all(f"_bucket={bucket}/" in f for f in files) and len(files) < len(now.read("postings").inputFiles()) / 4
    # Texts of a block with a low bound aren't scored: a term said often in one block only.
    rows = [(f"x{i}", "rare " * (40 if i == 3 else 1) + "w1 " * 30) for i in range(400)]
    index.put(spark.createDataFrame(rows, "id string, text string"))
    assert index.search("rare", 1).first().id == "x3"


def test_adjacency_equals_scans(spark):
    rnd = random.Random(5)
    pairs = [("e", f"n{rnd.randrange(3000)}", f"n{rnd.randrange(3000)}") for _ in range(9000)] + [("h", "hub", f"n{k}") for k in range(3000)] + [("e", None, "n1"), ("e", "n1", None)]
    edges = spark.createDataFrame(pairs, "type string, source string, target string")
    from loamgraph.operators import adjacency

    before, adjacency.LEAST = adjacency.LEAST, 500
    try:
        stored = Adjacency.build(edges, buckets=4)
    finally:
        adjacency.LEAST = before
    assert spark.read.parquet(f"{stored.at}/source-hubs").count() == 3000 and spark.read.parquet(f"{stored.at}/target-hubs").count() == 0
    far = spark.createDataFrame([("n7",), ("n8",)], "id string")
    good = edges.where("source is not null and target is not null").distinct()
    for least, most in ((1, 3), (2, 2), (1, None)):
        assert rows_of(stored.reach(far, least, most)) == rows_of(traverse.reach(good, far, least, most))
    assert rows_of(stored.reach(far, 1, 2, ["e"])) == rows_of(traverse.reach(good.where("type = 'e'"), far, 1, 2))
    # Frontiers above and below what a filter lists give the same edges, the hub's among them.
    many = spark.createDataFrame([(f"n{k}",) for k in range(1000)] + [("hub",)], "id string")
    want = rows_of(good.join(many, good.source == many.id, "left_semi").select("type", "source", "target"))
    assert rows_of(stored.step(many, "source")) == want
    some = many.where("id in ('hub', 'n1', 'n2')")
    assert rows_of(stored.step(some, "source")) == [x for x in want if x[1] in ("hub", "n1", "n2")]
    walked = {r.id: r.distance for r in stored.walk(far, 2).collect()}
    near = {"n7": 0, "n8": 0}
    for hop in (1, 2):
        for _, a, b in (p for p in pairs if None not in p):
            for x, y in ((a, b), (b, a)):
                if near.get(x) == hop - 1:
                    near.setdefault(y, hop)
    assert walked == near


def test_adjacency_shuffles_no_edges(spark):
    """Three hops with frontiers too large for a filter: no exchange lies above the scan of the stored edges."""
    edges = spark.range(60_000).select(F.concat(F.lit("n"), F.col("id") % 5000).alias("source"), F.concat(F.lit("n"), (F.col("id") * 7 + 1) % 5000).alias("target"))
    stored = Adjacency.build(edges, buckets=8)
    again = Adjacency(spark, stored.at, 8)
    frontier = spark.range(2500).select(F.concat(F.lit("n"), "id").alias("id"))
    plan = again.step(frontier, "target")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = []
    for x in reversed(lines[:scan]):
        d = len(x) - len(x.lstrip(" :+-"))
        if d < depth:
            above.append(x)
            depth = d
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "SortMergeJoin" in x)])
    # One id as a filter: files of other buckets aren't opened, so it doesn't matter what is in them.
    one = spark.createDataFrame([("n1",)], "id string")
    want = rows_of(again.step(one, "target"))
    spoilt = 0
    for f in Path(stored.at, "target").glob("part-*.parquet"):
        if "n1" not in {r.target for r in spark.read.parquet(str(f)).select("target").distinct().collect()}:
            f.write_bytes(b"no parquet")
            spoilt += 1
    assert spoilt >= 6 and want and rows_of(Adjacency(spark, stored.at, 8).step(one, "target")) == want


def test_vector_lists_recall(spark):
    """All ids divisible by 100 against all rows, on the table's vectors and on skewed ones; every row can be found."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rng = np.random.default_rng(4)
    around = rng.normal(size=(12, 24))
    made = around[rng.integers(0, 12, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    made[:2000] = around[0] + 0.05 * rng.normal(size=(2000, 24))
    clustered = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(6001, None), (6002, []), (6003, [0.0] * 24), (6004, [1.0] * 3)], "id long, vector array<float>")
    for rows in (table, clustered):
        asked = rows.where("id % 100 = 0")
        index = VectorIndex.build(rows)
        found, exact = index.search(asked, 20), rank.nearest_each(rows.where("size(vector) > 3"), asked, 20)
        want = {(r.query_id, r.id) for r in exact.collect()}
        got = {(r.query_id, r.id): r.score for r in found.collect()}
        assert len(want & set(got)) >= 0.9 * len(want)
        # Scores are exact, and all lists together hold every row.
        known = {(r.query_id, r.id): r.score for r in exact.collect()}
        assert all(abs(s - known[k]) < 1e-6 for k, s in got.items() if k in known)
    assert index.codes.select(F.sum(F.size("ids"))).first()[0] == 6001 and index.codes.agg(F.max(F.size("ids"))).first()[0] < 1300
    assert index.centroids.probes < len(index.centroids.at)
    whole = index.search(asked, 20, probes=len(index.centroids.at))
    assert len({(r.query_id, r.id) for r in whole.collect()} & want) >= 0.98 * len(want)


def test_postings_and_bounds_are_shuffled_once(spark, tmp_path, monkeypatch):
    """What a text says is counted where it lies: only the write deals rows to tasks."""
    plans, write = [], Commit._write
    monkeypatch.setattr(Commit, "_write", lambda self, t, rows, *rest: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, t, rows, *rest))
    index = Index(Store(spark, str(tmp_path / "i")))
    index.put(spark.createDataFrame(corpus(50), "id string, text string"))
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)


def test_words_of_pieces_are_counted_as_those_of_texts(monkeypatch):
    import pyarrow as pa

    from loamgraph.functions.text import STOPWORDS, stem_of
    from loamgraph.operators import postings

    rnd = random.Random(3)
    words = ["the", "and", "sings", "singing", "sing", "é", "ærlige", "x1", "nations", "nation", "es", "ly", "bees"]
    texts = [" ".join(rnd.choices(words, k=k)) for k in (0, 1, 3, 200, 0, 7, 50)] + [" the ", " sings  "]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["id", "words"])
    monkeypatch.setattr(postings, "AT_ONCE", 64)
    made = list(postings.said(iter([batch, batch.slice(0, 0)])))
    got = [(r["id"], r["n"], {x["term"]: x["tf"] for x in r["said"]}) for m in made for r in m.to_pylist()]
    kept = [[stem_of(w) for w in t.split() if w not in STOPWORDS] for t in texts]
    assert len(made) > 3 and got == [(str(i), len(k), {w: k.count(w) for w in k}) for i, k in enumerate(kept)]
