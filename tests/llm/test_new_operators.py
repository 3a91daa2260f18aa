"""The prefix trie, the discriminant and the whitening against plain Python, held-out labels and numpy."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loamgraph.llm import discriminant, queries, trie, whitening
from loamgraph.llm.common import Texts

SF = "/root/testdata/sf0.01"


def plain_trie(rows):
    """All nodes of the rebuilt conversations, by walking every prefix."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in own.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        new[c] = own.get(base, [])[:h] + v[h:]
    members, ends = {}, {}
    for c, v in new.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = set()
    for node, m in members.items():
        up = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.add((min(m), len(node), up, len(m), len(kids.get(node, [])), leaves[node], saved[node], sha))
    return out


def trie_of(spark, rows):
    of = trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = trie.prefix_trie(trie.rebuilt(of), of.select("conv_id").distinct()).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_trie_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(None, 0, "user", "lost"), (None, None, None, None)]
    for c in [*range(-12, 25), 10**15, 10**15 + 3, -(10**15) - 2]:
        for t in range(rnd.choice([1, 2, 5, 12])):
            rows.append((c, rnd.choice([t, t, t // 2, None]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["hi", "é", None, "", "a" * 3])))
    rows += [(5, 0, "user", "same")] * 3 + [(5, 1, "x" * 70 + "a", "b"), (5, 1, "x" * 70 + "b", "a"), (7, 9, "user", "long " * 60_000)]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert trie_of(spark, rows[:2]) == set()


def test_trie_of_one_huge_conversation(spark):
    """One conversation with most of all rows is spread over tasks, and its depth takes a logarithmic number of rounds."""
    rows = [(3, t, "user", f"t{t % 7}") for t in range(3000)] + [(c, t, "user", f"t{t}") for c in range(40, 60) for t in range(4)]
    of = trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(r[0] for r in of.where("conv_id = 3").select("depth").collect()) == list(range(1, 3001))
    got = trie.prefix_trie(trie.rebuilt(of), of.select("conv_id").distinct())
    want = [(n[0], n[1], n[3], n[5], n[6]) for n in plain_trie([r for r in rows if r[0] != 3 or r[1] < 150])]
    root = next(x for x in want if x[1] == 0)
    here = got.where("depth = 0").first()
    assert (here.conv_id, here.n_convs, here.n_leaves) == (root[0], root[2], root[3])
    deep = got.where("conv_id = 3").agg({"depth": "max", "n_leaves": "sum"}).first()
    assert deep[0] >= 2990


def test_trie_of_many_copies(spark):
    """A node in which many conversations end hashes their ids in order, over several rows of ids."""
    ids = list(range(1000, 31_000, 2))
    rows = spark.createDataFrame([(b"a" * 16, c) for c in random.Random(1).sample(ids, len(ids))] + [(b"b" * 16, 7)], "node binary, conv_id long")
    got = {bytes(r[0]): r[1] for r in trie.ends_digests(rows).collect()}
    assert got == {b"a" * 16: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b" * 16: hashlib.sha256(b"7").hexdigest()}


def test_trie_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = queries.QUERIES["op11_pointer_jumping"](spark, SF)
    want = c.execute(f"select {', '.join(got.columns)} from ({trie.SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_discriminant_held_out(spark):
    got = queries.QUERIES["op12_quadratic_discriminant"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    known = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in known)
    held = [r for r in known if r.held_out]
    good, bad = ([r.score for r in held if r.quality == y] for y in (1, 0))
    assert np.mean([x >= 0.3 for x in good]) > 0.97 and np.mean([x < 0.3 for x in bad]) > 0.9
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_discriminant_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = discriminant.measured(docs)
    other = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = (discriminant.train(rows, x) for x in (labels, other))
    assert (a.slope, a.shift) == (b.slope, b.shift) and all(np.array_equal(p.inverse, q.inverse) for p, q in zip(a.classes, b.classes, strict=True))


def test_discriminant_sums_and_density():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(discriminant.NAMES))) * np.arange(1, len(discriminant.NAMES) + 1) + 3
    parts = discriminant.Sums.of(x[:100]) + discriminant.Sums.of(x[100:101]) + discriminant.Sums.of(x[:0]) + discriminant.Sums.of(x[101:])
    assert parts.n == 500 and np.allclose(parts.mean, x.mean(0)) and np.allclose(parts.square / 500, np.cov(x.T, bias=True))
    scale = np.full(x.shape[1], 1e-9)
    g = discriminant.Gaussian.fit(parts, parts.square / 500, scale, (0.0, 0.0))
    cov = np.cov(x.T, bias=True) + np.diag(0.01 * scale)
    want = -0.5 * np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0)) - 0.5 * np.linalg.slogdet(cov)[1]
    assert np.allclose(g.log_density(x), want)
    assert np.isclose(g.log_likelihood(parts), want.sum())


def test_discriminant_odd_rows(spark):
    rows = [(None, None), (None, None), (1, ""), (2, "short"), (3, "word " * 200_000), (3, "word " * 200_000), (4, "Some plain words here. " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as x", "7 as y", "7 as fold", "7 as score")
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 3")):
        measured = discriminant.measured(docs)
        got = discriminant.score(measured, discriminant.train(measured, known)).collect()
        assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in rows) and all(0 <= r[1] <= 1 for r in got)
        assert len({r[1] for r in got if r[0] == 3}) == 1
    assert discriminant.score(discriminant.measured(docs.limit(0)), discriminant.Model(None, 1.0, 0.0)).count() == 0
    assert not discriminant.statistics(Texts(pa.array([None, ""]))).any()


def numpy_whitening(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, s, values[::-1], vectors[:, ::-1]


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>")


def whiten(spark, rows, k=16):
    rows = whitening.integer_vectors(rows)
    fitted = rows.select("x").distinct()
    w = whitening.fit(fitted, k)
    return w, whitening.whitened(rows, w, whitening.identity_error(fitted, w)).collect()


@pytest.mark.parametrize("d", [5, 64, 200])
def test_whitening_equals_numpy(spark, d):
    """Flat spectra, more dimensions than a block, fewer than components, and a vector that a third of the rows have."""
    rng = np.random.default_rng(d)
    emb = (rng.normal(size=(400, d)) * np.linspace(1, 1.2, d)).astype(np.float32)
    emb[::3] = emb[0]
    w, got = whiten(spark, vectors(spark, emb))
    x = np.floor(64 * emb.astype(float)).astype(np.int64) + 1_000_000
    n, s, values, found = numpy_whitening(x)
    k = min(16, d)
    assert w.n == n and len(got) == 400 * k
    assert np.allclose([r.explained for r in sorted(got)[:k]], values[:k] / values.sum(), rtol=1e-10)
    assert got[0].identity_error < 1e-9
    want = (n * x - s) / n @ (found[:, :k] / np.sqrt(values[:k]))
    here = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(400, k)
    assert np.allclose(np.abs(here), np.abs(want), atol=1e-6)
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}
    assert all(exact[r.vec_id] == r.deviation for r in got)


def test_subspace_iteration_starts_anew(spark):
    """With few blocks kept, as where d is large, the best columns go on until all residuals are certified."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 300)) * 0.9 ** np.arange(300)
    v = a.T @ a
    values, found, passes, residual = whitening.leading(lambda q: v @ q, 300, 4, spare=4, kept=3)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(values, want, rtol=1e-12) and residual <= whitening.RESIDUAL and passes > 3
    assert np.allclose(found.T @ found, np.eye(4), atol=1e-10)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, nan]), (4, [-inf, 0.0]), (5, [1.0, 2.0]), (None, [0.5, 0.25]), (7, [0.5, 0.25]), (8, [1.0]), (9, []), (10, [3.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 as x", "7 as d")
    w, got = whiten(spark, df.select("vec_id", "embedding"))
    assert w.n == 3 and sorted({str(r.vec_id) for r in got}) == ["10", "5", "7", "None"] and len(got) == 8
    assert len({r.whitened for r in got if r.vec_id in (None, 7) and r.component == 1}) == 1
    assert whiten(spark, df.where("vec_id = 5"))[1] == [] and whiten(spark, df.limit(0))[1] == []
    # A direction in which nothing varies is no component.
    flat = vectors(spark, [[i, 2 * i, 5] for i in range(6)])
    w, got = whiten(spark, flat)
    assert {r.component for r in got} == {1} and got[0].identity_error < 1e-12


def test_deviation_beyond_a_long():
    w = whitening.Whitening(1 << 40, [0], np.ones(1), np.eye(1), 1.0, 1, 0.0)
    assert w.deviation(np.array([[1 << 30], [0]])) == [None, 0]


def test_a_long_turn_is_parsed_without_memory_beside_it():
    import tracemalloc

    from loamgraph.llm import chat

    text = "a<b \\ " * 3_000_000  # 18 million characters
    formatted = "".join(chat.turn("user", text))
    tracemalloc.start()
    got = chat.parse(formatted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [("user", text)] and peak < 300 << 20
