from datetime import datetime, timedelta

import pytest

from loamgraph.functions import passages, temporal
from loamgraph.operators import analytics, expand
from loamgraph.plans import catalog, checks
from loamgraph.plans.filter import FilterError, parse, query, validate
from loamgraph.sources.graph import Graph
from loamgraph.streaming import changes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "want"),
    [("today-1m", datetime(2026, 2, 28)), ("now-2h", datetime(2026, 3, 31, 7, 30)), ("today+1y", datetime(2027, 3, 31)), ("today-5x", None), ("today-1w", datetime(2026, 3, 24))],
)
def test_relative_dates(text, want):
    assert temporal.relative(text, datetime(2026, 3, 31, 9, 30)) == want


def test_spans():
    assert temporal.span("7d") == timedelta(days=7) and temporal.span("48h30m") == timedelta(hours=48.5)
    assert temporal.span("1d2h") == timedelta(hours=26)
    assert [temporal.span(x) for x in ("", "0d", "x", "-1h", "5")] == [None] * 5


def test_hints_and_shapes(spark):
    g = Graph(spark, SF)
    assert "mean 'p_size'" in validate(parse("p_sise=3"), strict=True)[0]
    for text in ("placed-bi->", "words>a type=part", "o_orderdate>today-5x"):
        with pytest.raises(FilterError) as e:
            query(g, text)
        assert "mean" in str(e.value) or "list" in str(e.value) or "relative" in str(e.value)


def test_chunks():
    text = "\n## ".join(f"head {i} " + "word " * 50 for i in range(40))
    got = passages.chunk(text, 600, 800, 50)
    assert max(len(c.encode()) for c in got) <= 800
    assert got[0] + "".join(c[50:] for c in got[1:]) == text
    assert passages.chunk("") == [""] and passages.chunk(None) == [""]
    assert passages.chunk("x" * 9000, 1600, 4000, 0) == ["x" * 4000, "x" * 4000, "x" * 1000]


def test_snippet():
    assert passages.snippet("a \n b", "") == "a b"
    assert passages.snippet("one two three four five six", "the five", 12) == "…five six"
    assert passages.snippet("word " * 30, "", 9) == "word word…"
    assert passages.snippet("", "x") == ""


def test_blend_arithmetic(spark):
    edges = spark.createDataFrame([("r", "a", "n"), ("r", "b", "n"), ("r", "n", "m"), ("r", "n", "n")], "type string, source string, target string")
    near = expand.both_ways(edges)
    seeds = spark.createDataFrame([("a", 0.8), ("b", 0.6)], "id string, score double")
    got = {r.id: r for r in expand.blend(near, expand.walk(near, seeds, 2), 0.5).collect()}
    assert got["n"].graph == pytest.approx(0.7) and got["n"].final == pytest.approx(0.35)
    assert got["m"].distance == 2 and got["m"].graph == pytest.approx(0.35) and got["m"].final == pytest.approx(0.175)
    assert got["a"].final == pytest.approx(0.4)


def test_fold(spark):
    rows = [("l", "f#S1", "t", "direct"), ("l", "f#S1P1", "t", "direct"), ("l", "f#S10", "t", "direct"), ("l", "f", "u", "direct"), ("contains", "f", "f#S1", "structural")]
    got = {(r.source, r.target): r.units for r in expand.fold(spark.createDataFrame(rows, "type string, source string, target string, kind string")).collect()}
    assert got == {("f", "t"): ["f#S10", "f#S1P1"], ("f", "u"): []}


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "ab" for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([*cliques, ("a0", "b0", 0.01)], "source string, target string, weight double")
    got = {r.id: r.community for r in analytics.communities(edges).collect()}
    assert got == {f"{c}{i}": f"{c}0" for c in "ab" for i in range(4)}


def test_labels(spark):
    now = spark.createDataFrame([("x", "x"), ("y", "x"), ("z", "z")], "id string, community string")
    before = spark.createDataFrame([("x", "L"), ("y", "L"), ("z", "L")], "id string, label string")
    assert {r.id: r.label for r in analytics.keep_labels(now, before).collect()} == {"x": "L", "y": "L", "z": "z"}


def test_ancestors_and_cycles(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(11)]
    up = spark.createDataFrame([*chain, ("p", "q"), ("q", "p"), ("o", "q")], "source string, target string")
    got = {r.id: r.ancestor for r in analytics.ancestors(up).collect()}
    assert {got[f"n{i:02}"] for i in range(12)} == {"n11"} and got["p"] == got["q"] == "p"
    assert {r.id: r.ancestor for r in analytics.ancestors(up, 2).collect()}["n09"] == "n11"
    edges = spark.createDataFrame([*chain, ("n02", "n00"), ("s", "s"), ("p", "q"), ("q", "p")], "source string, target string")
    assert {r.id: r.cycle for r in analytics.cycles(edges).collect()} == {"n00": "n00", "n01": "n00", "n02": "n00", "s": "s", "p": "p", "q": "p"}


def test_transitions(spark):
    rows = [("a", None, "open"), ("b", None, "done"), ("c", "open", "done"), ("d", "done", "open"), ("e", "open", None), ("f", "open", "odd"), ("g", "gone", "done"), ("h", "open", "open")]
    got = {r.id: r.error for r in checks.transition(spark.createDataFrame(rows, "id string, before string, after string"), {"open": ["done"], "done": []}, ["open"]).collect()}
    assert got == {"a": None, "b": "not-initial", "c": None, "d": "illegal-transition", "e": "unset", "f": "unknown-state", "g": None, "h": None}


def test_cascade(spark):
    nodes = spark.createDataFrame([("f",), ("f#S1",), ("fg",)], "id string")
    edges = spark.createDataFrame([("f#S1", "fg"), ("fg", "f")], "source string, target string")
    n, e = changes.cascade(nodes, edges, spark.createDataFrame([("f",)], "id string"))
    assert [r.id for r in n.collect()] == ["fg"] and [r.source for r in e.collect()] == ["fg"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    assert rows.count() > 0 and all("(" not in c for c in rows.columns)


def test_nearest_of_every_query(spark):
    rows = catalog.QUERIES["r05_cosine_all"](spark, SF).collect()
    by = {q: [r.id for r in rows if r.query_id == q] for q in range(0, 500, 100)}
    assert len(rows) == 100 and all(len(ids) == 20 for ids in by.values())
    assert set(by[0]) == {r.id for r in catalog.QUERIES["r05_cosine"](spark, SF).collect()}


def test_edges_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from loamgraph.operators import mutate, storage
    from loamgraph.plans import checks

    monkeypatch.setattr(storage, "ROWS", 10)
    edges = spark.createDataFrame([("t", f"a{i % 30}", f"b{i % 45}", "direct", i) for i in range(200)] + [("u", "a1", "b1", "direct", 1)], "type string, source string, target string, kind string, position int")
    once = mutate.deduplicated(edges, 201)
    assert once.rdd.getNumPartitions() == 21 and sorted(map(tuple, once.collect())) == sorted(map(tuple, mutate.deduplicated(edges).collect()))
    many = checks.too_many(edges, ["t", "u"], 201)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == sorted(("error", "edge-cardinality-violation", f"a{i}", "t has 3 targets") for i in range(30))
