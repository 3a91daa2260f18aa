"""Cycles and communities by rounds of joins, against plain Python."""

import random

import pytest
from plain_graph import louvain, modularity, strong_groups
from pyspark.sql import functions as F

from loamgraph.operators import analytics


def edges_of(kind):
    rnd = random.Random(7)
    name = "n{:05}".format
    ring = [(name(i), name((i + 1) % 20)) for i in range(20)]
    tail = [(name(i), name(i + 1)) for i in range(100, 106)] + [(name(19), name(100)), (name(106), name(107))]
    if kind == "ring":
        return [*ring, *tail, ("loop", "loop"), ("p", "q"), ("q", "p")]
    if kind == "nested":  # rings that share nodes, ears on a ring, a bridge between two groups, a chain back to a node's own
        ears = [(name(3), "e1"), ("e1", "e2"), ("e2", name(9)), (name(9), "f1"), ("f1", name(3)), (name(12), "g1"), ("g1", "g2"), ("g2", name(12))]
        other = [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), (name(5), "b1"), ("b1", "x1"), ("x2", "y1"), ("y1", "y2")]
        return [*ring, *ears, *other, *tail]
    if kind == "sparse":
        return [(name(rnd.randrange(90)), name(rnd.randrange(90))) for _ in range(100)]
    if kind == "random":
        return [(name(rnd.randrange(900)), name(rnd.randrange(900))) for _ in range(1200)]
    groups = [(name(10 * g + rnd.randrange(10)), name(10 * g + rnd.randrange(10))) for g in range(8) for _ in range(40)]
    return groups + [(name(10 * g + rnd.randrange(10)), name(10 * g + 10 + rnd.randrange(10))) for g in range(7) for _ in range(3)]


@pytest.mark.parametrize("kind", ["nested", "random", "dense"])
def test_cycles(spark, kind):
    pairs = edges_of(kind)
    got = analytics.cycles(spark.createDataFrame(pairs, "source string, target string"))
    assert {r.id: r.cycle for r in got.collect()} == strong_groups(pairs)


def test_cycles_of_nothing(spark):
    empty = spark.createDataFrame([(None, "a"), ("b", None), ("c", "d")], "source string, target string")
    assert analytics.cycles(empty).count() == analytics.cycles(empty.limit(0)).count() == 0


def test_shortest_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "a"), ("x", "x"), ("a", "y")], "source string, target string")
    assert analytics.shortest_cycle(edges, "a") == ["a", "b", "c"]
    assert analytics.shortest_cycle(edges, "x") == ["x"] and analytics.shortest_cycle(edges, "y") == []
    assert analytics.closes_cycle(edges, "y", "a") and not analytics.closes_cycle(edges, "a", "y")


def test_communities_of_cliques(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcdef" for i in range(6) for j in range(i)]
    bridges = [(f"{a}0", f"{b}0", 0.1) for a, b in zip("abcde", "bcdef", strict=True)]
    got = analytics.communities(spark.createDataFrame([*cliques, *bridges], "source string, target string, weight double"))
    assert {r.id: r.community for r in got.collect()} == {f"{c}{i}": f"{c}0" for c in "abcdef" for i in range(6)}


@pytest.mark.parametrize("kind", ["dense"])
def test_communities_are_as_good_as_one_by_one(spark, kind):
    pairs = [(a, b) for a, b in edges_of(kind) if a != b]
    got = {r.id: r.community for r in analytics.communities(spark.createDataFrame(pairs, "source string, target string")).collect()}
    weighed = [(a, b, 1.0) for a, b in pairs]
    assert set(got) == {x for p in pairs for x in p}
    assert modularity(got, weighed) >= modularity(louvain(weighed), weighed) - 0.005
    # Groups hang together and are named by their smallest id.
    parts = analytics.components(spark.createDataFrame([p for p in pairs if got[p[0]] == got[p[1]]], "source string, target string"))
    assert {r.id: r.component for r in parts.collect()} | {x: c for x, c in got.items() if x == c} == got


def test_communities_of_loops_and_nothing(spark):
    edges = spark.createDataFrame([("a", "a", 2.0), ("b", "c", 0.0)], "source string, target string, weight double")
    assert {r.id for r in analytics.communities(edges).collect()} == {"a", "b", "c"}
    assert analytics.communities(edges.limit(0)).count() == 0


def test_components_and_walks_keep_few_files(spark):
    edges = spark.range(200).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target")).repartition(50)
    got = analytics.components(edges)
    assert got.select("component").distinct().count() == 1 and got.rdd.getNumPartitions() <= 24


def test_communities_broadcast_no_nodes(spark, monkeypatch):
    """Rows by node, however small their files look, don't pass through the driver."""
    from loamgraph.operators import components

    plans = []
    for module in (analytics, components):
        monkeypatch.setattr(module, "kept", lambda df, *a, write=module.kept, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a, **k))
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    got = {r.id: r.community for r in analytics.communities(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == {f"{g}{i}": f"{g}0" for g in "ab" for i in range(4)}
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
