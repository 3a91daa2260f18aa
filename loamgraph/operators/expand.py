"""Graph expansion: the surroundings of seeds, and scores blended along edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.storage import kept


def typed_edges(graph, kinds: list[str]) -> DataFrame:
    """(type, source, target) of several edge types."""
    return reduce(DataFrame.union, [graph.edges(k).select(F.lit(k).alias("type"), "source", "target") for k in kinds])


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other): each undirected pair in both directions, once; loops are left out."""
    ends = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))
    return edges.where("source <> target").select(F.explode(ends).alias("e")).select("e.id", "e.other").distinct()


def walk(near: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(id, distance, cosine) of what is at most `hops` from the seeds (id, score); walked rows have cosine 0."""
    if hops < 1:
        raise ValueError("hops must be 1 or more")
    reached = kept(seeds.groupBy("id").agg(F.lit(0).alias("distance"), F.max("score").cast("double").alias("cosine")), slim=True)
    for hop in range(1, hops + 1):
        last = reached.where(F.col("distance") == hop - 1).select("id")
        met = near.join(last, "id", "left_semi").select(F.col("other").alias("id")).distinct()
        new = met.join(reached, "id", "left_anti").select("id", F.lit(hop).alias("distance"), F.lit(0.0).alias("cosine"))
        reached = kept(reached.union(new), slim=True)
    return reached


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def blend(near: DataFrame, reached: DataFrame, weight: float = 0.2) -> DataFrame:
    """(id, distance, cosine, graph, final).

    Up to one hop away `graph` is the mean score of the seeds next to the row; farther out it is `weight` times
    the mean `graph` of the layer before. `final` puts `weight` on graph and the rest on cosine.
    """
    rows = reached.select("id", "distance", _unit(F.col("cosine")).alias("cosine"))
    farthest = rows.agg(F.max("distance")).first()[0] or 0
    seeds = rows.where("distance = 0").select(F.col("id").alias("other"), F.col("cosine").alias("s"))
    beside = near.join(seeds, "other").groupBy("id").agg(F.avg("s").alias("graph"))
    layer = rows.where("distance <= 1").join(beside, "id", "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))
    out = layer
    for d in range(2, farthest + 1):
        before = layer.where(F.col("distance") == d - 1).select(F.col("id").alias("other"), F.col("graph").alias("s"))
        beside = near.join(before, "other").groupBy("id").agg((F.avg("s") * weight).alias("graph"))
        layer = kept(rows.where(F.col("distance") == d).join(beside, "id"), slim=True)
        out = out.unionByName(layer)
    return out.withColumn("final", (1 - weight) * F.col("cosine") + weight * F.col("graph"))


def related(near: DataFrame, seed: str, hops: int = 1, weight: float = 0.2) -> DataFrame:
    """What surrounds one node, itself left out, best first."""
    seeds = near.sparkSession.createDataFrame([(seed, 1.0)], "id string, score double")
    return blend(near, walk(near, seeds, hops), weight).where(F.col("id") != seed).orderBy(F.desc("final"), "distance", "id")


def edge_view(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, type, other, title): edges out of and into the ids; the title is null where an end dangles."""
    out = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
    into = edges.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"), F.lit("in").alias("direction"), "type", F.col("source").alias("other"))
    return out.union(into).join(nodes.select(F.col("id").alias("other"), "title"), "other", "left").select("id", "direction", "type", "other", "title")


def neighbors(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """edge_view without dangling ends, and a loop once."""
    known = nodes.select(F.col("id").alias("other"))
    seen = edge_view(edges, nodes, ids).where(~((F.col("id") == F.col("other")) & (F.col("direction") == "in")))
    return seen.join(known, "other", "left_semi").select("id", "direction", "type", "other", "title")


def file_of(unit: Column) -> Column:
    return F.split_part(unit, F.lit("#"), F.lit(1))


def deepest(units: Column) -> Column:
    """Those ids of sub-units that hold no other one of the list."""

    def holds(outer: Column, inner: Column) -> Column:
        rest = F.substr(inner, F.length(outer) + 1, F.lit(1))
        return inner.startswith(outer) & (rest != "") & ~rest.rlike("[0-9]")

    return F.filter(units, lambda u: ~F.exists(units, lambda v: holds(u, v)))


def fold(edges: DataFrame) -> DataFrame:
    """Edges out of sub-units as their files' edges: (type, source, target, units), structural ones left out."""
    rows = edges.where("kind <> 'structural'").withColumn("file", file_of(F.col("source")))
    unit = F.when(F.col("source").contains("#"), F.col("source"))
    return rows.groupBy("type", F.col("file").alias("source"), "target").agg(F.array_sort(F.collect_set(unit)).alias("units")).withColumn("units", deepest(F.col("units")))
