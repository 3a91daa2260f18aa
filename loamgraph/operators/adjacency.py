"""Stored adjacency: edges in buckets by either end, so that a step along them shuffles the frontier and no edge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.storage import _path, kept, shared_dir

#: Ids up to which a frontier is written into the filter: then only their buckets are read.
LISTED = 200
#: A node of more edges than this share of all, and LEAST, is a hub. Its edges lie spread over files of their own, as in a
#: bucket they would be one task's. There are 1 / HUB of them at most, so they are broadcast.
HUB, LEAST = 1 / 1000, 10_000
BUCKETS = 64


class Adjacency:
    """Edges (type, source, target) stored twice, bucketed and sorted by source and by target.

    A step joins a frontier with the buckets of its end: Spark moves the frontier to the buckets and reads the edges where
    they lie. A small frontier becomes a filter on the bucketed column instead, which skips the other buckets.
    """

    def __init__(self, spark: SparkSession, at: str, buckets: int = BUCKETS):
        """Opens what build() has written at a folder, in this session or another."""
        self.spark, self.at, self.buckets = spark, at.rstrip("/"), buckets
        self._names = {}
        for end in ("source", "target"):
            name = self._names[end] = f"adjacency_{uuid.uuid4().hex}_{end}"
            spark.sql(f"CREATE TABLE {name} (type STRING, source STRING, target STRING) USING parquet OPTIONS (path '{self.at}/{end}') CLUSTERED BY ({end}) SORTED BY ({end}) INTO {buckets} BUCKETS")

    @classmethod
    def build(cls, edges: DataFrame, at: str | None = None, buckets: int = BUCKETS) -> Adjacency:
        """Stores edges (source, target[, type]), each once; ends that are null lead nowhere and are left out."""
        spark = edges.sparkSession
        if at is None:
            at = f"{shared_dir(spark)}/adjacency-{uuid.uuid4().hex}"
            path, system = _path(spark, at)
            system.deleteOnExit(path)
        kind = F.col("type") if "type" in edges.columns else F.lit(None).cast("string")
        rows = kept(edges.where("source is not null and target is not null").select(kind.alias("type"), "source", "target").distinct())
        n = rows.count()
        for end in ("source", "target"):
            degree = rows.groupBy(end).agg(F.count("*").alias("n"))
            hubs = kept(degree.where(F.col("n") > max(LEAST, int(n * HUB))).select(end), slim=True)
            rows.join(F.broadcast(hubs), end, "left_anti").select("type", "source", "target").repartition(buckets, end).sortWithinPartitions(end).write.bucketBy(buckets, end).sortBy(end).option("path", f"{at}/{end}").saveAsTable(name := f"built_{uuid.uuid4().hex}")
            spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
            rows.join(F.broadcast(hubs), end).select("type", "source", "target").write.parquet(f"{at}/{end}-hubs")
        return cls(spark, at, buckets)

    def step(self, frontier: DataFrame, end: str = "source", kinds: list[str] | None = None) -> DataFrame:
        """(type, source, target): the edges one of whose ends, source or target, is in the frontier (id, distinct)."""
        edges = self.spark.table(self._names[end])
        hubs = self.spark.read.schema("type string, source string, target string").parquet(f"{self.at}/{end}-hubs")
        if kinds is not None:
            edges, hubs = edges.where(F.col("type").isin(kinds)), hubs.where(F.col("type").isin(kinds))
        few = [r[0] for r in frontier.select("id").limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            return edges.where(F.col(end).isin(few)).unionByName(hubs.where(F.col(end).isin(few)))
        ids = frontier.select(F.col("id").alias(end))
        near = edges.hint("merge").join(ids.hint("merge"), end, "left_semi")
        if hubs.isEmpty():
            return near.select("type", "source", "target")
        some = ids.join(F.broadcast(hubs.select(end).distinct()), end, "left_semi")  # 1 / HUB ids at most
        return near.unionByName(hubs.join(F.broadcast(some), end, "left_semi").select(*near.columns)).select("type", "source", "target")

    def reach(self, far: DataFrame, least: int, most: int | None, kinds: list[str] | None = None) -> DataFrame:
        """traverse.reach() over the stored edges: ids from which `least` to `most` steps lead to one of far's ids."""
        frontier = kept(far.select("id").distinct(), slim=True)
        found: DataFrame | None = None
        step = 0
        while most is None or step < most:
            step += 1
            reached = self.step(frontier, "target", kinds).select(F.col("source").alias("id")).distinct()
            if most is None and found is not None:
                reached = reached.join(found, "id", "left_anti")
            frontier = kept(reached, slim=True)
            if frontier.isEmpty():
                break
            if step >= least:
                found = frontier if found is None else found.union(frontier)
        return far.select("id").limit(0) if found is None else found.distinct()

    def neighbors(self, frontier: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        """(id, direction, type, other) of the edges at the frontier's ids, either way."""
        out = self.step(frontier, "source", kinds).select(F.col("source").alias("id"), F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
        return out.union(self.step(frontier, "target", kinds).select(F.col("target").alias("id"), F.lit("in").alias("direction"), "type", F.col("source").alias("other")))

    def walk(self, seeds: DataFrame, hops: int = 1, kinds: list[str] | None = None) -> DataFrame:
        """(id, distance) of what lies at most `hops` steps, either way, from the seeds (id)."""
        reached = kept(seeds.select("id", F.lit(0).alias("distance")).distinct(), slim=True)
        for hop in range(1, hops + 1):
            met = self.neighbors(reached.where(F.col("distance") == hop - 1).select("id"), kinds).select(F.col("other").alias("id")).distinct()
            new = met.join(reached, "id", "left_anti").select("id", F.lit(hop).alias("distance"))
            reached = kept(reached.union(new), slim=True)
        return reached

    def close(self) -> None:
        """Forgets the tables; their files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
