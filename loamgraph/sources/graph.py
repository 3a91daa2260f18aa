"""Tables, or nodes and edges given as they are, as a typed property graph: nodes (id, type, path, title, properties) and edges."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.storage import dealt
from loamgraph.sources.manifest import TABLES, Manifest

CORE = ("id", "type", "path", "title")


def node_id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind + "/"), (F.expr(key) if isinstance(key, str) else key).cast("string"))


class Graph:
    """Reads nodes and edges as they are asked for; a type's columns are read only where a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str, now: datetime | None = None, manifest: Manifest = TABLES):
        self.spark, self.sf_dir, self.now, self.manifest = spark, sf_dir, now or datetime.now(UTC), manifest

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def nodes(self, kinds: list[str] | None = None) -> DataFrame:
        """All properties any of the kinds has, as columns; null where a type has none of that name. `json` holds undeclared
        ones, `modified` the time of the last change, `body` the text, of types that have them."""
        types = self.manifest.types
        kinds = list(types) if kinds is None else kinds
        if not kinds:
            return self.nodes([next(iter(types))]).where(F.lit(False))
        out = None
        for kind in kinds:
            t = types[kind]
            id_ = node_id(kind, t.key)
            cols = [id_.alias("id"), F.lit(kind).alias("type"), F.concat(id_, F.lit(".md")).alias("path"), F.expr(t.title).cast("string").alias("title")]
            cols += [F.expr(p.expr or name).alias(name) for name, p in t.properties.items()]
            cols += [F.expr(e).alias(name) for name, e in (("json", t.json), ("modified", t.modified), ("body", t.body)) if e]
            part = self.table(t.table).select(*cols)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def edges(self, kind: str) -> DataFrame:
        """source, target of one edge type, each pair once, or of a hierarchy, child to parent."""
        h = self.manifest.hierarchies.get(kind)
        if h and kind not in self.manifest.edges:
            up = reduce(DataFrame.union, map(self.edges, h.edges))
            return up.select(F.col("target").alias("source"), F.col("source").alias("target")) if h.parent_is_source else up
        e = self.manifest.edges[kind]
        rows = self.table(e.table)
        if e.totals:  # one row
            rows = rows.crossJoin(F.broadcast(rows.select(F.expr(e.totals))))
        pairs = rows.select(F.expr(e.source_key).alias("s"), F.expr(e.target_key).alias("t")).where("s is not null and t is not null")
        if e.distinct:
            pairs = dealt(pairs, self.size(kind), "s", "t").distinct()
        return pairs.select(node_id(e.source, F.col("s")).alias("source"), node_id(e.target, F.col("t")).alias("target"))

    def size(self, kind: str) -> int:
        """Rows of an edge type's table, as its files' footers have it."""
        return self.table(self.manifest.edges[kind].table).count()

    def ends(self, kind: str) -> tuple[list[str], list[str]] | None:
        """The node types an edge type, or a hierarchy, leads from and to."""
        h, edges = self.manifest.hierarchies.get(kind), self.manifest.edges
        names = [kind] if kind in edges else list(h.edges) if h else []
        both = [edges[n].source for n in names], [edges[n].target for n in names]
        return both[::-1] if h and h.parent_is_source and kind not in edges else both

    def path_refs(self) -> DataFrame:
        """(id, type, target): the paths that nodes' texts name, cleaned of slashes at their ends."""
        parts = []
        for kind, t in self.manifest.types.items():
            if t.mentions:
                rows = self.table(t.table).select(node_id(kind, t.key).alias("id"), F.lit("mentions").alias("type"), F.explode(F.expr(t.mentions)).alias("target"))
                parts.append(rows.withColumn("target", F.trim(F.col("target"), F.lit("/"))).where("target <> ''").distinct())
        empty = self.spark.createDataFrame([], "id string, type string, target string")
        return reduce(DataFrame.union, parts) if parts else empty


class Frames(Graph):
    """A graph of given frames: nodes (id, type, path, title, and parent_id, source, json, modified, body or properties
    where there are any), edges (type, source, target), and path_refs (id, type, target)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, path_refs: DataFrame | None = None, now: datetime | None = None, manifest: Manifest | None = None):
        super().__init__(nodes.sparkSession, "", now, manifest or Manifest({}, {}))
        self._nodes, self._edges, self._refs = nodes, edges, path_refs

    def nodes(self, kinds: list[str] | None = None) -> DataFrame:
        return self._nodes if kinds is None else self._nodes.where(F.col("type").isin(kinds))

    def edges(self, kind: str) -> DataFrame:
        h = self.manifest.hierarchies.get(kind)
        names = list(h.edges) if h and kind not in self.manifest.edges else [kind]
        up = self._edges.where(F.col("type").isin(names)).select("source", "target").distinct()
        swap = h is not None and h.parent_is_source and kind not in self.manifest.edges
        return up.select(F.col("target").alias("source"), F.col("source").alias("target")) if swap else up

    def ends(self, kind: str) -> None:
        return None

    def path_refs(self) -> DataFrame:
        return self._refs if self._refs is not None else super().path_refs()
