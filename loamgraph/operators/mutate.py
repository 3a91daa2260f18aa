"""Changes of the graph as functions from frames to frames: nodes (id, type, path, title ...), edges (type, source, target,
kind, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators import expand
from loamgraph.operators.analytics import closes_cycle
from loamgraph.operators.storage import dealt
from loamgraph.sources.manifest import Manifest
from loamgraph.streaming import changes


class Refused(ValueError):
    """A change that the manifest doesn't allow."""


def deduplicated(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges without twins: of equal type, source and target that with the first place stays. rows: how many there are, about."""
    place = F.row_number().over(Window.partitionBy("type", "source", "target").orderBy(F.col("position").asc_nulls_last(), "kind"))
    return dealt(edges, rows, "source", "target").withColumn("_p", place).where("_p = 1").drop("_p")


def _moved(c: Column, old: Column, new: Column) -> Column:
    """An id after its file's move; a sub-unit keeps what follows its file."""
    return F.when(new.isNotNull(), F.concat(new, F.substr(c, F.length(old) + 1))).otherwise(c)


def retarget(edges: DataFrame, moves: DataFrame, ends: tuple[str, ...] = ("target",), size: int | None = None) -> DataFrame:
    """Edges with the ids of moves (old, new) replaced at these ends, sub-units of them included, and without the twins
    that this makes. size: how many edges there are, about."""
    rows = edges
    for end in ends:
        m = moves.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        rows = rows.join(m, expand.file_of(F.col(end)) == F.col("_old"), "left").withColumn(end, _moved(F.col(end), F.col("_old"), F.col("_new"))).drop("_old", "_new")
    return deduplicated(rows.select(*edges.columns), size)


def move(nodes: DataFrame, edges: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after files moved (old, new, path): their ids, their sub-units' ids and parents, and both ends of
    edges. A move to an id that is there, and stays, is refused."""
    stays = nodes.join(moves.select(F.col("old").alias("id")), "id", "left_anti").select("id")
    if not stays.join(moves.select(F.col("new").alias("id")), "id", "left_semi").isEmpty():
        raise Refused("a node of the new id exists")
    m = moves.select(F.col("old").alias("_old"), F.col("new").alias("_new"), F.col("path").alias("_path"))
    rows = nodes.join(m, expand.file_of(F.col("id")) == F.col("_old"), "left")
    rows = rows.withColumn("id", _moved(F.col("id"), F.col("_old"), F.col("_new"))).withColumn("path", F.coalesce("_path", "path"))
    if "parent_id" in nodes.columns:
        rows = rows.withColumn("parent_id", F.when(F.col("parent_id").isNotNull(), _moved(F.col("parent_id"), F.col("_old"), F.col("_new"))))
    return rows.select(*nodes.columns), retarget(edges, moves, ("source", "target"))


def referrers(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(id): files with derived edges to what goes; their references are to be looked up again."""
    lost = gone.select(F.col("id").alias("_file"))
    hit = edges.where("kind = 'derived'").join(lost, expand.file_of(F.col("target")) == F.col("_file"), "left_semi")
    return hit.select(expand.file_of(F.col("source")).alias("id")).distinct().join(gone.select("id"), "id", "left_anti")


def delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges without the files gone, and the files whose references must be looked up again."""
    return *changes.cascade(nodes, edges, gone), referrers(edges, gone)


def check_edge(nodes: DataFrame, edges: DataFrame, kind: str, source: str, target: str, manifest: Manifest) -> None:
    """Refuses an edge of an undeclared type, between nodes that aren't there or of other types, a second one where one is
    allowed, and one that closes a cycle of a type without cycles."""
    e = manifest.edges.get(kind)
    if e is None:
        raise Refused(f"no edge type {kind!r}")
    ends = {r.id: r.type for r in nodes.where(F.col("id").isin(source, target)).select("id", "type").collect()}
    for id_, want in ((source, e.source), (target, e.target)):
        if ends.get(id_) != want:
            raise Refused(f"{id_} is no {want}" if id_ in ends else f"no node {id_}")
    own = edges.where(F.col("type") == kind).select("source", "target")
    if e.single and not own.where((F.col("source") == source) & (F.col("target") != target)).isEmpty():
        raise Refused(f"{source} has a {kind} already")
    if e.acyclic == "error" and closes_cycle(own, target, source):
        raise Refused(f"{source} to {target} closes a cycle of {kind}")


def add_edge(nodes: DataFrame, edges: DataFrame, kind: str, source: str, target: str, manifest: Manifest) -> DataFrame:
    """Edges with one more, after those of its type and source; as they are if it is there."""
    check_edge(nodes, edges, kind, source, target, manifest)
    same = (F.col("type") == kind) & (F.col("source") == source)
    if not edges.where(same & (F.col("target") == target)).isEmpty():
        return edges
    last = edges.where(same).agg(F.max("position")).first()[0] or 0
    one = edges.sparkSession.createDataFrame([(kind, source, target, "direct", last + 1)], "type string, source string, target string, kind string, position int")
    return edges.select("type", "source", "target", "kind", "position").unionByName(one)


def remove_edge(edges: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    return edges.where(~((F.col("type") == kind) & (F.col("source") == source) & (F.col("target") == target)))


def written(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, create: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with some nodes, and all edges from them, replaced, or added; one that is to be created must be new."""
    if create and not nodes.join(new_nodes.select("id"), "id", "left_semi").isEmpty():
        raise Refused("a node of the id exists")
    out = changes.upsert(nodes, new_nodes, "id")
    rest = edges.join(new_nodes.select(F.col("id").alias("source")), "source", "left_anti").select(*edges.columns)
    return out, deduplicated(rest.unionByName(new_edges.select(*edges.columns)))


def front_edges(nodes: DataFrame, properties: str, manifest: Manifest) -> tuple[DataFrame, DataFrame]:
    """Nodes whose map of properties (name to array of values) has lost the keys that are edge types, and the edges these
    are: (type, source, target, kind, position), in the order written."""
    named = F.map_filter(properties, lambda k, _: k.isin(list(manifest.edges)))
    left = nodes.withColumn(properties, F.map_filter(properties, lambda k, _: ~k.isin(list(manifest.edges))))
    rows = nodes.select(F.col("id").alias("source"), F.explode(named).alias("type", "targets")).select("source", "type", F.posexplode("targets").alias("position", "target"))
    return left, rows.select("type", "source", "target", F.lit("direct").alias("kind"), (F.col("position") + 1).alias("position"))


def link_edges(links: DataFrame, types: list[str], kind: str = "direct") -> DataFrame:
    """Edges for the resolved links (source, target, position) of bodies or sub-units: one of each type that links make."""
    some = links.where("target is not null").select("source", "target", "position", F.explode(F.array(*[F.lit(t) for t in types])).alias("type"))
    return deduplicated(some.select("type", "source", "target", F.lit(kind).alias("kind"), "position"))


def contains(nodes: DataFrame) -> DataFrame:
    """The edges from each file or section to the sub-units right in it."""
    units = nodes.where("parent_id is not null")
    return units.select(F.lit("contains").alias("type"), F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("structural").alias("kind"), F.col("ordinal").alias("position"))


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(type, source, target, change): edges added and removed."""
    a, b = (x.select("type", "source", "target").distinct() for x in (before, after))
    return b.exceptAll(a).withColumn("change", F.lit("added")).union(a.exceptAll(b).withColumn("change", F.lit("removed")))


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (source, value, type) with `target` and `state`: a value is a link's name in [[ ]], or else an id, or else the
    only title of a node of the type. State is ok, dangling, ambiguous or type-mismatch (an id of another type)."""
    bare = F.regexp_extract("value", r"^\[\[([^\]|]+)(?:\|[^\]]*)?\]\]$", 1)
    rows = refs.withColumn("_key", F.when(bare != "", F.trim(bare)).otherwise(F.trim("value"))).withColumn("_name", F.when(bare != "", F.lower("_key")))
    by_name = nodes.groupBy(F.lower(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("_name")).agg(F.count("*").alias("names"), F.min("id").alias("by_name"))
    by_id = nodes.select(F.col("id").alias("_key"), F.col("id").alias("by_id"), F.col("type").alias("id_type"))
    by_title = nodes.groupBy(F.col("title").alias("_key"), F.col("type")).agg(F.count("*").alias("titles"), F.min("id").alias("by_title"))
    got = rows.join(by_name, "_name", "left").join(by_id, "_key", "left").join(by_title, ["_key", "type"], "left")
    target = F.when(F.col("names") == 1, F.col("by_name")).when(F.col("by_id").isNotNull(), F.col("by_id")).when(F.col("titles") == 1, F.col("by_title"))
    kinds = nodes.select(F.col("id").alias("target"), F.col("type").alias("_found"))
    got = got.withColumn("target", target).join(kinds, "target", "left")
    state = F.when(F.col("target").isNull(), F.when((F.col("names") > 1) | (F.col("titles") > 1), "ambiguous").otherwise("dangling"))
    return got.select("source", "value", "type", "target", F.coalesce(state, F.when(F.col("_found") != F.col("type"), "type-mismatch").otherwise("ok")).alias("state"))
