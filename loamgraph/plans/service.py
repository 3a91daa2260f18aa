"""One entry for all queries: structural, counting and hybrid requests, what rows show, aliases, digests, and text output."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import aggregate, expand, hybrid, views
from loamgraph.plans.filter import FilterError, near_name, parse, query
from loamgraph.sources.graph import CORE, Graph

INCLUDES = ("body", "edges", "properties", "units", "paths")
FIELDS = ("id", "type", "path", "title", "parent_id", "score", "snippet", "body", "properties", "edges", "paths", "matched_units")


@dataclass(frozen=True)
class Request:
    """What is asked for. semantic is a text, vector its embedding; count ignores order and window."""

    filter: str = ""
    sort: str | None = None
    take: int | None = None
    skip: int | None = None
    files_only: bool = False
    semantic: str | None = None
    vector: list[float] | None = None
    count: bool = False
    group_by: str | None = None
    include: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    least: float | None = None
    settings: hybrid.Settings = field(default_factory=hybrid.Settings)


@dataclass(frozen=True)
class Corpus:
    """What hybrid requests search: leaves and file_chunks as hybrid.candidates() takes them, the live model, edges, sections."""

    leaves: DataFrame
    file_chunks: DataFrame
    model: str
    edges: DataFrame | None = None
    sections: DataFrame | None = None


def run(graph: Graph, request: Request, corpus: Corpus | None = None) -> DataFrame:
    """The request's rows. Errors come in the order parse, include and fields, window, filter."""
    parse(request.filter)
    for name in request.include:
        if name not in INCLUDES:
            raise FilterError(f"nothing to include called {name!r}{near_name(name, list(INCLUDES))}")
    for name in request.fields:
        if name.split(".")[0] not in FIELDS:
            raise FilterError(f"no field {name!r}{near_name(name, list(FIELDS))}")
    if request.skip is not None and request.take is None:
        raise FilterError("skip needs take")
    if request.count or request.group_by:
        return counted(graph, request)
    if request.semantic is not None:
        return ranked(graph, request, corpus)
    rows = query(graph, request.filter, request.sort, request.take, request.skip, request.files_only)
    return shown(graph, rows, request)


def counted(graph: Graph, request: Request) -> DataFrame:
    """One number, or groups in their order; with a text to rank by there is nothing to count."""
    if request.semantic is not None:
        raise FilterError("a count takes no semantic text")
    rows = query(graph, request.filter, files_only=request.files_only)
    if not request.group_by:
        return rows.agg(F.count("*").alias("n"))
    if request.group_by in rows.columns:
        return aggregate.count_by(rows, request.group_by)
    if request.group_by in ("id", "path", "title"):
        raise FilterError(f"{request.group_by} is no property to group by")
    return aggregate.count_by_json(rows, request.group_by)


def ranked(graph: Graph, request: Request, corpus: Corpus | None) -> DataFrame:
    if corpus is None or request.vector is None:
        raise FilterError("no embeddings to search")
    files = query(graph, request.filter, files_only=request.files_only).select(*CORE)
    m = graph.manifest
    settings = replace(request.settings, take=request.take or request.settings.take, skip=request.skip or 0, least=request.least, type_weights=m.type_weights, path_weights=m.path_weights)
    chunks = hybrid.candidates(files, corpus.leaves, corpus.file_chunks, corpus.model)
    near = expand.both_ways(corpus.edges) if corpus.edges is not None else None
    return hybrid.search(files, chunks, request.semantic, request.vector, settings, near, views.files(graph.nodes()).select(*CORE), corpus.sections)


def shown(graph: Graph, rows: DataFrame, request: Request) -> DataFrame:
    """Rows with what is included, and of it the fields asked for. Properties are a map from name to text, without those that
    are missing."""
    named = [c for c in rows.columns if c not in (*CORE, "parent_id", "json", "modified", "body", "source_id")]
    include = {*request.include, *(f.split(".")[0] for f in request.fields)}
    out = rows.select(*[c for c in (*CORE, "parent_id", "body", "json") if c in rows.columns], *named)
    if "edges" in include:
        kinds = list(graph.manifest.edges)
        edges = expand.typed_edges(graph, kinds).withColumn("position", F.lit(None).cast("int"))
        out = out.join(views.ordered(edges.join(rows.select(F.col("id").alias("source")), "source", "left_semi")), "id", "left")
    if "paths" in include:
        refs = graph.path_refs().join(rows.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("paths"))
        out = out.join(refs, "id", "left")
    if "properties" in include:
        out = out.withColumn("properties", as_map([c for c in named]))
    if request.fields:
        return out.select(*[field_of(f) for f in request.fields if f in out.columns or "." in f or f in ("properties",)])
    keep = [*CORE, *(x for x in ("body", "edges", "paths", "properties") if x in include and x in out.columns)]
    return out.select(*keep)


def as_map(names: list[str]) -> Column:
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def field_of(name: str) -> Column:
    """A field, or one property as properties.name."""
    base, dot, rest = name.partition(".")
    return F.col("properties")[rest].alias(name.replace(".", "_")) if dot else F.col(base)


def alias(graph: Graph, name: str, corpus: Corpus | None = None, **over) -> DataFrame:
    """The query that the manifest calls so, with what the call sets instead."""
    known = graph.manifest.aliases
    if name not in known:
        raise FilterError(f"no alias {name!r}{near_name(name, list(known))}")
    given = {k: v for k, v in known[name].items() if k in ("filter", "sort", "take", "skip", "semantic")}
    return run(graph, Request(**{**given, **over}, count=known[name].get("verb") == "count"), corpus)


def digest(graph: Graph, recent: int = 10) -> dict[str, DataFrame]:
    """What a reader should see first: the pinned nodes, the files changed last, and the aliases the manifest includes."""
    c = graph.manifest.context
    pinned = graph.spark.createDataFrame([(x,) for x in c.get("pinned", [])], "id string")
    kinds = [k for k, t in graph.manifest.types.items() if t.modified]
    out = {"pinned": graph.nodes().join(F.broadcast(pinned), "id", "left_semi").select(*CORE)}
    out["recent"] = graph.nodes(kinds).orderBy(F.desc("modified"), "id").limit(c.get("recent", recent)).select(*CORE, "modified")
    return out | {name: alias(graph, name) for name in c.get("include", [])}


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row without its nulls and empty lists, scores to three decimals."""
    cols = [F.round(c, 3).alias(c) if kind == "double" else F.when(F.size(c) > 0, F.col(c)).alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    return rows.select(F.to_json(F.struct(*cols)).alias("json"))


def as_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as text between tabs, scores to three decimals, lists joined by commas, tabs and breaks as spaces."""

    def cell(c: str, kind: str) -> Column:
        v = F.format_number(c, "0.000") if kind == "double" else F.array_join(F.col(c).cast("array<string>"), ",") if kind.startswith("array<string") else F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        return F.regexp_replace(F.coalesce(v, F.lit("")), r"[\t\r\n]+", " ")

    return rows.select(F.concat_ws("\t", *[cell(c, k) for c, k in rows.dtypes]).alias("line"))


def get(graph: Graph, id_: str, include: tuple[str, ...] = ("properties", "edges", "body")) -> DataFrame:
    """One node by its id with what is included."""
    return shown(graph, query(graph, f'id="{id_}"'), Request(include=include))


def matches(graph: Graph, request: Request, corpus: Corpus | None = None) -> DataFrame:
    """(id, score) of a request's rows, for marking them in a drawing; a structural match scores 1."""
    rows = run(graph, replace(request, fields=(), include=()), corpus)
    return rows.select("id", F.col("score") if "score" in rows.columns else F.lit(1.0).alias("score"))
