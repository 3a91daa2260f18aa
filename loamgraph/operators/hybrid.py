"""Hybrid retrieval: vectors, words and titles fused, spread over the graph, folded into sections and files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import passages
from loamgraph.functions.scalars import clip, name_of
from loamgraph.functions.text import terms_of
from loamgraph.operators import expand, rank
from loamgraph.operators.intervals import points_in
from loamgraph.operators.storage import kept
from loamgraph.sources.manifest import Expansion

@dataclass(frozen=True)
class Settings:
    """What a call may set; expansion's pool is take times its multiplier."""

    lexical_weight: float = 0.0
    title_weight: float = 0.3
    type_weights: dict[str, float] = field(default_factory=dict)
    path_weights: dict[str, float] = field(default_factory=dict)
    expansion: Expansion = Expansion()
    least: float | None = None
    take: int = 5
    skip: int = 0
    most_units: int = 2


@dataclass(frozen=True)
class Candidates:
    """What may be found: of the files (id) the leaves (id, chunk, ordinal, parent, body, vector, model) whose vectors are of the
    model, and of a file without such a leaf its own chunks (id, chunk, body, vector, model). A sub-unit among the
    files stands for its file. Where vectors (vec, vector) are given, leaves and chunks have `vec` in place of `vector`, and
    one without such a vector is left out."""

    files: DataFrame
    leaves: DataFrame
    file_chunks: DataFrame
    model: str
    vectors: DataFrame | None = None

    def measured(self, query: str, vector: list[float], lexical: bool) -> DataFrame:
        """(node, chunk, file, ordinal, parent, cosine, lexical). Bodies and vectors are measured where they lie, and only
        what that gives is stored and goes through joins. Vectors of another length than the query's are left out."""
        terms = terms_of(query) if lexical else []
        q = F.array(*[F.lit(float(v)) for v in vector])

        def near(rows: DataFrame) -> DataFrame:
            fits = F.size("vector") == len(vector)
            return rows.withColumns({"fits": fits, "cosine": F.when(fits, rank.cosine(F.col("vector"), q))}).drop("vector")

        vectors = None if self.vectors is None else near(self.vectors.select("vec", "vector"))

        def slim(rows: DataFrame) -> DataFrame:
            rows = rows.where(F.col("model") == self.model).drop("model")
            rows = near(rows) if vectors is None else rows
            # Stored before any join, which the optimizer would otherwise make with the bodies.
            rows = kept(rank.counted(rows, "body", terms) if terms else rows.drop("body"))
            return rows if vectors is None else rows.join(vectors, "vec").drop("vec")

        counts = ["n", *(f"f{i}" for i in range(len(terms)))] if terms else []
        ids = self.files.select(expand.file_of(F.col("id")).alias("file")).distinct()
        live = slim(self.leaves).withColumn("file", expand.file_of(F.col("id"))).join(ids, "file", "left_semi")
        bare = ids.join(live.select("file").distinct(), "file", "left_anti")
        own = slim(self.file_chunks).withColumnRenamed("id", "file").join(bare, "file", "left_semi")
        own = own.withColumns({"id": F.col("file"), "ordinal": F.lit(None).cast("int"), "parent": F.lit(None).cast("string")})
        cols = [F.col("id").alias("node"), "chunk", "file", "ordinal", "parent", "cosine", *counts]
        rows = kept(live.where("fits").select(*cols).union(own.where("fits").select(*cols)))
        return rank.bm25_of(rows, terms) if terms else rows.withColumn("lexical", F.lit(0.0))

    def bodies(self, few: DataFrame) -> DataFrame:
        """(node, body) of a few chunks (node, chunk), as many as a request shows."""
        both = self.leaves.select(F.col("id").alias("node"), "chunk", "body", "model").union(self.file_chunks.select("id", "chunk", "body", "model"))
        return both.where(F.col("model") == self.model).join(F.broadcast(few), ["node", "chunk"]).select("node", "body")


def candidates(files: DataFrame, leaves: DataFrame, file_chunks: DataFrame, model: str, vectors: DataFrame | None = None) -> Candidates:
    return Candidates(files, leaves, file_chunks, model, vectors)


def ranked(chunks: Candidates, files: DataFrame, query: str, vector: list[float], settings: Settings) -> DataFrame:
    """(node, chunk, file, ordinal, parent, cosine, lexical, title, score): the best chunk of each node, the first of
    equal ones. files has id, path and title."""
    rows = chunks.measured(query, vector, bool(settings.lexical_weight))
    if settings.title_weight:
        name = F.coalesce(F.when(F.col("title") != "", F.col("title")), name_of(F.col("path")))
        rows = rows.join(files.select(F.col("id").alias("file"), rank.covered(name, query).alias("title")), "file", "left").withColumn("title", F.coalesce("title", F.lit(0.0)))
    else:
        rows = rows.withColumn("title", F.lit(0.0))
    score = rank.fused(F.col("cosine"), F.col("lexical"), F.col("title"), settings.lexical_weight, settings.title_weight)
    best = F.max(F.struct(score.alias("score"), (-F.col("chunk")).alias("first"), "chunk", "file", "ordinal", "parent", "cosine", "lexical", "title")).alias("b")
    return rows.groupBy("node").agg(best).select("node", "b.chunk", "b.file", "b.ordinal", "b.parent", "b.cosine", "b.lexical", "b.title", "b.score")


def spread(rows: DataFrame, near: DataFrame, known: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """ranked() rows with their scores blended along file edges near (id, other), and the files walked to: (id, distance,
    graph, final). The walk starts at the best files; rows of files it doesn't reach go, and those of files that
    it reached by edges only count by the graph."""
    x = settings.expansion
    by_file = rows.groupBy("file").agg(F.max(clip(F.col("score"))).alias("score")).withColumnRenamed("file", "id")
    seeds = by_file.orderBy(F.desc("score"), "id").limit(settings.take * x.multiplier)
    fold = near.select(expand.file_of(F.col("id")).alias("id"), expand.file_of(F.col("other")).alias("other")).where("id <> other").distinct()
    reached = expand.walk(fold, seeds, x.hops)
    blended = kept(expand.blend(fold, reached, x.weight).join(known.select("id"), "id", "left_semi").select("id", "distance", "graph", "final"))
    kept_rows = rows.join(blended.withColumnRenamed("id", "file"), "file")
    own = F.when(F.col("distance") > 0, F.lit(0.0)).otherwise(clip(F.col("score")))
    return kept_rows.withColumn("score", (1 - x.weight) * own + x.weight * F.col("graph")).drop("final"), blended


def search(files: DataFrame, chunks: Candidates, query: str, vector: list[float], settings: Settings, near: DataFrame | None = None, known: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Ranked files: id, type, path, title, score, units, units_total, and of the best unit cosine, lexical, graph,
    distance, weight; best first, ties by id, skip and take applied.

    files (id, type, path, title) are what the filter left, chunks their candidates(), known all files (files if none are
    given), sections the ids of sections. units are the most_units best (id, ordinal, score, snippet): a leaf counts as the
    section right above it, whose best leaf stands for it, the earlier one on a tie.
    """
    known = files if known is None else known
    rows = ranked(chunks, known, query, vector, settings)
    walked = None
    if settings.expansion.enabled and near is not None:
        rows, walked = spread(rows, near, known, settings)
    else:
        rows = rows.withColumn("distance", F.lit(0)).withColumn("graph", F.lit(0.0))
    meta = known.select("id", "type", "path", "title")
    weighed = meta.select(F.col("id").alias("file"), rank.weight(settings.type_weights, settings.path_weights).alias("weight"))
    rows = rows.join(weighed, "file", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("score", F.col("score") * F.col("weight"))
    if settings.least is not None:
        rows = rows.where(F.col("score") >= settings.least)
    if sections is not None:
        rows = rows.join(sections.select(F.col("id").alias("parent"), F.lit(True).alias("_section")), "parent", "left")
    else:
        rows = rows.withColumn("_section", F.lit(None).cast("boolean"))
    rows = rows.withColumn("unit", F.when(F.col("_section"), F.col("parent")).otherwise(F.col("node")))
    trace = ["cosine", "lexical", "title", "graph", "distance", "weight"]
    best = F.max(F.struct("score", (-F.coalesce("ordinal", F.lit(0))).alias("early"), "node", "chunk", *trace)).alias("b")
    units = kept(rows.groupBy("file", "unit").agg(best).select("file", F.col("unit").alias("id"), "b.score", (-F.col("b.early")).alias("ordinal"), F.col("b.node").alias("leaf"), "b.chunk", *(f"b.{t}" for t in trace)), slim=True)
    # Of a file's units only the few that are shown come together; the others are counted.
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "ordinal", "id"))
    few = units.withColumn("place", place).where(F.col("place") <= max(1, settings.most_units))
    top = few.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "ordinal", "id", "leaf", "chunk", "score", *trace))).alias("all"))
    hits = top.join(units.groupBy("file").agg(F.count("*").cast("int").alias("units_total")), "file")
    hits = hits.select(F.col("file").alias("id"), F.col("all")[0]["score"].alias("score"), F.slice("all", 1, settings.most_units).alias("top"), "units_total", *(F.col("all")[0][t].alias(f"best_{t}") for t in trace))
    if walked is not None:
        bare = walked.where("distance > 0").join(hits.select("id"), "id", "left_anti").join(weighed.withColumnRenamed("file", "id"), "id")
        bare = bare.withColumn("score", F.col("final") * F.col("weight"))
        if settings.least is not None:
            bare = bare.where(F.col("score") >= settings.least)
        none = F.lit(None).cast("double")
        hits = hits.union(bare.select("id", "score", F.lit(None).cast(hits.schema["top"].dataType), F.lit(0), none, none, none, "graph", "distance", "weight"))
    window = kept(rank.window(hits, settings.take, settings.skip), slim=True)
    # Bodies are read, and snippets made, for the rows of the window only: most_units of each at most.
    shown = window.join(meta.join(F.broadcast(window.select("id")), "id", "left_semi"), "id", "left").withColumn("top", F.coalesce("top", F.array().cast(hits.schema["top"].dataType)))
    asked = window.select(F.explode("top").alias("u")).select(F.col("u.leaf").alias("node"), "u.chunk")
    found = window.select("id", F.explode("top").alias("u")).select("id", F.col("u.place").alias("place"), F.col("u.leaf").alias("node")).join(chunks.bodies(asked), "node")
    bodies = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("bodies"))
    texts = shown.join(bodies, "id", "left").withColumn("snippets", passages.all_snippets(F.coalesce(F.col("bodies.body"), F.array().cast("array<string>")), query))
    unit = lambda u, i: F.struct(u["id"].alias("id"), u["ordinal"].alias("ordinal"), u["leaf"].alias("leaf"), u["score"].alias("score"), F.get("snippets", i).alias("snippet"))
    return texts.select(
        "id", "type", "path", "title", "score", F.transform("top", unit).alias("units"), "units_total",
        *(F.col(f"best_{t}").alias(t if t != "title" else "coverage") for t in trace),
    ).orderBy(F.desc("score"), "id")


def filtered_below(rows: DataFrame, least: float) -> DataFrame:
    """(n): how many ranked rows a least score leaves out."""
    return rows.agg(F.count_if(F.col("score") < least).alias("n"))


def with_passages(found: DataFrame, bodies: DataFrame, leaves: DataFrame, limit: int = passages.PASSAGE) -> DataFrame:
    """search() rows with `text` and its lines `first` and `last`: of each file's best unit, the leaf that scored and whole
    leaves around it that fit. bodies has id and body, leaves id, ordinal, start_line and end_line."""
    spans = leaves.withColumn("file", expand.file_of(F.col("id"))).join(found.select(F.col("id").alias("file")), "file", "left_semi")
    spans = spans.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ordinal", "start_line", "end_line", F.col("id").alias("leaf")))).alias("spans"))
    rows = found.join(bodies.select("id", "body"), "id", "left").join(spans.withColumnRenamed("file", "id"), "id", "left")
    at = F.array_position(F.transform("spans", lambda s: s["leaf"]), F.get(F.col("units"), F.lit(0))["leaf"]) - 1
    got = passages.passage_of(F.col("body"), F.transform("spans", lambda s: F.array(s["start_line"], s["end_line"])), at.cast("int"), limit)
    return rows.withColumn("_p", got).drop("body", "spans").withColumns({"text": F.col("_p.text"), "first": F.col("_p.first"), "last": F.col("_p.last")}).drop("_p")


def innermost(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line, section): the smallest section (file, id, start_line, end_line) around each line (file, line); null in none.

    A line meets only the sections that can be around it; see intervals.points_in().
    """
    inside = points_in(lines.select("file", "line").distinct(), sections, "line", "start_line", "end_line", ["file"])
    span: Column = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("late"), "id")
    found = inside.groupBy("file", "line").agg(F.min(span).alias("s")).select("file", "line", F.col("s.id").alias("section"))
    return lines.select("file", "line").distinct().join(found, ["file", "line"], "left")


def outline(units: DataFrame) -> DataFrame:
    """(file, units): all sub-units (id, kind, title, ordinal) of each file, in order."""
    rows = units.withColumn("file", expand.file_of(F.col("id")))
    return rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "kind", "title"))).alias("units"))
