"""Integrity checks: each gives rows (severity, kind, node_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import analytics
from loamgraph.operators.storage import dealt
from loamgraph.plans.filter import matching
from loamgraph.sources.graph import Graph

# Which kinds are errors; the others are warnings.
ERRORS = ("dangling-edge", "edge-type-violation", "edge-cardinality-violation", "edge-cycle", "type-mismatch", "required-missing", "enum-violation")


def issue(rows: DataFrame, kind: str, node: Column, message: Column, severity: str | None = None) -> DataFrame:
    return rows.select(F.lit(severity or level(kind)).alias("severity"), F.lit(kind).alias("kind"), node.alias("node_id"), message.alias("message"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (type, source, target) to what is no node."""
    lost = edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti")
    return issue(lost, "dangling-edge", F.col("source"), F.concat_ws(" ", "type", F.lit("to"), "target"))


def wrong_ends(edges: DataFrame, nodes: DataFrame, allowed: dict[str, tuple[str, str]]) -> DataFrame:
    """Edges whose ends aren't of the types declared for them; undeclared edge types pass."""
    kinds = nodes.select("id", F.col("type").alias("kind"))
    rows = edges.where(F.col("type").isin(list(allowed)))
    rows = rows.join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("s")), "source").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("t")), "target")
    fits = reduce(lambda a, b: a | b, [(F.col("type") == k) & (F.col("s") == s) & (F.col("t") == t) for k, (s, t) in allowed.items()])
    return issue(rows.where(~fits), "edge-type-violation", F.col("source"), F.concat_ws(" ", "type", F.lit("to"), "target"))


def too_many(edges: DataFrame, single: list[str], rows: int | None = None) -> DataFrame:
    """Sources with more than one target of an edge type that allows one. rows: how many edges there are, about."""
    each = dealt(edges.where(F.col("type").isin(single)).select("type", "source", "target"), rows, "source", "target").distinct()
    many = each.groupBy("type", "source").agg(F.count("target").alias("n")).where("n > 1")
    return issue(many, "edge-cardinality-violation", F.col("source"), F.concat("type", F.lit(" has "), F.col("n").cast("string"), F.lit(" targets")))


def cyclic(edges: DataFrame, kind: str, severity: str = "error") -> DataFrame:
    """One row for each group of nodes on a cycle of an edge type."""
    groups = analytics.cycles(edges.where(F.col("type") == kind)).groupBy("cycle").agg(F.count("*").alias("n"))
    return issue(groups, "edge-cycle", F.col("cycle"), F.concat(F.lit(f"{kind}: "), F.col("n").cast("string"), F.lit(" nodes")), severity)


def properties(graph: Graph, kind: str, required: list[str] = ()) -> DataFrame:
    """Required properties without a value, and values an enum doesn't list, of one node type."""
    declared = graph.manifest.types[kind].properties
    nodes = graph.nodes([kind])
    required = [*required, *(p for p, d in declared.items() if d.required and p not in required)]
    found = [F.when(F.col(p).isNull(), F.struct(F.lit("required-missing").alias("kind"), F.lit(p).alias("name"))) for p in required]
    found += [F.when(~F.col(p).isin(list(d.values)), F.struct(F.lit("enum-violation").alias("kind"), F.lit(p).alias("name"))) for p, d in declared.items() if d.kind == "enum"]
    if not found:
        return issue(nodes.limit(0), "required-missing", F.col("id"), F.lit(""))
    rows = nodes.select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select(F.lit("error").alias("severity"), F.col("f.kind").alias("kind"), F.col("id").alias("node_id"), F.col("f.name").alias("message"))


def undeclared_types(nodes: DataFrame, declared: list[str]) -> DataFrame:
    """One row a type that isn't declared."""
    rows = nodes.where(~F.col("type").isin(declared)).groupBy("type").agg(F.count("*").alias("n"))
    return issue(rows, "undeclared-type", F.col("type"), F.concat(F.col("n").cast("string"), F.lit(" nodes")))


def rule(graph: Graph, name: str, text: str, severity: str = "warning", exempt: DataFrame | None = None) -> DataFrame:
    """A filter that nothing may match; exempt (id, rule) lists what a rule leaves alone."""
    rows = matching(graph, text).select("id")
    if exempt is not None:
        rows = rows.join(exempt.where(F.col("rule") == name), "id", "left_anti")
    return issue(rows, f"rule:{name}", F.col("id"), F.lit(text), severity)


def totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def transition(rows: DataFrame, steps: dict[str, list[str]], initial: list[str]) -> DataFrame:
    """rows (id, before, after) with `error`: what a workflow of states says of the change, null where it is legal."""
    states = F.lit(False) | F.col("after").isin(list(steps))
    legal = reduce(lambda a, b: a | b, [(F.col("before") == s) & F.col("after").isin([*to, s]) for s, to in steps.items()])
    error = (
        F.when(F.col("after").isNull(), F.when(F.col("before").isNotNull(), F.lit("unset")))
        .when(~states, F.lit("unknown-state"))
        .when(F.col("before").isNull(), F.when(~F.col("after").isin(initial), F.lit("not-initial")))
        # A state that is no longer declared may be left for any declared one.
        .when(F.col("before").isin(list(steps)) & ~legal, F.lit("illegal-transition"))
    )
    return rows.withColumn("error", error)


ADVICE = ("embedding-prefix-hint", "embed-large-chunk")


def level(kind: str) -> str:
    return "error" if kind in ERRORS else "advice" if kind in ADVICE else "warning"


def ordered(issues: DataFrame) -> DataFrame:
    """Issues, errors first, then by kind, node and message."""
    place = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.orderBy(place, "kind", "node_id", "message")


def link_issues(links: DataFrame) -> DataFrame:
    """Issues of links (source, link, state): dangling, ambiguous, or a heading or block that the page lacks; those of a file's
    sub-units are one, with the units as locations."""
    kinds = {"dangling": "dangling-edge", "ambiguous": "ambiguous-wikilink", "missing-heading": "missing-heading", "missing-block": "missing-block"}
    file = F.split_part("source", F.lit("#"), F.lit(1))
    rows = links.where(F.col("state").isin(list(kinds))).withColumn("file", file)
    rows = rows.groupBy("file", "link", "state").agg(F.array_sort(F.collect_set(F.when(F.col("source").contains("#"), F.col("source")))).alias("locations"))
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("state")]
    severity = F.when(kind.isin(list(ERRORS)), "error").otherwise("warning")
    return rows.select(severity.alias("severity"), kind.alias("kind"), F.col("file").alias("node_id"), F.col("link").alias("message"), "locations")


def ref_mismatch(edges: DataFrame, nodes: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Derived edges whose target isn't of the type that the reference property names."""
    ends = nodes.select(F.col("id").alias("target"), F.col("type").alias("found"))
    want = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[F.col("type")]
    rows = edges.where((F.col("kind") == "derived") & F.col("type").isin(list(wanted))).withColumn("want", want).join(ends, "target").where("found <> want")
    return issue(rows, "ref-type-mismatch", F.col("source"), F.concat_ws(" ", "type", F.lit("to"), "target", F.lit("of type"), "found"))


def missing_paths(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Paths (id, type, target) that nodes name and that lie under a folder there is, but aren't there; known has path."""
    paths = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("target")).distinct()
    tops = paths.where(~F.col("target").contains("/")).select(F.col("target").alias("_top"))
    anchored = refs.where(F.col("target").contains("/")).join(tops, F.split_part("target", F.lit("/"), F.lit(1)) == F.col("_top"), "left_semi")
    return issue(anchored.join(paths, "target", "left_anti").select("id", "type", "target").distinct(), "path-missing", F.col("id"), F.col("target"))


def embedding_drift(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """Models and lengths of stored vectors that aren't the ones set."""
    rows = chunks.select("model", F.size("vector").alias("dim")).groupBy("model", "dim").agg(F.count("*").alias("n")).where((F.col("model") != model) | (F.col("dim") != dim))
    return issue(rows, "embedding-drift", F.col("model"), F.concat(F.col("n").cast("string"), F.lit(" vectors of length "), F.col("dim").cast("string")))


def embed_failures(failures: DataFrame, most: int = 3) -> DataFrame:
    """Work that failed and is tried again, and work that is parked."""
    parked = F.col("attempts") >= most
    rows = failures.withColumn("k", F.when(parked, "embed-failed").otherwise("embed-retry"))
    return rows.select(F.lit("warning").alias("severity"), F.col("k").alias("kind"), F.col("id").alias("node_id"), F.coalesce("error", F.lit("")).alias("message"))


def without_chunks(nodes: DataFrame, chunks: DataFrame, pending: DataFrame) -> DataFrame:
    """Nodes without a chunk that aren't waiting for one."""
    rows = nodes.join(chunks.select("id").distinct(), "id", "left_anti").join(pending.select("id").distinct(), "id", "left_anti")
    return issue(rows, "embed-no-chunks", F.col("id"), F.lit("no chunks"))


def large_chunks(chunks: DataFrame, most: int) -> DataFrame:
    rows = chunks.where(F.octet_length("body") > most)
    return issue(rows, "embed-large-chunk", F.col("id"), F.concat(F.octet_length("body").cast("string"), F.lit(" bytes")), "advice")


def prefix_hint(spark, model: str, prefixes: dict[str, str], set_prefix: str) -> DataFrame:
    """An advice where the model is known to want a prefix and none is set."""
    want = next((p for name, p in prefixes.items() if model.split(":")[0] == name), None)
    rows = [("advice", "embedding-prefix-hint", model, f"the model expects the prefix {want!r}")] if want and not set_prefix else []
    return spark.createDataFrame(rows, "severity string, kind string, node_id string, message string")


def config_issues(spark, manifest, stored: dict[str, str] | None = None, now: dict[str, str] | None = None) -> DataFrame:
    """What is wrong with the settings: keys nobody knows, the expansion, aliases whose filters don't hold, and an index that
    isn't built or was built under other settings."""
    from loamgraph.plans.filter import FilterError, parse, sort_keys, validate

    rows = [("warning", "manifest-unknown-key", k, f"unknown key {k}") for k in manifest.unknown]
    rows += [("warning", *p.split(": ", 1)[:1], "", p.split(": ", 1)[1]) for p in manifest.expansion.problems(manifest.edges)]
    for name, a in manifest.aliases.items():
        try:
            said = validate(parse(a.get("filter", "")), manifest)
            if a.get("sort"):
                sort_keys(a["sort"], manifest)
            if a.get("skip") is not None and a.get("take") is None:
                said.append("skip needs take")
        except FilterError as e:
            said = [str(e)]
        rows += [("warning", "alias-invalid", name, s) for s in said]
    rows += [("warning", "context-invalid", name, "no such alias") for name in manifest.context.get("include", []) if name not in manifest.aliases]
    if now is not None:
        if not stored:
            rows.append(("warning", "index-not-built", "", "the index is not built yet"))
        elif stored != now:
            rows.append(("warning", "index-schema-stale", "", "built with other " + ", ".join(sorted(k for k in now if stored.get(k) != now[k]))))
    return spark.createDataFrame(rows, "severity string, kind string, node_id string, message string")


def pinned_missing(manifest, nodes: DataFrame) -> DataFrame:
    """Pinned nodes of the context that aren't there."""
    pinned = nodes.sparkSession.createDataFrame([(x,) for x in manifest.context.get("pinned", [])], "id string")
    return issue(pinned.join(nodes.select("id"), "id", "left_anti"), "context-pinned-missing", F.col("id"), F.lit("no such node"))


def skipped(parsed: DataFrame) -> DataFrame:
    """Files (path, error) that couldn't be read."""
    return issue(parsed.where("error is not null"), "skipped-file", F.col("path"), F.col("error"))


def units_left(nodes: DataFrame, enabled: bool) -> DataFrame:
    """One row where sub-units are switched off and some are still stored."""
    rows = nodes.where("parent_id is not null").agg(F.count("*").alias("n")).where(F.lit(not enabled) & (F.col("n") > 0))
    return issue(rows, "sub-units-disabled-dirty", F.lit(""), F.concat(F.col("n").cast("string"), F.lit(" sub-units")))


def legacy_edges(edges: DataFrame, names: dict[str, str]) -> DataFrame:
    """Edges of types that have another name by now (old to kind of issue)."""
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("type")]
    rows = edges.where(F.col("type").isin(list(names)))
    return rows.select(F.lit("warning").alias("severity"), kind.alias("kind"), F.col("source").alias("node_id"), F.concat_ws(" ", "type", F.lit("to"), "target").alias("message"))


def json_properties(nodes: DataFrame, declared: dict[str, str], required: list[str] = (), json: str = "json") -> DataFrame:
    """Properties of a JSON column held against what is declared (name to kind): undeclared ones, values of another kind,
    required ones that are missing."""
    doc = F.try_parse_json(json)
    keys = F.json_object_keys(json)
    found = [F.transform(F.filter(F.coalesce(keys, F.array()), lambda k: ~k.isin(list(declared))), lambda k: F.struct(F.lit("undeclared-property").alias("kind"), k.alias("name")))]
    fits = {
        "string": lambda k: k == "STRING", "markdown": lambda k: k == "STRING", "enum": lambda k: k == "STRING", "ref": lambda k: k == "STRING", "date": lambda k: k == "STRING",
        "datetime": lambda k: k == "STRING", "int": lambda k: k.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "bool": lambda k: k == "BOOLEAN", "list-of": lambda k: k.startswith("ARRAY"),
        "float": lambda k: k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT", "BIGINT", "INT", "SMALLINT", "TINYINT"),
    }
    for name, kind in declared.items():
        k = F.schema_of_variant(F.try_variant_get(doc, f"$['{name}']", "variant"))
        there = k.isNotNull() & (k != "VOID")
        found.append(F.when(there & ~fits[kind](k), F.array(F.struct(F.lit("type-mismatch").alias("kind"), F.lit(name).alias("name")))).otherwise(F.array()))
        if name in required:
            found.append(F.when(~F.coalesce(there, F.lit(False)), F.array(F.struct(F.lit("required-missing").alias("kind"), F.lit(name).alias("name")))).otherwise(F.array()))
    rows = nodes.select("id", F.explode(F.concat(*found)).alias("f"))
    severity = F.when(F.col("f.kind").isin(list(ERRORS)), "error").otherwise("warning")
    return rows.select(severity.alias("severity"), F.col("f.kind").alias("kind"), F.col("id").alias("node_id"), F.col("f.name").alias("message"))


def ref_issues(resolved: DataFrame) -> DataFrame:
    """Issues of references (source, value, type, target, state) that lead nowhere, to several, or to another type."""
    kind = F.create_map(*[F.lit(x) for kv in (("dangling", "ref_dangling"), ("ambiguous", "ref_ambiguous"), ("type-mismatch", "ref_type_mismatch")) for x in kv])[F.col("state")]
    rows = resolved.where("state <> 'ok'")
    return rows.select(F.lit("error").alias("severity"), kind.alias("kind"), F.col("source").alias("node_id"), F.col("value").alias("message"))


def workflow_states(rows: DataFrame, steps: dict[str, list[str]]) -> DataFrame:
    """Nodes (id, state) whose state the workflow doesn't know."""
    return issue(rows.where(F.col("state").isNotNull() & ~F.col("state").isin(list(steps))), "workflow-violation", F.col("id"), F.concat(F.lit("unknown state "), F.col("state")))


def unused_exemptions(exempt: DataFrame, matched: DataFrame) -> DataFrame:
    """Exemptions (id, rule) from rules that wouldn't have found the node (matched: id, rule)."""
    return issue(exempt.join(matched, ["id", "rule"], "left_anti"), "rule-ignore-unused", F.col("id"), F.col("rule"))
