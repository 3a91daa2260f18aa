"""What readers of the graph see: snapshots, rails, trees, edge lists, unit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators import analytics, expand
from loamgraph.operators.aggregate import degrees


def files(nodes: DataFrame) -> DataFrame:
    """Nodes that are files; all of them where no node has a parent column."""
    return nodes.where("parent_id is null") if "parent_id" in nodes.columns else nodes


def snapshot(nodes: DataFrame, edges: DataFrame, group: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The file graph: (id, type, title, degree, in_degree, group) of every file, and the edges (type, source, target)
    whose both ends are files, each once. Without a group a node's group is its type."""
    kept = files(nodes)
    ids = kept.select("id")
    lines = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    lines = lines.select("type", "source", "target").distinct()
    rows = kept.select("id", "type", "title", (group if group is not None else F.col("type")).cast("string").alias("group")).join(degrees(lines), "id", "left")
    return rows.select("id", "type", "title", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "group"), lines


def grouped(nodes: DataFrame, edges: DataFrame, by: str, name: str | None = None, parents: DataFrame | None = None, depth: int | None = None, resolution: float = 1.0) -> DataFrame:
    """(id, group): by type, property (its name), ancestor (of parents, depth steps up or the root) or community; null
    without a value."""
    kept = files(nodes)
    if by == "type":
        return kept.select("id", F.col("type").alias("group"))
    if by == "property":
        c = F.col(name)
        is_list = kept.schema[name].dataType.typeName() == "array"
        return kept.select("id", (F.get(c, F.lit(0)) if is_list else c).cast("string").alias("group"))
    if by == "ancestor":
        found = analytics.ancestors(parents, depth).withColumnRenamed("ancestor", "group")
    elif by == "community":
        found = analytics.communities(edges, resolution).withColumnRenamed("community", "group")
    else:
        raise ValueError(f"no grouping by {by!r}")
    return kept.select("id").join(found, "id", "left")


def community_edges(edges: DataFrame, types: list[str] = (), kinds: list[str] = ()) -> DataFrame:
    """Edges that count for communities: of one of the types, or of one of the kinds; all without either."""
    if not types and not kinds:
        return edges
    fits = F.lit(False)
    if types:
        fits = fits | F.col("type").isin(list(types))
    if kinds:
        fits = fits | F.col("kind").isin(list(kinds))
    return edges.where(fits)


def rails(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, other, title): files that link from (in) and to (out) each file, whatever the type, its own links
    left out; sub-units count as their files, dangling ends not at all."""
    file = lambda c: expand.file_of(F.col(c))
    pairs = edges.select(file("source").alias("a"), file("target").alias("b")).where("a <> b").distinct()
    both = pairs.select(F.col("a").alias("id"), F.lit("out").alias("direction"), F.col("b").alias("other"))
    both = both.union(pairs.select(F.col("b").alias("id"), F.lit("in").alias("direction"), F.col("a").alias("other")))
    known = files(nodes).select(F.col("id").alias("other"), "title")
    return both.join(ids.select("id"), "id", "left_semi").join(known, "other").select("id", "direction", "other", "title")


def edge_list(edges: DataFrame, source: str | None = None, target: str | None = None, kinds: list[str] | None = None, folded: bool = True) -> DataFrame:
    """Edges from and to an id, of some types; folded, those of sub-units count as their file's, with the units."""
    rows = edges
    if kinds is not None:
        rows = rows.where(F.col("type").isin(kinds))
    if source is not None:
        rows = rows.where((expand.file_of(F.col("source")) if folded else F.col("source")) == source)
    if target is not None:
        rows = rows.where(F.col("target") == target)
    return expand.fold(rows) if folded else rows


def ordered(edges: DataFrame) -> DataFrame:
    """(id, edges): of each source its edges as written: by type, place and target."""
    row = F.struct("type", F.coalesce("position", F.lit(0)).alias("position"), "target")
    return edges.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("edges"))


def unit_counts(nodes: DataFrame, by_file_type: bool = False) -> DataFrame:
    """(kind, n) of sub-units by their type, or by the type of the file they are in."""
    units = nodes.where("parent_id is not null")
    if not by_file_type:
        return units.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    of = files(nodes).select(F.col("id").alias("file"), F.col("type").alias("kind"))
    return units.withColumn("file", expand.file_of(F.col("id"))).select("file").join(of, "file", "left").groupBy("kind").agg(F.count("*").alias("n"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Sub-units whose parent is no node."""
    return nodes.where("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")


def oversize(rows: DataFrame, payload: str, most: int) -> DataFrame:
    """Rows whose payload has more bytes than `most`."""
    return rows.where(F.octet_length(payload) > most)


def chunk_stats(chunks: DataFrame, large: int = 4000, top: int = 5) -> DataFrame:
    """One row on chunks (id, chunk, body): nodes, total, mean, median (of an even number the lower mean), most, the top
    nodes with most chunks as an array (id, n), and how many chunks have more than `large` bytes."""
    by_node = chunks.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.octet_length("body") > large).alias("large"))
    # Nodes by their number of chunks are few, so the median is found among them.
    counts = by_node.groupBy("n").agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(Window.partitionBy()))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("n")))
    median = upto.agg(F.floor((at(low) + at(high)) / 2).alias("median"))
    sums = by_node.agg(F.count("*").alias("nodes"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.sum("large").alias("large"))
    best = by_node.orderBy(F.desc("n"), "id").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), "id"))).alias("b"))
    first = F.transform(F.col("b"), lambda x: F.struct(x["id"].alias("id"), (-x["by"]).alias("n")))
    return sums.crossJoin(median).crossJoin(best.select(first.alias("top")))  # one row each


def models(chunks: DataFrame) -> DataFrame:
    """(model, dim): what vectors there are."""
    return chunks.select("model", F.size("vector").alias("dim")).distinct()


def unit_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, links): how many links leave each sub-unit, its place in the file apart."""
    units = nodes.where("parent_id is not null").select("id")
    out = edges.where("kind <> 'structural'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("links"))
    return units.join(out, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


def unit_tree(nodes: DataFrame, edges: DataFrame, file: str) -> DataFrame:
    """(id, parent_id, type, title, ordinal, links) of one file's sub-units, in order."""
    units = nodes.where((F.col("parent_id").isNotNull()) & (expand.file_of(F.col("id")) == file))
    return units.join(unit_degrees(units, edges), "id", "left").select("id", "parent_id", "type", "title", "ordinal", "links").orderBy("ordinal", "id")


def detail(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes asked for with their neighbours (direction, type, other, title) in the order of the edges' types and ends."""
    near = expand.neighbors(edges, nodes, ids).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("type", "direction", "other", "title"))).alias("neighbors"))
    return nodes.join(ids.select("id"), "id", "left_semi").join(near, "id", "left")


def reading_index(nodes: DataFrame) -> DataFrame:
    """Files in reading order: (path, id, title, type)."""
    return files(nodes).select("path", "id", "title", "type").orderBy("path", "id")


def link_map(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, link, target): where each link of a page leads; one that no name resolves may be a file's whole title,
    if just one file has it. links has source, link and target, null where nothing was found."""
    titles = files(nodes).groupBy(F.lower("title").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("by_title")).where("n = 1").select("key", "by_title")
    rows = links.withColumn("key", F.lower(F.trim("link"))).join(titles, "key", "left")
    return rows.select("source", "link", F.coalesce("target", "by_title").alias("target"))


def path_list(refs: DataFrame, known: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(id, paths): of each node what it names, an entry a path and edge type: lines, and whether the path is there.
    refs has id, type, target and line, known the paths that exist; sections adds the innermost section of the first line."""
    there = known.select(F.col("path").alias("target"), F.lit(True).alias("exists")).distinct()
    rows = refs.groupBy("id", "type", "target").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    rows = rows.join(there, "target", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    if sections is not None:
        from loamgraph.operators.hybrid import innermost

        at = innermost(sections, rows.select(F.col("id").alias("file"), F.get("lines", F.lit(0)).alias("line")).distinct())
        rows = rows.withColumn("line", F.get("lines", F.lit(0))).join(at.withColumnRenamed("file", "id"), ["id", "line"], "left")
    else:
        rows = rows.withColumn("section", F.lit(None).cast("string"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("target", "type", "lines", "exists", "section"))).alias("paths"))


def numbered_ids(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with `name`: the key's values joined, and -1, -2 ... after what is there already, in order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    base = F.concat_ws("-", *key)
    return rows.withColumn("name", F.when(nth == 0, base).otherwise(F.concat(base, F.lit("-"), nth.cast("string"))))


def top_units(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group with their `place`, and `total`, how many the group has. Tasks keep their own first
    rows and counts before any are shuffled, so a large group doesn't come together."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= most)
    return placed.join(rows.groupBy(by).agg(F.count("*").alias("total")), by)


def duplicates(rows: DataFrame, content: Column) -> DataFrame:
    """(content_hash, n): contents that several rows have, by their hash; null contents aren't equal."""
    hashed = rows.select(F.sha2(content, 256).alias("content_hash")).where("content_hash is not null")
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
