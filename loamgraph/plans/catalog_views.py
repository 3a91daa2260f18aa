"""Registered queries of views, changes of the graph, references, checks and incremental work, with SQL equivalents.

Orders are files here and their lines sub-units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import expand, hybrid, mutate, views
from loamgraph.plans import checks, service
from loamgraph.sources.graph import Graph
from loamgraph.streaming import queue


def _lines(g: Graph) -> DataFrame:
    file = F.concat(F.lit("order/"), "l_orderkey")
    # A line's number may repeat in the table.
    once = g.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_returnflag", "l_partkey", "l_quantity")))
    return once.select(
        F.concat(file, F.lit("#L"), "l_linenumber").alias("id"), F.concat(F.lit("line-"), "l_returnflag").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("title"),
        file.alias("parent_id"), F.col("l_linenumber").alias("ordinal"), F.expr("repeat('x', int(l_quantity))").alias("body"), F.col("l_partkey").alias("part"),
    )


def _order_files(g: Graph) -> DataFrame:
    o = g.table("orders")
    id_ = F.concat(F.lit("order/"), "o_orderkey")
    return o.select(id_.alias("id"), F.concat(F.lit("order-"), "o_orderstatus").alias("type"), F.concat(id_, F.lit(".md")).alias("path"), F.col("o_orderkey").cast("string").alias("title"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("ordinal"))


def _tree(g: Graph) -> DataFrame:
    """Files but one in nine, and all lines."""
    return _order_files(g).where("title % 9 <> 0").unionByName(_lines(g).drop("body", "part"))


def _chunks(g: Graph) -> DataFrame:
    return _lines(g).select(F.col("parent_id").alias("id"), F.col("ordinal").alias("chunk"), "body")


def _places(g: Graph) -> tuple[DataFrame, DataFrame]:
    return g.nodes(["region", "nation", "customer"]), expand.typed_edges(g, ["in-region", "in-nation"])


def _stats(spark, sf):
    s = views.chunk_stats(_chunks(Graph(spark, sf)), large=40)
    return s.select("nodes", "total", F.round("mean", 6).alias("mean"), "median", "most", "large", F.col("top")[4]["id"].alias("fifth"))


def _snapshot(spark, sf):
    return views.snapshot(*_places(Graph(spark, sf)))[0].drop("title")


def _rails(spark, sf):
    nodes, edges = _places(Graph(spark, sf))
    return views.rails(edges, nodes, nodes.where("type = 'nation'"))


def _ordered(spark, sf):
    g = Graph(spark, sf)
    lines = g.table("lineitem").select(F.lit("contains-part").alias("type"), F.concat(F.lit("order/"), "l_orderkey").alias("source"), F.concat(F.lit("part/"), "l_partkey").alias("target"), F.lit("direct").alias("kind"), F.col("l_linenumber").alias("position"))
    return views.ordered(mutate.deduplicated(lines)).select("id", F.posexplode("edges").alias("at", "e")).select("id", "at", "e.position", "e.target")


def _unit_degrees(spark, sf):
    g = Graph(spark, sf)
    links = _lines(g).where("part % 3 = 0").select(F.col("id").alias("source"), F.lit("direct").alias("kind"))
    return views.unit_degrees(_lines(g), links).groupBy("links").agg(F.count("*").alias("n"))


def _innermost(spark, sf):
    units = _lines(Graph(spark, sf)).select(F.col("parent_id").alias("file"), "id", F.col("ordinal").alias("start_line"), (F.col("ordinal") + F.col("part") % 3).cast("int").alias("end_line"))
    lines = units.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("line"))
    return hybrid.innermost(units, lines)


def _refs(spark, sf):
    g = Graph(spark, sf)
    c = g.table("customer")
    value = F.expr("CASE c_custkey % 5 WHEN 0 THEN concat('nation/', c_nationkey) WHEN 1 THEN concat('NATION_', c_nationkey) WHEN 2 THEN 'region/1' WHEN 3 THEN 'nowhere' ELSE concat('[[', c_nationkey, '|x]]') END")
    refs = c.select(F.concat(F.lit("customer/"), "c_custkey").alias("source"), value.alias("value"), F.lit("nation").alias("type"))
    return mutate.resolve_refs(refs, g.nodes(["nation", "region"])).select("source", "target", "state")


def _moved(spark, sf):
    nodes, edges = _places(Graph(spark, sf))
    moves = nodes.where("type = 'nation'").select(F.col("id").alias("old"), F.regexp_replace("id", "nation", "land").alias("new"), F.regexp_replace("path", "nation", "land").alias("path"))
    return mutate.move(nodes, edges.withColumns({"kind": F.lit("direct"), "position": F.lit(1)}), moves)[1].select("type", "source", "target")


def _twins(spark, sf):
    g = Graph(spark, sf)
    edges = expand.typed_edges(g, ["contains-part"]).withColumns({"kind": F.lit("direct"), "position": F.lit(1)})
    moves = g.nodes(["part"]).select(F.col("id").alias("old"), F.concat(F.lit("part/"), F.col("p_size").cast("string")).alias("new"))
    return mutate.retarget(edges, moves, size=g.size("contains-part")).select("source", "target")


def _edge_changes(spark, sf):
    e = Graph(spark, sf).table("orders").select(F.lit("placed-by").alias("type"), F.concat(F.lit("order/"), "o_orderkey").alias("source"), F.concat(F.lit("customer/"), "o_custkey").alias("target"), "o_orderkey")
    return mutate.edge_changes(e.where("o_orderkey % 5 <> 0"), e.where("o_orderkey % 7 <> 0"))


def _paths(spark, sf):
    g = Graph(spark, sf)
    refs = g.table("customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.lit("mentions").alias("type"), F.expr("concat(if(c_custkey % 2 = 0, 'order/', 'away/'), c_custkey * 7, '.md')").alias("target"))
    return checks.missing_paths(refs, _order_files(g).where("title % 9 <> 0"))


def _mismatch(spark, sf):
    g = Graph(spark, sf)
    edges = expand.typed_edges(g, ["in-nation", "in-region"]).withColumn("kind", F.expr("if(source like '%3', 'derived', 'direct')"))
    return checks.ref_mismatch(edges, g.nodes(["region", "nation", "customer"]), {"in-nation": "region", "in-region": "region"})


def _drift(spark, sf):
    v = Graph(spark, sf).table("embeddings").select(F.expr("if(label = 3, 'old', 'new')").alias("model"), F.col("embedding").alias("vector"))
    return checks.embedding_drift(v, "new", 64)


def _work(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = g.table("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderkey").alias("k"))
    done = o.where("k % 3 = 0").select("id", F.expr("if(k % 2 = 0, 'F', content_hash)").alias("content_hash"))
    return o, done, o.where("k % 5 = 0").select("id", "content_hash", (F.col("k") % 4 + 1).cast("int").alias("attempts"), F.lit("e").alias("error"))


def _due(spark, sf):
    work, done, failures = _work(Graph(spark, sf))
    return queue.due(work, done, failures).select("id", "content_hash")


def _failed(spark, sf):
    work, done, failures = _work(Graph(spark, sf))
    return queue.failed(failures, work.where("k % 10 = 0").select("id", "content_hash", F.lit("again").alias("error")), done)


def _unit_changes(spark, sf):
    rows = _lines(Graph(spark, sf)).select("id", F.col("type").alias("content_hash"), "ordinal", "part")
    parsed = rows.where("part % 7 <> 0").select("id", F.expr("if(part % 5 = 0, 'new', content_hash)").alias("content_hash"), F.expr("ordinal + int(part % 3 = 0)").alias("ordinal"))
    return queue.unit_changes(rows.where("part % 11 <> 0"), parsed).groupBy("change").agg(F.count("*").alias("n"))


def _missing(spark, sf):
    chunks = Graph(spark, sf).table("documents").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("body"), "doc_id")
    vectors = chunks.where("doc_id % 4 = 0").select("content_hash", F.expr("if(doc_id % 8 = 0, 'm', 'other')").alias("model"))
    return queue.missing_vectors(chunks, vectors, "m").select("content_hash")


def _numbered(spark, sf):
    p = Graph(spark, sf).table("part").select("p_partkey", "p_brand", "p_type")
    return views.numbered_ids(p, ["p_brand", "p_type"], "p_partkey").select("p_partkey", "name")


def _fields(spark, sf):
    return service.run(Graph(spark, sf), service.Request("type=customer c_acctbal>9000", include=("properties",), fields=("id", "title", "properties.c_mktsegment")))


def _walk(spark, sf):
    o = Graph(spark, sf).table("orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("path"), F.col("o_orderstatus").alias("content_hash"), F.col("o_orderdate").alias("modified"), F.col("o_custkey").alias("size"), "o_orderkey")
    stored = o.where("o_orderkey % 4 <> 0").select("path", "content_hash", "modified", "size", F.lit("live").alias("state"), F.lit(1).alias("generation"))
    listing = o.where("o_orderkey % 6 <> 0").withColumn("size", F.expr("size + int(o_orderkey % 10 = 0)")).drop("o_orderkey")
    read = queue.to_read(stored, listing).select("path", F.lit(True).alias("read"))
    return queue.walk_state(stored, listing, 2).join(read, "path", "left").groupBy("state", "generation", "read").agg(F.count("*").alias("n"))


QUERIES = {
    "a06_unit_counts": lambda spark, sf: views.unit_counts(_tree(Graph(spark, sf))),
    "a06_by_file_type": lambda spark, sf: views.unit_counts(_tree(Graph(spark, sf)), True),
    "a08_orphans": lambda spark, sf: views.orphans(_tree(Graph(spark, sf))).agg(F.count("*").alias("n")),
    "a09_oversize": lambda spark, sf: views.oversize(Graph(spark, sf).table("documents"), "text", 4000).agg(F.count("*").alias("n")),
    "a10_stats": _stats,
    "a11_models": lambda spark, sf: views.models(Graph(spark, sf).table("embeddings").select(F.concat(F.lit("m"), F.col("label") % 3).alias("model"), F.col("embedding").alias("vector"))),
    "a15_unit_degrees": _unit_degrees,
    "d03_ref_mismatch": _mismatch,
    "d06_json": lambda spark, sf: checks.json_properties(Graph(spark, sf).nodes(["event"]), {"k": "string", "z": "int"}, ["z"]).groupBy("severity", "kind", "message").agg(F.count("*").alias("n")),
    "d08_missing_paths": _paths,
    "d09_drift": _drift,
    "e02_alias": lambda spark, sf: service.alias(Graph(spark, sf), "open-orders", take=15).select("id"),
    "g01_snapshot": _snapshot,
    "g03_by_property": lambda spark, sf: views.grouped(Graph(spark, sf).nodes(["customer", "region"]), None, "property", "c_mktsegment"),
    "g14_rails": _rails,
    "j20_refs": _refs,
    "m02_walk": _walk,
    "m03_due": _due,
    "m04_failed": _failed,
    "m08_unit_changes": _unit_changes,
    "p23_fields": _fields,
    "r24_missing_vectors": _missing,
    "t06_edge_order": _ordered,
    "u04_edge_changes": _edge_changes,
    "v03_moved": _moved,
    "v04_twins": _twins,
    "w06_numbered": _numbered,
    "y08_innermost": _innermost,
}

_FILES = "o AS (SELECT * FROM orders WHERE o_orderkey % 9 <> 0)"
_WORK = "w AS (SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS content_hash, o_orderkey AS k FROM orders), d AS (SELECT id, CASE WHEN k % 2 = 0 THEN 'F' ELSE content_hash END AS content_hash FROM w WHERE k % 3 = 0), f AS (SELECT id, content_hash, (k % 4 + 1)::INT AS attempts, 'e' AS error FROM w WHERE k % 5 = 0)"

ORACLE_SQL = {
    "a06_unit_counts": "SELECT 'line-' || l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1",
    "a06_by_file_type": f"WITH {_FILES} SELECT 'order-' || o_orderstatus AS kind, count(*) AS n FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey GROUP BY 1",
    "a08_orphans": f"WITH {_FILES} SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)",
    "a09_oversize": "SELECT count(*) AS n FROM documents WHERE strlen(text) > 4000",
    "a10_stats": "WITH c AS (SELECT 'order/' || l_orderkey AS id, count(*) AS n, count(*) FILTER (l_quantity::INT > 40) AS large FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n) AS up, count(*) OVER () AS k FROM c) "
    "SELECT count(*) AS nodes, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, (SELECT floor(avg(n))::BIGINT FROM r WHERE up IN ((k + 1) // 2, k // 2 + 1)) AS median, max(n) AS most, sum(large)::BIGINT AS large, (SELECT id FROM c ORDER BY n DESC, id LIMIT 1 OFFSET 4) AS fifth FROM c",
    "a11_models": "SELECT DISTINCT 'm' || (label % 3) AS model, len(embedding)::INT AS dim FROM embeddings",
    "a15_unit_degrees": "SELECT CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS links, count(*) AS n FROM lineitem GROUP BY 1",
    "d03_ref_mismatch": "SELECT 'warning' AS severity, 'ref-type-mismatch' AS kind, 'customer/' || c_custkey AS node_id, 'in-nation to nation/' || c_nationkey || ' of type nation' AS message FROM customer WHERE c_custkey % 10 = 3",
    "d06_json": "SELECT 'error' AS severity, 'type-mismatch' AS kind, 'k' AS message, count(*) AS n FROM events UNION ALL SELECT 'error', 'required-missing', 'z', count(*) FROM events",
    "d08_missing_paths": f"WITH {_FILES} SELECT 'warning' AS severity, 'path-missing' AS kind, 'customer/' || c_custkey AS node_id, 'order/' || c_custkey * 7 || '.md' AS message FROM customer WHERE c_custkey % 2 = 0 AND c_custkey * 7 NOT IN (SELECT o_orderkey FROM o)",
    "d09_drift": "SELECT 'warning' AS severity, 'embedding-drift' AS kind, 'old' AS node_id, count(*) || ' vectors of length 64' AS message FROM embeddings WHERE label = 3",
    "e02_alias": "SELECT 'order/' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, 'order/' || o_orderkey LIMIT 15",
    "g01_snapshot": "WITH e AS (SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS t FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer), x AS (SELECT 'region/' || r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'customer' FROM customer), "
    "g AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS in_degree FROM (SELECT s AS id, 0 AS i FROM e UNION ALL SELECT t, 1 FROM e) GROUP BY id) SELECT id, type, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree, type AS \"group\" FROM x LEFT JOIN g USING (id)",
    "g03_by_property": "SELECT 'customer/' || c_custkey AS id, c_mktsegment AS \"group\" FROM customer UNION ALL SELECT 'region/' || r_regionkey, NULL FROM region",
    "g14_rails": "SELECT 'nation/' || n_nationkey AS id, 'out' AS direction, 'region/' || r_regionkey AS other, r_name AS title FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'nation/' || c_nationkey, 'in', 'customer/' || c_custkey, c_name FROM customer",
    "j20_refs": "SELECT 'customer/' || c_custkey AS source, CASE c_custkey % 5 WHEN 0 THEN 'nation/' || c_nationkey WHEN 1 THEN 'nation/' || c_nationkey WHEN 2 THEN 'region/1' WHEN 3 THEN NULL ELSE CASE WHEN c_nationkey < 5 THEN NULL ELSE 'nation/' || c_nationkey END END AS target, "
    "CASE c_custkey % 5 WHEN 2 THEN 'type-mismatch' WHEN 3 THEN 'dangling' WHEN 4 THEN CASE WHEN c_nationkey < 5 THEN 'ambiguous' ELSE 'ok' END ELSE 'ok' END AS state FROM customer",
    "m02_walk": "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 <> 0 AS stored, o_orderkey % 6 <> 0 AS listed FROM orders) SELECT CASE WHEN listed THEN 'live' ELSE 'tombstone' END AS state, CASE WHEN listed THEN 2 ELSE 1 END AS generation, CASE WHEN listed AND NOT (stored AND k % 10 <> 0) THEN true END AS read, count(*) AS n FROM o WHERE stored OR listed GROUP BY ALL",
    "m03_due": f"WITH {_WORK} SELECT id, content_hash FROM w WHERE (id, content_hash) NOT IN (SELECT id, content_hash FROM d) AND (id, content_hash) NOT IN (SELECT id, content_hash FROM f WHERE attempts >= 3)",
    "m04_failed": f"WITH {_WORK} SELECT w.id, w.content_hash, coalesce(attempts, 0) + 1 AS attempts, 'again' AS error FROM w LEFT JOIN f USING (id, content_hash) WHERE k % 10 = 0 UNION ALL SELECT f.* FROM f WHERE id::BIGINT % 10 <> 0 AND (id, content_hash) NOT IN (SELECT id, content_hash FROM d)",
    "m08_unit_changes": "WITH x AS (SELECT CASE WHEN l_partkey % 11 = 0 THEN CASE WHEN l_partkey % 7 <> 0 THEN 'insert' END WHEN l_partkey % 7 = 0 THEN 'delete' WHEN l_partkey % 5 = 0 THEN 'update' WHEN l_partkey % 3 = 0 THEN 'move' END AS change FROM lineitem) SELECT change, count(*) AS n FROM x WHERE change IS NOT NULL GROUP BY 1",
    "p23_fields": "SELECT 'customer/' || c_custkey AS id, c_name AS title, c_mktsegment AS properties_c_mktsegment FROM customer WHERE c_acctbal > 9000",
    "r24_missing_vectors": "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 8 = 0)",
    "t06_edge_order": "WITH e AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2) SELECT 'order/' || l_orderkey AS id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY position, 'part/' || l_partkey) - 1)::INT AS at, position, 'part/' || l_partkey AS target FROM e",
    "u04_edge_changes": "SELECT 'placed-by' AS type, 'order/' || o_orderkey AS source, 'customer/' || o_custkey AS target, CASE WHEN o_orderkey % 5 = 0 THEN 'added' ELSE 'removed' END AS change FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0)",
    "v03_moved": "SELECT 'in-region' AS type, 'land/' || n_nationkey AS source, 'region/' || n_regionkey AS target FROM nation UNION ALL SELECT 'in-nation', 'customer/' || c_custkey, 'land/' || c_nationkey FROM customer",
    "v04_twins": "SELECT DISTINCT 'order/' || l_orderkey AS source, 'part/' || p_size AS target FROM lineitem JOIN part ON p_partkey = l_partkey",
    "w06_numbered": "SELECT p_partkey, p_brand || '-' || p_type || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)",
    "y08_innermost": "WITH u AS (SELECT 'order/' || l_orderkey AS file, 'order/' || l_orderkey || '#L' || l_linenumber AS id, l_linenumber AS a, l_linenumber + l_partkey % 3 AS b FROM lineitem), l AS (SELECT DISTINCT file, line FROM u, (SELECT unnest([1, 3, 5]) AS line)) "
    "SELECT file, line::INT AS line, CASE WHEN line BETWEEN a AND b THEN id END AS section FROM l LEFT JOIN u USING (file) QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY NOT coalesce(line BETWEEN a AND b, false), b - a, a DESC, id) = 1",
}

_LINES = "li AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"
for _name in ("a06_unit_counts", "a06_by_file_type", "a08_orphans", "a10_stats", "a15_unit_degrees", "m08_unit_changes", "y08_innermost"):
    _sql = ORACLE_SQL[_name].replace("FROM lineitem", "FROM li")
    ORACLE_SQL[_name] = f"WITH {_LINES}, {_sql[5:]}" if _sql.startswith("WITH ") else f"WITH {_LINES} {_sql}"
