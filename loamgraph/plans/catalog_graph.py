"""Registered queries of expansion, analytics, checks, passages, files and change capture, with SQL equivalents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loamgraph.functions import passages
from loamgraph.operators import analytics, expand, rank, views
from loamgraph.plans import checks
from loamgraph.plans.filter import query
from loamgraph.sources import files
from loamgraph.sources.graph import Graph
from loamgraph.streaming import changes

NOW = datetime(2001, 8, 1, 12)
SEEDS = 20
WEIGHT = 0.2


def _ids(text: str):
    return lambda spark, sf: query(Graph(spark, sf, NOW), text).select("id")


def _seeds(graph: Graph):
    """The dearest orders, scored by price."""
    top = graph.table("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(SEEDS)
    return top.select(F.concat(F.lit("order/"), "o_orderkey").alias("id"), (F.col("o_totalprice") / 1e6).alias("score"))


def _blended(hops: int):
    def run(spark, sf):
        g = Graph(spark, sf)
        near = expand.both_ways(expand.typed_edges(g, ["placed-by", "in-nation"]))
        got = expand.blend(near, expand.walk(near, _seeds(g), hops), WEIGHT)
        return got.select("id", "distance", F.round("graph", 6).alias("graph"), F.round("final", 6).alias("final"))

    return run


def _related(spark, sf):
    near = expand.both_ways(expand.typed_edges(Graph(spark, sf), ["in-region", "in-nation"]))
    return expand.related(near, "nation/3", 1, WEIGHT).select("id", "distance", F.round("final", 6).alias("final"))


def _edge_view(view):
    def run(spark, sf):
        g = Graph(spark, sf)
        ids = g.nodes(["nation"]).where("title = 'NATION_3'").select("id")
        # Regions are left out of the nodes, so edges to them dangle.
        return view(expand.typed_edges(g, ["in-region", "in-nation"]), g.nodes(["nation", "customer"]), ids)

    return run


def _cycles(spark, sf):
    return analytics.cycles(expand.typed_edges(Graph(spark, sf), ["next", "in-nation"]))


def _communities(spark, sf):
    return analytics.communities(expand.typed_edges(Graph(spark, sf), ["in-region", "in-nation"]))


def _components(spark, sf):
    return analytics.components(expand.typed_edges(Graph(spark, sf), ["in-region", "in-nation"]))


def _pooled(spark, sf):
    v = Graph(spark, sf).table("embeddings").select(F.concat(F.lit("label/"), "label").alias("id"), F.col("embedding").alias("vector"))
    return analytics.pooled(v).select("id", F.posexplode("vector").alias("at", "x")).select("id", (F.col("at") + 1).alias("dim"), F.round("x", 5).alias("x"))


def _top_units(spark, sf):
    """The three dearest lines of each order, and how many there are."""
    rows = Graph(spark, sf).table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return views.top_units(rows, "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber")], 3)


def _title_match(spark, sf):
    g = Graph(spark, sf)
    return rank.coverage(g.nodes(["part"]), "small green things").where("coverage > 0").select("id", F.round("coverage", 6).alias("coverage"))


def _weighted(spark, sf):
    rows = Graph(spark, sf).nodes(["region", "nation", "customer"]).select("id", "type", "path", F.lit(1.0).alias("score"))
    weights = rank.weight({"nation": 0.5}, {"customer/1*": 0.8, "customer/??.md": 0.4})
    return rank.window(rows.withColumn("score", F.col("score") * weights), 50, 10, least=0.3).select("id", "score")


def _stats(spark, sf):
    chunked = Graph(spark, sf).table("documents").select("doc_id", F.size(passages.chunks(F.col("text"))).alias("n"))
    return chunked.agg(F.sum("n").alias("total"), F.max("n").alias("most"))


def _duplicates(spark, sf):
    return views.duplicates(Graph(spark, sf).table("documents"), F.col("text"))


def _dangling(spark, sf):
    g = Graph(spark, sf)
    known = g.nodes(["customer"]).where("not c_mktsegment <=> 'BUILDING'")
    return checks.dangling(expand.typed_edges(g, ["placed-by"]), known)


def _cardinality(spark, sf):
    g, kinds = Graph(spark, sf), ["contains-part", "placed-by"]
    return checks.too_many(expand.typed_edges(g, kinds), kinds, sum(map(g.size, kinds)))


def _wrong_ends(spark, sf):
    g = Graph(spark, sf)
    return checks.wrong_ends(expand.typed_edges(g, ["in-region", "in-nation"]), g.nodes(["region", "nation", "customer"]), {"in-region": ("nation", "region"), "in-nation": ("supplier", "nation")})


def _rule(spark, sf):
    g = Graph(spark, sf)
    exempt = g.nodes(["customer"]).where("c_acctbal < -900").select("id", F.lit("solvent").alias("rule"))
    return checks.rule(g, "solvent", "type=customer c_acctbal<0 c_mktsegment=BUILDING", "error", exempt)


def _versions(g: Graph):
    o = g.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    before = o.where("o_orderkey % 7 <> 0")
    after = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.expr("if(o_orderkey % 11 = 0, 'X', o_orderstatus)"))
    return before, after


def _diff(spark, sf):
    return changes.diff(*_versions(Graph(spark, sf)), "o_orderkey", ["o_orderstatus", "o_totalprice"])


def _upsert(spark, sf):
    return changes.upsert(*_versions(Graph(spark, sf)), "o_orderkey")


def _latest(spark, sf):
    e = Graph(spark, sf).table("events").select("user_id", "ts", "event_id", "event_type")
    return changes.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _workflow(spark, sf):
    o = Graph(spark, sf).table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("before"), F.expr("if(o_orderkey % 3 = 0, 'F', o_orderstatus)").alias("after"))
    return checks.transition(o, {"O": ["P"], "P": ["F"], "F": []}, ["O"]).where("error is not null").groupBy("before", "error").agg(F.count("*").alias("n"))


def _chunks(spark, sf):
    d = Graph(spark, sf).table("documents")
    return d.select("doc_id", F.posexplode(passages.chunks(F.col("text"))).alias("at", "text")).select("doc_id", "at", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("content_hash"))


def _snippets(spark, sf):
    d = Graph(spark, sf).table("documents")
    return d.select("doc_id", passages.snippets(F.col("text"), "thing").alias("snippet"))


def _page_nodes(spark, sf):
    p = Graph(spark, sf).table("pages").select(F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("source"))
    return files.parsed(p.withColumn("content_hash", F.sha2("source", 256)), "page")


def _pages(spark, sf):
    return _page_nodes(spark, sf).select("id", "title", F.length("body").alias("n_chars"), F.size("units").alias("n_units"), F.size("links").alias("n_links"))


def _page_units(spark, sf):
    return files.units_of(_page_nodes(spark, sf)).select("id", "kind", "ordinal", "parent_address", "title", "content_hash")


def _keys(spark, sf):
    p = Graph(spark, sf).table("part")
    return p.select("p_partkey", passages.heading_key(F.concat_ws("--", "p_name", "p_type")).alias("key"), passages.path_ancestors(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")))[1].alias("above"))


QUERIES = {
    "p18_relative_date": _ids("type=order o_orderdate>=today-1m o_orderstatus=O"),
    "f12_inverse_label": _ids("type=nation customers->c_acctbal>9900"),
    "r11_walk_blend": _blended(1),
    "r12_two_hops": _blended(2),
    "g13_related": _related,
    "j11_edge_view": _edge_view(expand.edge_view),
    "j14_neighbors": _edge_view(expand.neighbors),
    "g02_root": lambda spark, sf: analytics.ancestors(Graph(spark, sf).edges("parent")),
    "g02_ancestor_depth": lambda spark, sf: analytics.ancestors(Graph(spark, sf).edges("parent"), 1),
    "g04_communities": _communities,
    "g07_components": _components,
    "g10_cycles": _cycles,
    "g15_pooled_vectors": _pooled,
    "w02_top_units": _top_units,
    "x07_title_match": _title_match,
    "x38_weights_window": _weighted,
    "a07_duplicates": _duplicates,
    "a10_chunk_stats": _stats,
    "d01_dangling": _dangling,
    "d02_cardinality": _cardinality,
    "d02_edge_types": _wrong_ends,
    "d17_rule": _rule,
    "e04_workflow": _workflow,
    "m01_latest": _latest,
    "m02_diff": _diff,
    "s16_upsert": _upsert,
    "x29_chunks": _chunks,
    "x12_snippets": _snippets,
    "x15_keys": _keys,
    "s05_pages": _pages,
    "s08_page_units": _page_units,
}

_PARENTS = "p AS (SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS t FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation)"
_NEAR = """
e AS (SELECT 'order/' || o_orderkey AS s, 'customer/' || o_custkey AS t FROM orders UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer),
near AS (SELECT DISTINCT * FROM (SELECT s AS id, t AS other FROM e UNION ALL SELECT t, s FROM e)),
r0 AS (SELECT 'order/' || o_orderkey AS id, least(o_totalprice / 1e6, 1) AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
r1 AS (SELECT DISTINCT other AS id FROM near WHERE id IN (SELECT id FROM r0) AND other NOT IN (SELECT id FROM r0)),
r2 AS (SELECT DISTINCT other AS id FROM near WHERE id IN (SELECT id FROM r1) AND other NOT IN (SELECT id FROM r0) AND other NOT IN (SELECT id FROM r1)),
b AS (SELECT n.id, avg(score) AS g FROM near n JOIN r0 ON r0.id = n.other GROUP BY n.id),
s1 AS (SELECT id, 0 AS distance, score AS cos FROM r0 UNION ALL SELECT id, 1, 0 FROM r1),
l1 AS (SELECT s1.id, distance, cos, coalesce(g, 0) AS g FROM s1 LEFT JOIN b USING (id)),
l2 AS (SELECT r2.id, 2 AS distance, 0 AS cos, 0.2 * avg(l1.g) AS g FROM r2 JOIN near n ON n.id = r2.id JOIN l1 ON l1.id = n.other AND l1.distance = 1 GROUP BY r2.id)"""
_SCORED = "SELECT id, distance, round(g, 6) AS graph, round(0.8 * cos + 0.2 * g, 6) AS final FROM "
_VIEW = "SELECT 'nation/' || n_nationkey AS id, 'in' AS direction, 'in-nation' AS type, 'customer/' || c_custkey AS other, c_name AS title FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'"
_VERSIONS = "a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)"

ORACLE_SQL = {
    "p18_relative_date": "SELECT 'order/' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderstatus = 'O'",
    "f12_inverse_label": "SELECT DISTINCT 'nation/' || n_nationkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900",
    "r11_walk_blend": f"WITH {_NEAR} {_SCORED} l1",
    "r12_two_hops": f"WITH {_NEAR} {_SCORED} (SELECT * FROM l1 UNION ALL SELECT * FROM l2)",
    "g13_related": "SELECT id, 1 AS distance, 0.2::DOUBLE AS final FROM (SELECT 'customer/' || c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'region/' || n_regionkey FROM nation WHERE n_nationkey = 3)",
    "j11_edge_view": f"{_VIEW} UNION ALL SELECT 'nation/' || n_nationkey, 'out', 'in-region', 'region/' || n_regionkey, NULL FROM nation WHERE n_name = 'NATION_3'",
    "j14_neighbors": _VIEW,
    "g02_root": f"WITH {_PARENTS}, x AS (SELECT s AS id FROM p UNION SELECT t FROM p) SELECT id, coalesce(q.t, p.t, id) AS ancestor FROM x LEFT JOIN p ON p.s = id LEFT JOIN p q ON q.s = p.t",
    "g02_ancestor_depth": f"WITH {_PARENTS}, x AS (SELECT s AS id FROM p UNION SELECT t FROM p) SELECT id, coalesce(p.t, id) AS ancestor FROM x LEFT JOIN p ON p.s = id",
    "g07_components": f"WITH {_PARENTS}, x AS (SELECT s AS id FROM p UNION SELECT t FROM p), r AS (SELECT id, coalesce(q.t, p.t, id) AS c FROM x LEFT JOIN p ON p.s = id LEFT JOIN p q ON q.s = p.t) SELECT id, min(id) OVER (PARTITION BY c) AS component FROM r",
    "g10_cycles": "SELECT 'customer/' || c_custkey AS id, (SELECT min('customer/' || c_custkey) FROM customer WHERE c_custkey > 0) AS cycle FROM customer WHERE c_custkey > 0",
    "g15_pooled_vectors": "WITH m AS (SELECT label, i AS dim, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) AS t(i) GROUP BY label, i) SELECT 'label/' || label AS id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m",
    "w02_top_units": "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INT AS place, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem QUALIFY place <= 3",
    "x38_weights_window": "WITH w AS (SELECT 'region/' || r_regionkey AS id, 1.0::DOUBLE AS score FROM region UNION ALL SELECT 'nation/' || n_nationkey, 0.5 FROM nation UNION ALL SELECT 'customer/' || c_custkey, CASE WHEN c_custkey BETWEEN 10 AND 99 THEN 0.4 WHEN left(c_custkey::VARCHAR, 1) = '1' THEN 0.8 ELSE 1 END FROM customer) SELECT id, score FROM w WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 50 OFFSET 10",
    "a07_duplicates": "SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "d01_dangling": "SELECT 'error' AS severity, 'dangling-edge' AS kind, 'order/' || o_orderkey AS node_id, 'placed-by to customer/' || o_custkey AS message FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL OR c_mktsegment = 'BUILDING'",
    "d02_cardinality": "SELECT 'error' AS severity, 'edge-cardinality-violation' AS kind, 'order/' || l_orderkey AS node_id, 'contains-part has ' || count(DISTINCT l_partkey) || ' targets' AS message FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 1",
    "d02_edge_types": "SELECT 'error' AS severity, 'edge-type-violation' AS kind, 'customer/' || c_custkey AS node_id, 'in-nation to nation/' || c_nationkey AS message FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "d17_rule": "SELECT 'error' AS severity, 'rule:solvent' AS kind, 'customer/' || c_custkey AS node_id, 'type=customer c_acctbal<0 c_mktsegment=BUILDING' AS message FROM customer WHERE c_acctbal < 0 AND c_acctbal >= -900 AND c_mktsegment = 'BUILDING'",
    "e04_workflow": "SELECT o_orderstatus AS before, 'illegal-transition' AS error, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'O' GROUP BY 1",
    "m01_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "m02_diff": f"WITH {_VERSIONS} SELECT o_orderkey, CASE WHEN a.o_totalprice IS NULL THEN 'insert' WHEN b.o_totalprice IS NULL THEN 'delete' ELSE 'update' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_totalprice IS NULL OR b.o_totalprice IS NULL OR a.o_orderstatus <> b.o_orderstatus",
    "s16_upsert": f"WITH {_VERSIONS} SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
    "x15_keys": "SELECT p_partkey, trim(regexp_replace(lower(p_name || '--' || p_type), '[^\\p{L}\\p{Nd}\\p{M}]+', ' ', 'g')) AS key, p_brand || '/' || p_type AS above FROM part",
}
