"""Registered queries of writes, links, details, checks and labels over the test tables, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import analytics, expand, mutate, views
from loamgraph.plans import checks, service
from loamgraph.sources import files
from loamgraph.sources.graph import Graph


def _places(g: Graph) -> tuple[DataFrame, DataFrame]:
    edges = expand.typed_edges(g, ["in-region", "in-nation"])
    return g.nodes(["region", "nation", "customer"]), edges.withColumns({"kind": F.lit("direct"), "position": F.lit(1)})


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("type", "source", "target")


def _created(spark, sf):
    """A new nation for each region."""
    nodes, edges = _places(Graph(spark, sf))
    new = nodes.where("type = 'region'").withColumns({"_r": F.col("id"), "id": F.concat(F.lit("nation/9"), F.substring_index("id", "/", -1)), "type": F.lit("nation")})
    leads = new.select(F.lit("in-region").alias("type"), F.col("id").alias("source"), F.col("_r").alias("target"), F.lit("direct").alias("kind"), F.lit(1).alias("position"))
    return _plain(mutate.written(nodes, edges, new.drop("_r"), leads, create=True)[1])


def _modified(spark, sf):
    """The nations of region/1 go to region/2, under other titles."""
    nodes, edges = _places(Graph(spark, sf))
    some = edges.where("type = 'in-region' and target = 'region/1'")
    new = nodes.join(some.select(F.col("source").alias("id")), "id", "left_semi").withColumn("title", F.lower("title"))
    out, leads = mutate.written(nodes, edges, new, some.withColumn("target", F.lit("region/2")))
    return out.where("type = 'nation'").join(leads.select(F.col("source").alias("id"), "target"), "id").select("id", "title", "target")


def _deleted(spark, sf):
    """The nations of region/3 are gone: what is left of nations and of edges, and whose references to look up again."""
    nodes, edges = _places(Graph(spark, sf))
    edges = edges.withColumn("kind", F.when(F.col("type") == "in-nation", "derived").otherwise("direct"))
    gone = edges.where("type = 'in-region' and target = 'region/3'").select(F.col("source").alias("id"))
    left, leads, again = mutate.delete(nodes, edges, gone)
    parts = [("node", left.where("type = 'nation'")), ("edge", leads.where("type = 'in-region'").select(F.col("source").alias("id"))), ("again", again)]
    rows = [df.select(F.lit(name).alias("what"), "id") for name, df in parts]
    return rows[0].union(rows[1]).union(rows[2])


def _edge_set(spark, sf):
    """nation/1 leaves its region for region/2."""
    g = Graph(spark, sf)
    nodes, edges = _places(g)
    now = edges.where("source = 'nation/1'").first().target
    moved = mutate.remove_edge(edges, "in-region", "nation/1", now)
    return _plain(mutate.add_edge(nodes, moved, "in-region", "nation/1", "region/2", g.manifest)).where("type = 'in-region'")


def _front(spark, sf):
    g = Graph(spark, sf)
    c = g.table("customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.create_map(F.lit("in-nation"), F.array(F.concat(F.lit("nation/"), "c_nationkey"), F.lit("nation/0")), F.lit("segment"), F.array("c_mktsegment")).alias("props"))
    left, edges = mutate.front_edges(c, "props", g.manifest)
    return edges.join(left.select(F.col("id").alias("source"), F.map_keys("props")[0].alias("stays")), "source").select("type", "source", "target", "position", "stays")


def _links(spark, sf):
    lines = Graph(spark, sf).table("lineitem").select(F.concat(F.lit("order/"), "l_orderkey").alias("source"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("part/"), "l_partkey")).alias("target"), F.col("l_linenumber").alias("position"))
    return _plain(mutate.link_edges(lines, ["mentions", "uses"]))


def _units(g: Graph) -> DataFrame:
    file = F.concat(F.lit("order/"), "l_orderkey")
    once = g.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return once.select(F.concat(file, F.lit("#L"), "l_linenumber").alias("id"), F.lit("line").alias("type"), file.alias("parent_id"), F.col("l_linenumber").alias("ordinal"), "part")


def _contains(spark, sf):
    return mutate.contains(_units(Graph(spark, sf))).select("source", "target", "kind", "position")


def _fold(spark, sf):
    units = _units(Graph(spark, sf))
    edges = units.select(F.lit("uses").alias("type"), F.col("id").alias("source"), F.concat(F.lit("part/"), "part").alias("target"), F.lit("direct").alias("kind")).union(mutate.contains(units).select("type", "source", "target", "kind"))
    return views.edge_list(edges, kinds=["uses", "contains"]).select("type", "source", "target", F.size("units").alias("n"), F.get("units", F.lit(0)).alias("first"))


def _detail(spark, sf):
    nodes, edges = _places(Graph(spark, sf))
    got = views.detail(nodes, _plain(edges), nodes.where("type = 'nation'").select("id"))
    return got.select("id", F.explode("neighbors").alias("n")).select("id", "n.direction", "n.other", F.col("n.title").alias("other_title"))


def _reading(spark, sf):
    nodes = Graph(spark, sf).nodes(["region", "nation", "supplier"]).select("id", "type", "path", "title", F.lit(None).cast("string").alias("parent_id"))
    return views.reading_index(nodes)


def _link_map(spark, sf):
    """Customers' links: some resolved, some by a nation's title, some nowhere."""
    g = Graph(spark, sf)
    link = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat(' nation_', c_nationkey) WHEN 1 THEN 'elsewhere' ELSE 'known' END")
    links = g.table("customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("source"), link.alias("link"), F.when(F.col("c_custkey") % 3 == 2, F.lit("region/1")).alias("target"))
    return views.link_map(links, g.nodes(["nation", "region"]).withColumn("parent_id", F.lit(None).cast("string")))


def _resolved(spark, sf):
    """Pages of customers in folders of nations: links by a name, relative ones, and names that two files or none have."""
    c = Graph(spark, sf).table("customer").where("c_nationkey is not null")
    at = lambda name: F.concat(F.lit("n"), "c_nationkey", F.lit("/"), name)
    me = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    links = F.array(F.concat(F.lit("C"), (F.col("c_custkey") + 1).cast("string")), F.concat(F.lit("./"), me, F.lit(".md")), F.lit("../../out"), F.lit("Index"))
    pages = c.select(at(me).alias("id"), F.concat(at(me), F.lit(".md")).alias("path"), links.alias("links"))
    index = c.select(at(F.lit("index")).alias("id"), F.concat(at(F.lit("index")), F.lit(".md")).alias("path")).distinct().withColumn("links", F.array().cast("array<string>"))
    nodes = pages.unionByName(index).withColumns({"body": F.lit(""), "units": F.array().cast(files.UNITS)})
    return files.resolved(nodes).select("source", "link", "target", "state")


def _listed(spark, sf):
    return service.run(Graph(spark, sf), service.Request("type=customer c_acctbal<0", sort="-c_acctbal", take=25, skip=5)).select("id", "title")


def _got(spark, sf):
    return service.get(Graph(spark, sf), "nation/3", ("properties",)).select("id", "type", "title")


def _failures(spark, sf):
    o = Graph(spark, sf).table("orders").where("o_orderkey % 5 = 0")
    return checks.embed_failures(o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("h").alias("content_hash"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.lit("e").alias("error"))).select("severity", "kind", "node_id")


def _chunk_issues(spark, sf):
    d = Graph(spark, sf).table("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("id"), F.col("text").alias("body"), "doc_id")
    none = checks.without_chunks(d.select("id"), d.where("doc_id % 3 <> 0").select("id"), d.where("doc_id % 2 = 0").select("id"))
    return none.select("severity", "kind", "node_id").union(checks.large_chunks(d.select("id", "body"), 8000).select("severity", "kind", "node_id"))


def _exemptions(spark, sf):
    c = Graph(spark, sf).table("customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.lit("solvent").alias("rule"), "c_acctbal", "c_custkey")
    return checks.unused_exemptions(c.where("c_custkey % 4 = 0").select("id", "rule"), c.where("c_acctbal < 0").select("id", "rule")).select("kind", "node_id")


def _legacy(spark, sf):
    edges = expand.typed_edges(Graph(spark, sf), ["in-region", "placed-by"])
    return checks.legacy_edges(edges, {"in-region": "legacy-cli-edge"}).groupBy("kind").agg(F.count("*").alias("n"))


def _labels(spark, sf):
    """Nations as communities now, and the segments that customers were labelled by."""
    c = Graph(spark, sf).table("customer").where("c_nationkey is not null").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"), F.concat(F.lit("nation/"), "c_nationkey").alias("community"), F.col("c_mktsegment").alias("label"))
    return analytics.keep_labels(c.select("id", "community"), c.select("id", "label")).select("community", "label").distinct()


def _closing(spark, sf):
    """Whether some edges would close a cycle: one from a region back to a customer, and two that lead nowhere new."""
    g = Graph(spark, sf)
    edges = expand.typed_edges(g, ["in-nation", "in-region"])
    pairs = [("region/1", "customer/1"), ("nation/1", "region/0"), ("customer/2", "customer/3")]
    return spark.createDataFrame([(a, b, analytics.closes_cycle(edges, a, b)) for a, b in pairs], "source string, target string, closes boolean")


QUERIES = {
    "v01_created": _created,
    "v02_modified": _modified,
    "v05_deleted": _deleted,
    "v06_edge_set": _edge_set,
    "v10_front_edges": _front,
    "v08_link_edges": _links,
    "v11_contains": _contains,
    "j12_folded": _fold,
    "y01_detail": _detail,
    "y04_reading": _reading,
    "y06_link_map": _link_map,
    "j15_resolved": _resolved,
    "y09_node": _got,
    "y10_list": _listed,
    "d10_failures": _failures,
    "d11_chunks": _chunk_issues,
    "d18_exemptions": _exemptions,
    "d19_legacy": _legacy,
    "g09_labels": _labels,
    "g12_closing": _closing,
}

_E = "e AS (SELECT 'in-region' AS type, 'nation/' || n_nationkey AS source, 'region/' || n_regionkey AS target FROM nation UNION ALL SELECT 'in-nation', 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer WHERE c_nationkey IS NOT NULL)"
_U = "u AS (SELECT 'order/' || l_orderkey AS file, 'order/' || l_orderkey || '#L' || l_linenumber AS id, l_linenumber AS ordinal, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber)"

ORACLE_SQL = {
    "v01_created": f"WITH {_E} SELECT * FROM e UNION ALL SELECT 'in-region', 'nation/9' || r_regionkey, 'region/' || r_regionkey FROM region",
    "v02_modified": "SELECT 'nation/' || n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS title, 'region/' || CASE WHEN n_regionkey = 1 THEN 2 ELSE n_regionkey END AS target FROM nation",
    "v05_deleted": "SELECT 'node' AS what, 'nation/' || n_nationkey AS id FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 'edge', 'nation/' || n_nationkey FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 'again', 'customer/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3",
    "v06_edge_set": "SELECT 'in-region' AS type, 'nation/' || n_nationkey AS source, 'region/' || CASE WHEN n_nationkey = 1 THEN 2 ELSE n_regionkey END AS target FROM nation",
    "v10_front_edges": "SELECT 'in-nation' AS type, 'customer/' || c_custkey AS source, unnest(['nation/' || c_nationkey, 'nation/0']) AS target, unnest([1, 2])::INT AS position, 'segment' AS stays FROM customer",
    "v08_link_edges": "SELECT DISTINCT t AS type, 'order/' || l_orderkey AS source, 'part/' || l_partkey AS target FROM lineitem, unnest(['mentions', 'uses']) AS x(t) WHERE l_partkey % 3 > 0",
    "v11_contains": f"WITH {_U} SELECT file AS source, id AS target, 'structural' AS kind, ordinal AS position FROM u",
    "j12_folded": f"WITH {_U} SELECT 'uses' AS type, file AS source, 'part/' || part AS target, count(*)::INT AS n, min(id) AS first FROM u GROUP BY file, part",
    "y01_detail": f"WITH {_E}, n AS (SELECT 'region/' || r_regionkey AS id, r_name AS title FROM region UNION ALL SELECT 'customer/' || c_custkey, c_name FROM customer) SELECT source AS id, 'out' AS direction, target AS other, title AS other_title FROM e JOIN n ON n.id = target WHERE type = 'in-region' UNION ALL SELECT target, 'in', source, title FROM e JOIN n ON n.id = source WHERE type = 'in-nation'",
    "y04_reading": "SELECT 'region/' || r_regionkey AS id, 'region' AS type, 'region/' || r_regionkey || '.md' AS path, r_name AS title FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'nation', 'nation/' || n_nationkey || '.md', n_name FROM nation UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', 'supplier/' || s_suppkey || '.md', s_name FROM supplier",
    "y06_link_map": "SELECT 'customer/' || c_custkey AS source, CASE c_custkey % 3 WHEN 0 THEN ' nation_' || c_nationkey WHEN 1 THEN 'elsewhere' ELSE 'known' END AS link, CASE c_custkey % 3 WHEN 0 THEN 'nation/' || c_nationkey WHEN 2 THEN 'region/1' END AS target FROM customer",
    "j15_resolved": """WITH p AS (SELECT c_custkey AS k, 'n' || c_nationkey || '/c' || c_custkey AS id FROM customer WHERE c_nationkey IS NOT NULL), n AS (SELECT count(DISTINCT c_nationkey) AS n, min('n' || c_nationkey || '/index') AS one FROM customer WHERE c_nationkey IS NOT NULL)
SELECT p.id AS source, 'C' || (p.k + 1) AS link, coalesce(q.id, 'C' || (p.k + 1)) AS target, CASE WHEN q.id IS NULL THEN 'dangling' ELSE 'found' END AS state FROM p LEFT JOIN p q ON q.k = p.k + 1
UNION ALL SELECT id, './c' || k || '.md', id, 'found' FROM p UNION ALL SELECT id, '../../out', '../../out', 'dangling' FROM p
UNION ALL SELECT id, 'Index', CASE WHEN n = 1 THEN one ELSE 'Index' END, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END FROM p, n""",
    "y09_node": "SELECT 'nation/3' AS id, 'nation' AS type, n_name AS title FROM nation WHERE n_nationkey = 3",
    "y10_list": "SELECT 'customer/' || c_custkey AS id, c_name AS title FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal DESC, 'customer/' || c_custkey LIMIT 25 OFFSET 5",
    "d10_failures": "SELECT CASE WHEN o_orderkey % 4 >= 3 THEN 'warning' ELSE 'warning' END AS severity, CASE WHEN o_orderkey % 4 >= 3 THEN 'embed-failed' ELSE 'embed-retry' END AS kind, o_orderkey::VARCHAR AS node_id FROM orders WHERE o_orderkey % 5 = 0",
    "d11_chunks": "SELECT 'warning' AS severity, 'embed-no-chunks' AS kind, 'doc/' || doc_id AS node_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0 UNION ALL SELECT 'advice', 'embed-large-chunk', 'doc/' || doc_id FROM documents WHERE strlen(text) > 8000",
    "d18_exemptions": "SELECT 'rule-ignore-unused' AS kind, 'customer/' || c_custkey AS node_id FROM customer WHERE c_custkey % 4 = 0 AND c_acctbal >= 0",
    "d19_legacy": "SELECT 'legacy-cli-edge' AS kind, count(*) AS n FROM nation",
    "g09_labels": """WITH v AS (SELECT 'nation/' || c_nationkey AS community, c_mktsegment AS label, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1, 2),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, label) = 1), w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, community) = 1)
SELECT DISTINCT v.community, coalesce(w.label, v.community) AS label FROM v LEFT JOIN w USING (community)""",
    "g12_closing": "SELECT 'region/1' AS source, 'customer/1' AS target, EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1 AND n_regionkey = 1) AS closes UNION ALL SELECT 'nation/1', 'region/0', false UNION ALL SELECT 'customer/2', 'customer/3', false",
}
