"""Registered queries from what is stored: the inverted index, adjacency, lists of vectors, versioned tables; with SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loamgraph.functions.text import STOPWORDS
from loamgraph.operators import expand, rank
from loamgraph.operators.adjacency import Adjacency
from loamgraph.operators.nearest import VectorIndex
from loamgraph.operators.postings import Index
from loamgraph.operators.storage import _path, shared_dir
from loamgraph.sources.graph import Graph
from loamgraph.sources.store import Store

LEXICAL = "the thing and nation"
TAKE = 20


def _store(spark, name: str) -> Store:
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, system = _path(spark, at)
    system.deleteOnExit(path)
    return Store(spark, at)


def _texts(g: Graph):
    return g.table("documents").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id")


def _shown(found):
    return found.select(F.col("id").cast("long").alias("id"), F.round("lexical", 6).alias("lexical"))


def _indexed(take):
    def run(spark, sf):
        index = Index(_store(spark, "index"))
        index.put(_texts(Graph(spark, sf)).select("id", "text"))
        return _shown(index.search(LEXICAL, take))

    return run


def _index_changed(spark, sf):
    """Texts put in two parts, some of the first replaced by their beginning, some taken out."""
    index, docs = Index(_store(spark, "index")), _texts(Graph(spark, sf))
    index.put(docs.where("doc_id % 10 < 8").select("id", "text"))
    index.put(docs.where("doc_id % 10 = 3").select("id", F.substring("text", 1, 200).alias("text")))
    index.remove(docs.where("doc_id % 10 = 5").select("id"))
    index.put(docs.where("doc_id % 10 >= 8").select("id", "text"))
    return _shown(index.search(LEXICAL))


def _edges(g: Graph, kinds=("placed-by", "in-nation", "in-region")):
    return expand.typed_edges(g, list(kinds))


def _stored_walk(spark, sf):
    """What leads to region/2 in three steps at most."""
    stored = Adjacency.build(_edges(Graph(spark, sf)))
    return stored.reach(spark.createDataFrame([("region/2",)], "id string"), 1, 3)


def _stored_ring(spark, sf):
    stored = Adjacency.build(_edges(Graph(spark, sf), ["next"]))
    return stored.reach(spark.createDataFrame([("customer/7",)], "id string"), 2, 4)


def _stored_neighbors(spark, sf):
    g = Graph(spark, sf)
    stored = Adjacency.build(_edges(g))
    return stored.neighbors(g.nodes(["customer"]).where("c_acctbal < 0").select("id"), ["placed-by", "in-nation"]).groupBy("id", "direction", "type").agg(F.count("*").alias("n"), F.min("other").alias("first"))


def _vectors(spark, sf):
    return Graph(spark, sf).table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _listed_vectors(spark, sf):
    v = _vectors(spark, sf)
    return VectorIndex.build(v, TAKE).search(v.where("id % 100 = 0"), TAKE).select("query_id", "id", F.round("score", 5).alias("score"))


def _recall(spark, sf):
    """How the index's answers to all queries hold against the exact search."""
    v = _vectors(spark, sf)
    asked = v.where("id % 100 = 0")
    found, exact = VectorIndex.build(v, TAKE).search(asked, TAKE), rank.nearest_each(v, asked, TAKE)
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("nearest"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recalled"))


def _versions(spark, sf):
    """Four commits of orders: all of a year, a batch of changes, the same batch again, and deletions; and what each version holds."""
    store, o = _store(spark, "orders"), Graph(spark, sf).table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")

    def first(now):
        now.create("orders", "o_orderkey long, o_orderstatus string, o_totalprice double", ["o_orderkey"], 16)
        now.append("orders", o.where("o_orderkey % 7 <> 0"))

    later = o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    store.update(first, ("load", 1))
    for _ in range(2):
        store.update(lambda now: now.merge("orders", later), ("changes", 1))
    store.update(lambda now: now.merge("orders", o.where("o_orderkey % 11 = 0").withColumn("gone", F.lit(True)), "gone"), ("changes", 2))
    out = None
    for v in store.versions():
        part = store.read("orders", v).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(v).alias("version"), "o_orderstatus", "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "r04_stored_index": _indexed(None),
    "r04_block_max": _indexed(TAKE),
    "r04_index_changed": _index_changed,
    "j10_stored_walk": _stored_walk,
    "j04_stored_ring": _stored_ring,
    "s12_stored_neighbors": _stored_neighbors,
    "r25_vector_lists": _listed_vectors,
    "r25_recall": _recall,
    "s16_versions": _versions,
}

_BM25 = f"""
w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+')) AS w FROM docs),
f AS (SELECT doc_id, w FROM w WHERE w <> '' AND w NOT IN ({", ".join(f"'{s}'" for s in STOPWORDS)})),
c AS (SELECT doc_id, CASE {" ".join(f"WHEN w LIKE '%{s}' AND strlen(w) - {len(s)} >= 3 THEN left(w, length(w) - {len(s)})" for s in "ingly edly ing ers er ed ly es s".split())} ELSE w END AS w FROM f),
t AS (SELECT doc_id, CASE WHEN w LIKE '%e' AND strlen(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS w FROM c),
n AS (SELECT d.doc_id, count(t.w)::DOUBLE AS n FROM docs d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id),
g AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM n),
h AS (SELECT doc_id, w, count(*)::DOUBLE AS f FROM t WHERE w IN ('thing', 'nation') GROUP BY doc_id, w),
df AS (SELECT w, count(*)::DOUBLE AS df FROM h GROUP BY w),
s AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS raw FROM h JOIN df USING (w) JOIN n USING (doc_id) CROSS JOIN g GROUP BY doc_id)
SELECT doc_id AS id, round(raw / max(raw) OVER (), 6) AS lexical FROM s"""

ORACLE_SQL = {
    "r04_stored_index": f"WITH docs AS (SELECT doc_id, text FROM documents), {_BM25}",
    "r04_block_max": f"WITH docs AS (SELECT doc_id, text FROM documents), {_BM25} ORDER BY raw DESC, doc_id::VARCHAR LIMIT {TAKE}",
    "r04_index_changed": f"WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN substr(text, 1, 200) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 5), {_BM25}",
    "j10_stored_walk": "WITH c AS (SELECT c_custkey, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2) SELECT 'nation/' || n_nationkey AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'customer/' || c_custkey FROM c UNION ALL SELECT 'order/' || o_orderkey FROM orders JOIN c ON c_custkey = o_custkey",
    "j04_stored_ring": "SELECT 'customer/' || k AS id FROM (SELECT DISTINCT ((6 - s + (SELECT max(c_custkey) FROM customer)) % (SELECT max(c_custkey) FROM customer) + 1)::BIGINT AS k FROM (SELECT unnest([2, 3, 4]) AS s))",
    "s12_stored_neighbors": "WITH c AS (SELECT * FROM customer WHERE c_acctbal < 0) SELECT 'customer/' || c_custkey AS id, 'out' AS direction, 'in-nation' AS type, count(*) AS n, min('nation/' || c_nationkey) AS first FROM c WHERE c_nationkey IS NOT NULL GROUP BY 1 UNION ALL SELECT 'customer/' || c_custkey, 'in', 'placed-by', count(*), min('order/' || o_orderkey) FROM c JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "r25_recall": f"SELECT count(*) AS queries, count(*) * least({TAKE}, (SELECT count(*) FROM embeddings)) AS nearest, true AS recalled FROM embeddings WHERE vec_id % 100 = 0",
    "s16_versions": """WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0),
v AS (SELECT 1 AS version, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM b WHERE o_orderkey % 11 <> 0)
SELECT version, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM v GROUP BY version, o_orderstatus""",
}
