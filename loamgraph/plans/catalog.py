"""The registered queries over the test tables, and their equivalents in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loamgraph.functions import scalars
from loamgraph.functions.text import STOPWORDS
from loamgraph.operators import aggregate, rank
from loamgraph.plans import catalog_changes, catalog_graph, catalog_hybrid, catalog_stored, catalog_time, catalog_views
from loamgraph.plans.filter import query
from loamgraph.sources.graph import Graph

FLAGSHIP = "f_chain_sorted"
EVENTS_NOW = datetime(2024, 1, 31)
LEXICAL = "the thing and nation"


def _ids(text: str, **window):
    return lambda spark, sf: query(Graph(spark, sf), text, **window).select("id")


def _status(spark, sf):
    return Graph(spark, sf).nodes().groupBy("type").agg(F.count("*").alias("n"))


def _flagship(spark, sf):
    text = 'type=order o_orderstatus=O o_totalprice>100000 placed-by->in-nation->title="NATION_1"'
    return query(Graph(spark, sf), text, sort="-o_totalprice", take=20).select("id", "o_totalprice")


def _bm25(spark, sf):
    docs = Graph(spark, sf).table("documents").select(F.col("doc_id").alias("id"), "text")
    return rank.bm25(docs, LEXICAL).where("lexical > 0").select("id", F.round("lexical", 6).alias("lexical"))


def _regex(spark, sf):
    return Graph(spark, sf).table("part").where(scalars.regexp("^(small|large) .*e", F.col("p_name"))).select("p_partkey")


def _cosine(spark, sf):
    vectors = Graph(spark, sf).table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    first = vectors.where("id = 0").first()
    return rank.nearest(vectors, list(first.vector), 20).select("id", F.round("score", 5).alias("score"))


def _cosine_all(spark, sf):
    """The search of every row whose id is divisible by 100."""
    vectors = Graph(spark, sf).table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rank.nearest_each(vectors, vectors.where("id % 100 = 0"), 20).select("query_id", "id", F.round("score", 5).alias("score"))


QUERIES = {
    FLAGSHIP: _flagship,
    "a05_status": _status,
    "p05_typed_range": _ids('type=order o_totalprice=100000..200000 o_orderpriority>=3'),
    "p03_not_null_false": _ids("type=customer NOT c_mktsegment=BUILDING"),
    "p07_presence": _ids("p_size=*"),
    "p08_list_item": _ids("type=part words~=red"),
    "p09_list_holds": _ids("type=part words=[small, widget]"),
    "p09_list_lacks": _ids("type=part words!=[small, widget]"),
    "p05_untyped": _ids("type=event k>50 k<=80"),
    "p05_untyped_text": _ids('type=event k="7" OR type=event k!=7 user_id<20'),
    "p11_bool": _ids("type=order urgent=true o_totalprice>200000"),
    "p14_regex": _regex,
    "p15_modified_since": lambda spark, sf: query(Graph(spark, sf, EVENTS_NOW), "type=event modified-since=36h").select("id"),
    "p15_modified_on": _ids("modified-since=2001-06-01 type=order"),
    "p17_datetime": _ids("type=event at>=2024-01-20T12:00:00Z"),
    "p20_names_path": _ids("type=page names-path=the/inner"),
    "p21_names_glob": _ids("names-path:mentions=th*"),
    "p21_names_not": _ids("type=page names-path!=th*"),
    "p12_any_property": _ids("s_acctbal>9000 OR label=3"),
    "j09_inverse": _ids("nations->title=NATION_3"),
    "j07_max_depth": _ids("tree:places=region/1"),
    "t01_enum_sorted": lambda spark, sf: query(Graph(spark, sf), "type=order o_totalprice>150000", sort="o_orderpriority,-o_totalprice", take=30, skip=5).select("id"),
    "a01_count": lambda spark, sf: query(Graph(spark, sf), "type=order o_orderstatus=F placed-by->c_mktsegment=BUILDING", files_only=True).agg(F.count("*").alias("n")),
    "a02_group_by_json": lambda spark, sf: aggregate.count_by_json(query(Graph(spark, sf), "type=event"), "k"),
    "p13_path_glob": _ids("path=customer/1?.md OR path=nation/**"),
    "j01_edge_probe": _ids("type=customer placed-by<-"),
    "j02_edge_to_node": _ids("type=order placed-by->c_acctbal<0"),
    "j02_or_mark": _ids("type=customer (c_acctbal>9000 OR in-nation->title=NATION_3)"),
    "j03_anti_join": _ids("type=order NOT placed-by->c_acctbal<9000"),
    "j04_unbounded_walk": _ids("parent->+id=region/2"),
    "j04_bounded_walk": _ids("next->{2,4}id=customer/7"),
    "j06_parent": _ids("parent=nation/3"),
    "j07_tree": _ids("tree=region/1"),
    "j08_root": _ids("root=nation/3"),
    "a02_group_by": lambda spark, sf: aggregate.count_by(query(Graph(spark, sf), "type=order"), "o_orderpriority"),
    "a02_group_by_list": lambda spark, sf: aggregate.count_by(query(Graph(spark, sf), "type=part"), "words"),
    "a13_degree": lambda spark, sf: aggregate.degrees(Graph(spark, sf).edges("placed-by").union(Graph(spark, sf).edges("in-nation"))),
    "r04_bm25": _bm25,
    "r05_cosine": _cosine,
    "r05_cosine_all": _cosine_all,
} | catalog_graph.QUERIES | catalog_hybrid.QUERIES | catalog_views.QUERIES | catalog_stored.QUERIES | catalog_time.QUERIES | catalog_changes.QUERIES

_MENTIONS = "m AS (SELECT DISTINCT 'page/' || page_id AS id, trim(unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)), '/') AS target FROM pages)"
_TOKENS = f"""
w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+')) AS w FROM documents),
f AS (SELECT doc_id, w FROM w WHERE w <> '' AND w NOT IN ({", ".join(f"'{s}'" for s in STOPWORDS)})),
c AS (SELECT doc_id, CASE {" ".join(f"WHEN w LIKE '%{s}' AND strlen(w) - {len(s)} >= 3 THEN left(w, length(w) - {len(s)})" for s in "ingly edly ing ers er ed ly es s".split())} ELSE w END AS w FROM f),
t AS (SELECT doc_id, CASE WHEN w LIKE '%e' AND strlen(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS w FROM c)"""

_TITLES = _TOKENS.replace("SELECT doc_id, unnest", "SELECT p_partkey AS doc_id, unnest").replace("coalesce(text, '')", "coalesce(p_name, '')").replace("FROM documents", "FROM part")
_NAMED = "count(DISTINCT w) FILTER (w IN ('small', 'green', 'thing'))"

ORACLE_SQL = {
    FLAGSHIP: "SELECT 'order/' || o_orderkey AS id, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND n_name = 'NATION_1' ORDER BY o_totalprice DESC, 'order/' || o_orderkey LIMIT 20",
    "a05_status": "SELECT 'region' AS type, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'doc', count(*) FROM documents UNION ALL SELECT 'event', count(*) FROM events UNION ALL SELECT 'page', count(*) FROM pages UNION ALL SELECT 'vec', count(*) FROM embeddings",
    "p05_typed_range": "SELECT 'order/' || o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')",
    "p03_not_null_false": "SELECT 'customer/' || c_custkey AS id FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'",
    "p07_presence": "SELECT 'part/' || p_partkey AS id FROM part WHERE p_size IS NOT NULL",
    "p08_list_item": "SELECT 'part/' || p_partkey AS id FROM part WHERE list_contains(string_split(p_name, ' '), 'red')",
    "p09_list_holds": "SELECT 'part/' || p_partkey AS id FROM part WHERE list_has_all(string_split(p_name, ' '), ['small', 'widget'])",
    "p09_list_lacks": "SELECT 'part/' || p_partkey AS id FROM part WHERE NOT coalesce(list_has_all(string_split(p_name, ' '), ['small', 'widget']), false)",
    "p05_untyped": "SELECT 'event/' || event_id AS id FROM events WHERE (props->>'$.k')::BIGINT > 50 AND (props->>'$.k')::BIGINT <= 80",
    "p05_untyped_text": "SELECT 'event/' || event_id AS id FROM events WHERE user_id < 20",
    "p11_bool": "SELECT 'order/' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000",
    "p14_regex": "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(small|large) .*e')",
    "p15_modified_since": "SELECT 'event/' || event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'",
    "p15_modified_on": "SELECT 'order/' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01'",
    "p17_datetime": "SELECT 'event/' || event_id AS id FROM events WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-20 12:00:00'",
    "p20_names_path": f"WITH {_MENTIONS} SELECT DISTINCT id FROM m WHERE target IN ('the', 'the/inner')",
    "p21_names_glob": f"WITH {_MENTIONS} SELECT DISTINCT id FROM m WHERE regexp_matches(target, '^th[^/]*$')",
    "p21_names_not": f"WITH {_MENTIONS} SELECT 'page/' || page_id AS id FROM pages WHERE 'page/' || page_id NOT IN (SELECT id FROM m WHERE regexp_matches(target, '^th[^/]*$'))",
    "p12_any_property": "SELECT 'supplier/' || s_suppkey AS id FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT 'vec/' || vec_id FROM embeddings WHERE label = 3",
    "j09_inverse": "SELECT DISTINCT 'region/' || n_regionkey AS id FROM nation WHERE n_name = 'NATION_3'",
    "j07_max_depth": "SELECT 'nation/' || n_nationkey AS id FROM nation WHERE n_regionkey = 1",
    "t01_enum_sorted": "SELECT 'order/' || o_orderkey AS id FROM orders WHERE o_totalprice > 150000 ORDER BY o_orderpriority, o_totalprice DESC, 'order/' || o_orderkey LIMIT 30 OFFSET 5",
    "a01_count": "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'",
    "a02_group_by_json": "SELECT props->>'$.k' AS value, count(*) AS n FROM events GROUP BY 1",
    "p13_path_glob": "SELECT 'customer/' || c_custkey AS id FROM customer WHERE c_custkey BETWEEN 10 AND 19 UNION ALL SELECT 'nation/' || n_nationkey FROM nation",
    "j01_edge_probe": "SELECT DISTINCT 'customer/' || c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey",
    "j02_edge_to_node": "SELECT 'order/' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0",
    "j02_or_mark": "SELECT 'customer/' || c_custkey AS id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 OR coalesce(n_name = 'NATION_3', false)",
    "j03_anti_join": "SELECT 'order/' || o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 9000)",
    "j04_unbounded_walk": "SELECT 'nation/' || n_nationkey AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'customer/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2",
    "j04_bounded_walk": "SELECT 'customer/' || k AS id FROM (SELECT DISTINCT ((6 - s + (SELECT max(c_custkey) FROM customer)) % (SELECT max(c_custkey) FROM customer) + 1)::BIGINT AS k FROM (SELECT unnest([2, 3, 4]) AS s))",
    "j06_parent": "SELECT 'customer/' || c_custkey AS id FROM customer WHERE c_nationkey = 3",
    "j07_tree": "SELECT 'nation/' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1",
    "j08_root": "WITH r AS (SELECT n_regionkey AS k FROM nation WHERE n_nationkey = 3) SELECT 'region/' || k AS id FROM r UNION ALL SELECT 'nation/' || n_nationkey FROM nation JOIN r ON n_regionkey = k UNION ALL SELECT 'customer/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN r ON n_regionkey = k",
    "a02_group_by": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1",
    "a02_group_by_list": "SELECT value, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1",
    "a13_degree": "WITH e AS (SELECT 'order/' || o_orderkey AS s, 'customer/' || o_custkey AS t FROM orders UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer) SELECT id, count(*) AS degree, sum(i)::BIGINT AS in_degree FROM (SELECT s AS id, 0 AS i FROM e UNION ALL SELECT t, 1 FROM e) GROUP BY id",
    "r04_bm25": f"WITH {_TOKENS}, "
    "n AS (SELECT d.doc_id, count(t.w)::DOUBLE AS n FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id), "
    "g AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM n), "
    "h AS (SELECT doc_id, w, count(*)::DOUBLE AS f FROM t WHERE w IN ('thing', 'nation') GROUP BY doc_id, w), "
    "df AS (SELECT w, count(*)::DOUBLE AS df FROM h GROUP BY w), "
    "s AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS raw FROM h JOIN df USING (w) JOIN n USING (doc_id) CROSS JOIN g GROUP BY doc_id) "
    "SELECT doc_id AS id, round(raw / max(raw) OVER (), 6) AS lexical FROM s",
    "x07_title_match": f"WITH {_TITLES} SELECT 'part/' || doc_id AS id, round({_NAMED}::DOUBLE / count(DISTINCT w), 6) AS coverage FROM t GROUP BY doc_id HAVING {_NAMED} > 0",
    "r05_cosine": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(v, q), 5) AS score FROM v, q ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 20",
    "r05_cosine_all": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.v, q.v) AS c FROM v, v q WHERE q.vec_id % 100 = 0) SELECT query_id, id, round(c, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= 20",
} | catalog_graph.ORACLE_SQL | catalog_hybrid.ORACLE_SQL | catalog_views.ORACLE_SQL | catalog_stored.ORACLE_SQL | catalog_time.ORACLE_SQL | catalog_changes.ORACLE_SQL
