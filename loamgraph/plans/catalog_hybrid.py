"""Registered hybrid queries over documents and vectors, with SQL equivalents.

A document is a file of two leaves, its first 400 characters and the rest; the vectors of the table belong to them by number.
One document in ten has leaves of an older model only and falls back to a chunk of its own, and leaves of even documents lie
in a section.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.functions.text import STOPWORDS
from loamgraph.operators import expand, hybrid
from loamgraph.plans.filter import query
from loamgraph.sources.graph import Graph
from loamgraph.sources.manifest import Expansion

TEXT = "the thing and nation"
SETTINGS = hybrid.Settings(lexical_weight=0.5, title_weight=0.3, path_weights={"doc/1*": 0.8}, take=10, most_units=2)


def _corpus(spark, sf):
    g = Graph(spark, sf)
    docs = g.table("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("file"), "doc_id", "lang", "text")
    vectors = g.table("embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    known = docs.select(F.col("file").alias("id"), F.lit("doc").alias("type"), F.concat("file", F.lit(".md")).alias("path"), F.concat("lang", F.lit(" "), F.substring("text", 1, 40)).alias("title"))
    leaf = lambda n, body, shift: F.struct(F.lit(n).alias("ordinal"), body.alias("body"), (F.col("doc_id") + shift).alias("vec_id"))
    rest = F.substr("text", F.lit(401))
    leaves = docs.select("file", "doc_id", F.explode(F.array(leaf(1, F.substring("text", 1, 400), 0), leaf(2, rest, 100))).alias("l")).select("file", "doc_id", "l.*")
    leaves = leaves.select(
        F.concat("file", F.lit("#P"), "ordinal").alias("id"), F.lit(0).alias("chunk"), "ordinal", F.when(F.col("doc_id") % 2 == 0, F.concat("file", F.lit("#S1"))).alias("parent"),
        "body", F.col("vec_id").alias("vec"), F.when(F.col("doc_id") % 10 == 9, "old").otherwise("new").alias("model"),
    )
    whole = docs.select(F.col("file").alias("id"), F.lit(0).alias("chunk"), F.col("text").alias("body"), F.col("doc_id").alias("vec"), F.lit("new").alias("model"))
    sections = docs.where("doc_id % 2 = 0").select(F.concat("file", F.lit("#S1")).alias("id"))
    asked = list(vectors.where("vec_id = 0").first().vector)
    return g, docs, known, hybrid.candidates(query(g, "type=doc lang=en"), leaves, whole, "new", vectors.withColumnRenamed("vec_id", "vec")), sections, asked


def _hybrid(spread: bool):
    def run(spark, sf):
        g, docs, known, chunks, sections, asked = _corpus(spark, sf)
        near = expand.both_ways(docs.select(F.col("file").alias("source"), F.concat(F.lit("doc/"), F.col("doc_id") + 1).alias("target")))
        settings = hybrid.Settings(**{**SETTINGS.__dict__, "expansion": Expansion(enabled=spread, multiplier=2)})
        found = hybrid.search(query(g, "type=doc lang=en"), chunks, TEXT, asked, settings, near, known, sections)
        top = F.get("units", F.lit(0))
        return found.select("id", F.round("score", 6).alias("score"), "units_total", top["id"].alias("unit"), "distance", F.round("lexical", 6).alias("lexical"), F.round("coverage", 6).alias("coverage"))

    return run


QUERIES = {"r01_hybrid": _hybrid(False), "r07_hybrid_spread": _hybrid(True)}

_RANKED = f"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0),
leaf AS (SELECT doc_id, 'doc/' || doc_id AS file, 'doc/' || doc_id || '#P1' AS node, 1 AS ordinal, substr(text, 1, 400) AS body, doc_id AS vec FROM documents WHERE lang = 'en' AND doc_id % 10 <> 9
  UNION ALL SELECT doc_id, 'doc/' || doc_id, 'doc/' || doc_id || '#P2', 2, substr(text, 401), doc_id + 100 FROM documents WHERE lang = 'en' AND doc_id % 10 <> 9
  UNION ALL SELECT doc_id, 'doc/' || doc_id, 'doc/' || doc_id, 0, text, doc_id FROM documents WHERE lang = 'en' AND doc_id % 10 = 9),
c AS (SELECT leaf.*, CASE WHEN doc_id % 2 = 0 THEN file || '#S1' ELSE node END AS unit, list_cosine_similarity(v.v, q.q) AS cosine FROM leaf JOIN v ON vec_id = vec, q),
src AS (SELECT 'l' || node AS rid, body AS text FROM c UNION ALL SELECT 't' || 'doc/' || doc_id, coalesce(lang || ' ' || substr(text, 1, 40), doc_id::VARCHAR) FROM documents),
tw AS (SELECT rid, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+')) AS w FROM src),
tf AS (SELECT rid, w FROM tw WHERE w <> '' AND w NOT IN ({", ".join(f"'{s}'" for s in STOPWORDS)})),
tc AS (SELECT rid, CASE {" ".join(f"WHEN w LIKE '%{s}' AND strlen(w) - {len(s)} >= 3 THEN left(w, length(w) - {len(s)})" for s in "ingly edly ing ers er ed ly es s".split())} ELSE w END AS w FROM tf),
t AS (SELECT rid, CASE WHEN w LIKE '%e' AND strlen(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS w FROM tc),
n AS (SELECT 'l' || node AS rid, count(t.w)::DOUBLE AS n FROM c LEFT JOIN t ON t.rid = 'l' || node GROUP BY 1),
g AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM n),
h AS (SELECT rid, w, count(*)::DOUBLE AS f FROM t WHERE rid LIKE 'l%' AND w IN ('thing', 'nation') GROUP BY rid, w),
df AS (SELECT w, count(*)::DOUBLE AS df FROM h GROUP BY w),
x AS (SELECT rid, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS raw FROM h JOIN df USING (w) JOIN n USING (rid) CROSS JOIN g GROUP BY rid),
cov AS (SELECT substr(rid, 2) AS file, count(DISTINCT w) FILTER (w IN ('thing', 'nation'))::DOUBLE / count(DISTINCT w) AS coverage FROM t WHERE rid LIKE 't%' GROUP BY rid),
y AS (SELECT c.*, coalesce(raw / (SELECT max(raw) FROM x), 0) AS lexical, coalesce(coverage, 0) AS coverage FROM c LEFT JOIN x ON x.rid = 'l' || node LEFT JOIN cov USING (file)),
s AS (SELECT *, 1 - (1 - greatest(0, least(1, cosine))) * (1 - 0.5::DOUBLE * lexical) * (1 - 0.3::DOUBLE * coverage) AS score FROM y)"""
_FOLDED = """
z AS (SELECT *, fused * CASE WHEN file LIKE 'doc/1%' THEN 0.8::DOUBLE ELSE 1 END AS final FROM b),
u AS (SELECT file, unit, max(final) AS score, min(ordinal) FILTER (r = 1) AS ordinal, any_value(lexical) FILTER (r = 1) AS lexical, any_value(coverage) FILTER (r = 1) AS coverage, any_value(distance) AS distance
  FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY final DESC, ordinal) AS r FROM z) GROUP BY file, unit),
k AS (SELECT file AS id, score, count(*) OVER (PARTITION BY file)::INT AS units_total, unit, distance, lexical, coverage FROM u QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, ordinal, unit) = 1)"""
_SHOWN = "SELECT id, round(score, 6) AS score, units_total, unit, distance::INT AS distance, round(lexical, 6) AS lexical, round(coverage, 6) AS coverage"

ORACLE_SQL = {
    "r01_hybrid": f"WITH {_RANKED}, b AS (SELECT *, score AS fused, 0 AS distance FROM s), {_FOLDED} {_SHOWN} FROM k ORDER BY k.score DESC, id LIMIT 10",
    "r07_hybrid_spread": f"""WITH {_RANKED},
e AS (SELECT 'doc/' || doc_id AS id, 'doc/' || (doc_id + 1) AS other FROM documents UNION SELECT 'doc/' || (doc_id + 1), 'doc/' || doc_id FROM documents),
r0 AS (SELECT file AS id, max(greatest(0, least(1, score))) AS score FROM s GROUP BY file ORDER BY 2 DESC, 1 LIMIT 20),
r1 AS (SELECT DISTINCT other AS id FROM e JOIN r0 USING (id) WHERE other NOT IN (SELECT id FROM r0)),
p AS (SELECT id, 0 AS distance FROM r0 UNION ALL SELECT id, 1 FROM r1 WHERE id IN (SELECT 'doc/' || doc_id FROM documents)),
gr AS (SELECT p.id, distance, coalesce(avg(r0.score), 0) AS graph FROM p LEFT JOIN e ON e.id = p.id LEFT JOIN r0 ON r0.id = e.other GROUP BY p.id, distance),
b AS (SELECT s.*, gr.distance, 0.8::DOUBLE * CASE WHEN gr.distance > 0 THEN 0 ELSE greatest(0, least(1, score)) END + 0.2::DOUBLE * graph AS fused FROM s JOIN gr ON gr.id = s.file), {_FOLDED},
a AS (SELECT * FROM k UNION ALL SELECT id, 0.2::DOUBLE * graph * CASE WHEN id LIKE 'doc/1%' THEN 0.8::DOUBLE ELSE 1 END, 0, NULL, distance, NULL, NULL FROM gr WHERE distance > 0 AND id NOT IN (SELECT id FROM k))
{_SHOWN} FROM a ORDER BY a.score DESC, id LIMIT 10""",
}
