"""Lexical and semantic ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamgraph.functions.text import forms_of, plain_words, stem, terms_of, tokens
from loamgraph.operators.storage import kept

SATURATION, LENGTH_PENALTY = 1.2, 0.75


def counted(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """rows with n, the words of a text, and f0, f1 ..., how often each term is said, in place of the text.

    Only the forms a stem can come from are looked for, so no word of a text is stemmed.
    """

    def said(i: int) -> Column:
        forms = forms_of(terms[i])
        return F.size(F.filter("_w", lambda w: w.isin(forms))).cast("double").alias(f"f{i}")

    # An inner sub-plan of its own keeps the words from being split once a term.
    words = rows.withColumn("_w", plain_words(F.col(text))).drop(text).withColumn("_w", F.explode(F.array("_w")))
    return words.select("*", F.size("_w").cast("double").alias("n"), *map(said, range(len(terms)))).drop("_w")


def bm25_of(rows: DataFrame, terms: list[str]) -> DataFrame:
    """counted() rows, which are read twice, with `lexical` in place of the counts: BM25 over the best score, 0 where no word is shared."""
    counts = ["n", *(f"f{i}" for i in range(len(terms)))]
    corpus = rows.agg(F.count("*").cast("double").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"d{i}") for i in range(len(terms)))).first()
    if not terms or not corpus["docs"] or not corpus["mean"]:
        return rows.withColumn("lexical", F.lit(0.0)).drop(*counts)

    def part(i: int) -> Column:
        df, f = F.lit(corpus[f"d{i}"]), F.col(f"f{i}")
        idf = F.log(1 + (F.lit(corpus["docs"]) - df + 0.5) / (df + 0.5))
        return idf * f * (SATURATION + 1) / (f + SATURATION * (1 - LENGTH_PENALTY + LENGTH_PENALTY * F.col("n") / F.lit(corpus["mean"])))

    scored = rows.withColumn("_raw", reduce(lambda a, b: a + b, map(part, range(len(terms)))))
    best = scored.agg(F.max("_raw")).first()[0]
    return scored.withColumn("lexical", F.col("_raw") / best if best and best > 0 else F.lit(0.0)).drop("_raw", *counts)


def bm25(rows: DataFrame, query: str) -> DataFrame:
    """(id, lexical) over all candidate rows (id, text): BM25 over the best score, 0 where no word is shared.

    Texts are read once, to each row's length and counts of the query's words; these slim rows are stored, and the corpus
    figures and the best score are one row each. Words said twice in the query count once.
    """
    terms = terms_of(query)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("lexical"))
    return bm25_of(kept(counted(rows.select("id", "text"), "text", terms)), terms)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for a zero vector or unequal lengths."""
    f = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(f(x), f(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def fused(cos: Column, lexical: Column, title: Column, w_lexical: float = 0.5, w_title: float = 0.3) -> Column:
    """Each part closes a share of the gap to 1."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return 1 - (1 - clip(cos)) * (1 - w_lexical * lexical) * (1 - w_title * title)


def nearest(rows: DataFrame, vector: list[float], take: int) -> DataFrame:
    """The rows (id, vector) with the highest cosine, ties by id."""
    q = F.array(*[F.lit(float(v)) for v in vector])
    return rows.select("id", cosine(F.col("vector"), q).alias("score")).orderBy(F.desc("score"), "id").limit(take)


def nearest_each(rows: DataFrame, queries: DataFrame, take: int) -> DataFrame:
    """(query_id, id, score): of every query (id, vector) the rows (id, vector) with the highest cosine, ties by id.

    Blocks of queries meet blocks of rows; each pair of blocks gives its best, and these are ranked by query.
    """

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        n = F.lit(df.count() // size + 1)
        row = F.struct("id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
        return df.groupBy(F.pmod(F.xxhash64("id"), n).alias("block")).agg(F.collect_list(row).alias(name)).select(name)

    def matrix(items: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([-1 if x["vector"] is None else len(x["vector"]) for x in items])
        at = np.zeros((max(sizes.max(), 1), len(items)))
        for i, x in enumerate(items):
            at[: max(sizes[i], 0), i] = x["vector"] or []
        norm = np.zeros(len(items))
        for v in at:
            norm += v * v
        return at, sizes, np.sqrt(norm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some, own = batch.column("r")[i].as_py(), batch.column("q")[i].as_py()
                some.sort(key=lambda x: (x["id"] is not None, x["id"]))
                (a, n, norm), (b, m, length) = matrix(some), matrix(own)
                dot = np.zeros((len(own), len(some)))
                for x, y in zip(a, b, strict=False):  # in order, as a loop over one pair would
                    dot += y[:, None] * x
                by = length[:, None] * norm
                score = np.where((m[:, None] == n) & (by > 0), dot / np.where(by > 0, by, 1.0), 0.0)
                best = np.argsort(-score, axis=1, kind="stable")[:, :take]
                q = np.repeat(np.arange(len(own)), best.shape[1])
                at = best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([own[k]["id"] for k in q], kinds[0]), pa.array([some[k]["id"] for k in at], kinds[1]), pa.array(score[q, at])], names=["query_id", "id", "score"])

    kinds = [to_arrow_type(df.schema["id"].dataType) for df in (queries, rows)]
    pairs = blocks(rows, 1024, "r").crossJoin(blocks(queries, 128, "q"))
    kind = [df.schema["id"].dataType.simpleString() for df in (queries, rows)]
    scored = pairs.mapInArrow(run, f"query_id {kind[0]}, id {kind[1]}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= take).drop("place")


def covered(title: Column, query: str) -> Column:
    """The share of a title's distinct stems that the query names."""
    forms = [w for t in terms_of(query) for w in forms_of(t)]
    words = F.array_distinct(tokens(title))
    named = F.size(F.array_distinct(F.transform(F.filter(plain_words(title), lambda w: w.isin(forms)), stem))) if forms else F.lit(0)
    return F.when(F.size(words) > 0, named / F.size(words)).otherwise(F.lit(0.0))


def coverage(rows: DataFrame, query: str) -> DataFrame:
    """rows with `coverage`: the share of the title's distinct stems that the query names."""
    return rows.withColumn("coverage", covered(F.col("title"), query))


def weight(types: dict[str, float], paths: dict[str, float]) -> Column:
    """A row's type weight times the least weight of the path patterns it fits; 1 where none is given."""
    from loamgraph.plans.filter import glob_pattern

    by_type = reduce(lambda c, kv: c.when(F.col("type") == kv[0], F.lit(kv[1])), types.items(), F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))
    fits = [F.when(F.col("path").rlike(glob_pattern(g)), F.lit(w)) for g, w in paths.items()]
    return by_type * F.coalesce(F.array_min(F.array(*fits)) if fits else F.lit(1.0), F.lit(1.0))


def window(rows: DataFrame, take: int, skip: int = 0, least: float | None = None) -> DataFrame:
    """Ranked rows: those of `least` score or more, best first and ties by id, a window of them."""
    kept = rows if least is None else rows.where(F.col("score") >= least)
    ranked = kept.orderBy(F.desc("score"), "id")
    return (ranked.offset(skip) if skip else ranked).limit(take)
