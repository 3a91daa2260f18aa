"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import WORD, materialize, occurrences, table

#: Bins of one histogram level; two levels leave a 2^-20 share of a source to rank exactly.
BINS = 1024
#: (words from, weight): within a source, expected copies go in these proportions, up to the most a document may have.
#: Documents of more words say more in one piece and have better odds. Weights ascend.
TIERS = ((0, 2), (100, 3), (1000, 4))


def tier(size: Column) -> Column:
    return reduce(lambda c, t: F.when(size >= t[1][0], F.lit(t[0])).otherwise(c), enumerate(TIERS), F.lit(0))


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """Per source key: size, target words, and s0, s1 ... (its words by tier).

    sizes has key, source (null for documents without one), size. Sources in code-point order, null last,
    weigh `weights`, repeating. Targets share `share` of all words by weight; none goes above `most` times
    its size, and what is over goes to the others by weight. That fixpoint is reached in closed form: in
    the order of size over weight, a source is capped as long as its even part of what is left exceeds its cap.
    The windows run over one row a source, so a task must hold the sources' list, but never documents.
    """
    by_tier = [F.sum(F.when(tier(F.col("size")) == k, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(len(TIERS))]
    src = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), *by_tier)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("i", F.row_number().over(order) - 1)
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long"))
    src = src.withColumn("all_size", F.sum("source_size").over(everything))
    src = src.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("i"))
    src = src.withColumn("cap_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    src = src.withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    total = F.lit(share) * F.col("all_size") if share != 1.0 else F.col("all_size")
    src = src.withColumn("left", total - F.coalesce("cap_before", F.lit(0)))
    src = src.withColumn("capped", F.col("w") * F.col("left") > F.col("cap") * F.col("w_left"))
    free = ~F.col("capped")
    src = src.withColumn("free_w", F.sum(F.when(free, F.col("w"))).over(everything))
    src = src.withColumn("capped_all", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * (total - F.col("capped_all"))).cast("double") / F.col("free_w").cast("double"))
    return src.select("key", "source_size", target.alias("target"), *(f"s{k}" for k in range(len(TIERS))))


def expected(sources: DataFrame, most: int = 3) -> DataFrame:
    """sources with e0, e1 ... (expected copies of a document of each tier) and `goal`, the words to draw beside whole copies.

    Copies are `most` or c times the tier's weight, if that is less; c is such that the words expected meet the
    target. Tiers reach `most` from the heaviest on, so c is one of a few quotients.
    """
    n = len(TIERS)
    c: Column = F.lit(most / TIERS[0][1])
    for free in range(1, n + 1):  # so many tiers stay below `most`
        capped = [F.lit(most) * F.col(f"s{k}") for k in range(free, n)]
        left = reduce(lambda a, b: a - b, capped, F.col("target"))
        words = reduce(lambda a, b: a + b, [F.lit(TIERS[k][1]) * F.col(f"s{k}") for k in range(free)])
        tried = F.when(words > 0, left / words.cast("double"))
        c = F.when(tried * F.lit(TIERS[free - 1][1]) <= F.lit(most), tried).otherwise(c)
    rows = sources.withColumn("c", c)
    rows = rows.withColumns({f"e{k}": F.least(F.lit(float(most)), F.col("c") * F.lit(TIERS[k][1])) for k in range(n)})
    goal = reduce(lambda a, b: a - b, [F.floor(f"e{k}") * F.col(f"s{k}") for k in range(n)], F.col("target"))
    return rows.withColumn("goal", goal).drop("c", *(f"s{k}" for k in range(n)))


def uniform(words: Column, seed: int) -> Column:
    """A number in (0, 1) from a string and the seed, the same on every run and engine: 52 bits of an MD5."""
    h = F.conv(F.substring(F.md5(F.concat(words, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    return (h.cast("double") + 0.5) / F.lit(float(2**52))


def pareto_rank(u: Column, part: Column) -> Column:
    """Random odds over inclusion odds, squeezed to [0, 1]: the smallest ranks are taken. Null where nothing is to be drawn."""
    q = F.when((part > 0) & (part < 1), (u / (1 - u)) / (part / (1 - part)))
    return q / (1 + q)


def drawn(docs: DataFrame, *more: Column) -> DataFrame:
    """What the draw needs: key (of the source), source, size (words), id and text_hash, _row (of rows that share id,
    text and source)."""
    key = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text = F.md5(F.coalesce("text", F.lit("")))
    return docs.select(*more, key.alias("key"), "source", size.alias("size"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text.alias("text_hash"), F.xxhash64("doc_id", "text", "source").alias("_row"))


def ranked(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """rows (of drawn(), numbered by occurrences()) with their source's figures, whole and part copies and Pareto rank k."""
    at = rows.join(sources, "key")
    e = reduce(lambda c, k: F.when(tier(F.col("size")) == k, F.col(f"e{k}")).otherwise(c), range(len(TIERS)), F.lit(0.0))
    at = at.withColumn("e", F.when(F.col("size") > 0, e).otherwise(F.lit(0.0)))
    at = at.withColumn("whole", F.floor("e")).withColumn("part", F.col("e") - F.floor("e"))
    u = uniform(F.concat_ws(":", "id", "text_hash", F.col("_nth").cast("string")), seed)
    return at.withColumn("k", pareto_rank(u, F.col("part")))


def take(at: DataFrame, cut: DataFrame) -> DataFrame:
    """ranked() rows with `copies`; cut is a small table, a row a source, that Spark broadcasts by its size."""
    at = at.join(cut, "key", "left")
    bin_at, cut_at = F.floor(F.col("k") * (BINS * BINS)), F.col("b1") * F.lit(BINS) + F.col("b2")
    extra = F.when(F.col("all_in"), F.col("k").isNotNull()).otherwise((bin_at < cut_at) | ((bin_at == cut_at) & (F.col("k") <= F.col("k_last"))))
    return at.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"))


def cuts(at: DataFrame) -> DataFrame:
    """Where each source's Pareto ranks are cut: documents go in by rank until their words come nearest the goal
    (one is in if its middle word is). Two levels of histograms find the place, so no source is sorted in one task;
    only a 2^-20 share of it is ranked exactly. A source whose words don't reach the goal is all in."""
    slim = at.where("k is not null").select("key", "size", "goal", "k")

    def crossing(bins: DataFrame, by: list[str], before: Column) -> DataFrame:
        """The bin of each source in which its words pass the goal, with the words before it."""
        w = Window.partitionBy("key").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        upto = before + F.sum("words").over(w)
        return bins.withColumn("upto", upto).where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("words") < F.col("goal")))

    one = F.floor(F.col("k") * BINS).cast("int")
    two = (F.floor(F.col("k") * (BINS * BINS)) % BINS).cast("int")
    level1 = materialize(slim.groupBy("key", one.alias("b1")).agg(F.sum("size").alias("words"), F.first("goal").alias("goal")), slim=True)
    all_in = level1.groupBy("key").agg((F.sum("words") < F.first("goal")).alias("all_in"))
    cut1 = materialize(crossing(level1, ["b1"], F.lit(0)).select("key", "b1", (F.col("upto") - F.col("words")).alias("before")), slim=True)
    in1 = slim.join(cut1, "key").where(one == F.col("b1"))
    level2 = in1.groupBy("key", two.alias("b2")).agg(F.sum("size").alias("words"), F.first("goal").alias("goal"), F.first("before").alias("before"), F.first("b1").alias("b1"))
    cut2 = materialize(crossing(level2, ["b2"], F.col("before")).select("key", "b1", "b2", (F.col("upto") - F.col("words")).alias("before")), slim=True)
    # A rank at a time in the last bin: in if the words before it and half its own stay within the goal.
    last = slim.join(cut2, "key").where((one == F.col("b1")) & (two == F.col("b2"))).groupBy("key", "k").agg(F.sum("size").alias("words"), F.first("goal").alias("goal"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    inside = last.withColumn("upto", upto).where(2 * F.col("upto") - F.col("words") <= 2 * F.col("goal")).groupBy("key").agg(F.max("k").alias("k_last"))
    return materialize(all_in.join(cut2.drop("before"), "key", "left").join(inside, "key", "left"), slim=True)


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 7, share: float = 1.0) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies.

    Expected copies of a source's documents go in proportion to the weights of their tiers, `most` at most, and their
    words meet the source's target. The whole part is certain. The broken part p is an inclusion probability: documents
    of a source rank by random odds over inclusion odds (u / (1 - u)) over (p / (1 - p)), and the first ranks are taken
    until their words come nearest the words that are left. So the sample's size is fixed in words.

    Rows without words (null, empty) have size 0 and are not taken. A null source is a source of its own, last. Rows
    draw by id, text and a number among rows that are alike in both, so null and repeated ids draw apart. A source of
    whole copies only, as one that stops at `most` times its size, draws nothing. An empty table gives an empty mix.
    Columns other than doc_id, text and source are not read. Texts of any length are counted where they lie.
    """
    rows = occurrences(materialize(drawn(docs, F.col("doc_id"))), "_row")
    at = ranked(rows, materialize(expected(source_targets(rows, weights, most, share), most), slim=True), seed)
    return take(at, cuts(at)).select("doc_id", "source", "size", "source_size", "target", "copies")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents; taken is copies times size."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, in all its columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are as mix() says; a document that isn't taken is left out.
    """
    slim = materialize(drawn(docs))
    sources = materialize(expected(source_targets(slim)), slim=True)
    cut = cuts(ranked(occurrences(slim, "_row"), sources, 7))
    at = ranked(occurrences(drawn(docs, F.struct("*").alias("d")), "_row"), sources, 7)
    taken = take(at, cut).where("copies > 0")
    return taken.select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("d.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS h,
    row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS nth FROM documents),
u AS (SELECT doc_id, source, size, CASE WHEN size >= 1000 THEN 2 WHEN size >= 100 THEN 1 ELSE 0 END AS tier,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || h || ':' || nth || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(size) FILTER (tier = 0), 0)::BIGINT AS s0, coalesce(sum(size) FILTER (tier = 1), 0)::BIGINT AS s1,
    coalesce(sum(size) FILTER (tier = 2), 0)::BIGINT AS s2, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM u GROUP BY source),
w AS (SELECT *, (i % 3 + 1)::BIGINT AS w, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS all_size FROM s),
r AS (SELECT *,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
    (sum(w) OVER (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left FROM w),
c AS (SELECT *, w * (all_size - cap_before) > cap * w_left AS capped FROM r),
t AS (SELECT source, source_size, s0, s1, s2, CASE WHEN capped THEN cap::DOUBLE ELSE
    (w * (all_size - coalesce((sum(cap) FILTER (capped) OVER ())::BIGINT, 0)))::DOUBLE / ((sum(w) FILTER (NOT capped) OVER ())::BIGINT)::DOUBLE END AS target FROM c),
q AS (SELECT *, target / nullif(2 * s0 + 3 * s1 + 4 * s2, 0)::DOUBLE AS c3, (target - 3 * s2) / nullif(2 * s0 + 3 * s1, 0)::DOUBLE AS c2,
    (target - 3 * s1 - 3 * s2) / nullif(2 * s0, 0)::DOUBLE AS c1 FROM t),
e AS (SELECT *, CASE WHEN c3 * 4 <= 3 THEN c3 WHEN c2 * 3 <= 3 THEN c2 WHEN c1 * 2 <= 3 THEN c1 ELSE 1.5::DOUBLE END AS c FROM q),
g AS (SELECT *, target - floor(least(3.0::DOUBLE, c * 2)) * s0 - floor(least(3.0::DOUBLE, c * 3)) * s1 - floor(least(3.0::DOUBLE, c * 4)) * s2 AS goal FROM e),
k AS (SELECT u.doc_id, u.source, u.size, g.source_size, g.target, g.goal, u.u, CASE WHEN u.size > 0 THEN least(3.0::DOUBLE, g.c * (tier + 2)) ELSE 0.0::DOUBLE END AS e
  FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM k),
o AS (SELECT *, sum(size) FILTER (q IS NOT NULL) OVER (PARTITION BY source ORDER BY q / (1 + q) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, q / (1 + q)) AS words, sum(size) FILTER (q IS NOT NULL) OVER (PARTITION BY source) AS most FROM p)
SELECT doc_id, size, source_size, target, ((floor(e) + CASE WHEN q IS NOT NULL AND (most < goal OR 2 * upto - words <= 2 * goal) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o
"""
