"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.storage import apart, drop, kept


def star_components(links: DataFrame) -> DataFrame:
    """(a, b) for every node but the smallest of its component, with that smallest one as b.

    links (a, b) are undirected; loops say nothing. Rounds of joins alternate until nothing changes, a logarithmic
    number of them; each is written to the shared folder, and the one before is removed. One sum a round is collected.
    """
    now, before = kept(links.where("a <> b").select("a", "b").distinct(), slim=True), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        large = both.join(apart(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the node and its smaller neighbours go to the smallest of these.
        up = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(up), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(up.select("a", F.col("m").alias("b")))
        later = kept(small.where("a <> b").distinct(), slim=True)
        drop(now)
        now = later
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state
