"""Repeated traversal over edges as frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.storage import kept


def reach(edges: DataFrame, far: DataFrame, least: int, most: int | None) -> DataFrame:
    """Ids from which `least` to `most` steps along edges (source to target) lead to one of far's ids.

    Bounded walks keep one set of ids a step, as a node may be met again; unbounded ones keep what is new
    once `least` steps are made, so cycles end.
    """
    frontier = kept(far.select("id").distinct(), slim=True)
    found: DataFrame | None = None
    step = 0
    while most is None or step < most:
        step += 1
        reached = edges.join(frontier, edges.target == frontier.id, "left_semi").select(F.col("source").alias("id")).distinct()
        if most is None and found is not None:
            reached = reached.join(found, "id", "left_anti")
        frontier = kept(reached, slim=True)
        if frontier.isEmpty():
            break
        if step >= least:
            found = frontier if found is None else found.union(frontier)
    return far.select("id").limit(0) if found is None else found.distinct()
