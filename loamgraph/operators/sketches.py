"""Sketches that are stored once and merged later, and totals over several groupings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count, as a power of two, and k of the quantiles: errors of about 1.04 / 2^(HLL / 2) and 1.65 / K at rank.
HLL, K = 12, 400


def sketched(rows: DataFrame, by: list[str], distinct: list[str] = (), quantiles: list[str] = ()) -> DataFrame:
    """(by, n, d_..., q_...): of each group its count, a sketch of the distinct values of some columns, and one of the order
    of the numbers in others. Tasks make their own sketches and only these are shuffled. Sketches are plain binary columns: a day's
    or a file's are stored and never made again."""
    parts = [F.count("*").alias("n")]
    parts += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL)).alias(f"d_{c}") for c in distinct]
    parts += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(K)).alias(f"q_{c}") for c in quantiles]
    return rows.groupBy(*by).agg(*parts)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """sketched() rows folded to coarser groups."""
    more = [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.startswith("d_")]
    more += [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith("q_")]
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *more)


def estimates(sketches: DataFrame, at: list[float] = (0.5,)) -> DataFrame:
    """The groups with numbers instead of sketches: distinct_<column>, and for each share asked <column>_p<hundredths>."""
    out = []
    for c in sketches.columns:
        if c.startswith("d_"):
            out.append(F.hll_sketch_estimate(c).alias("distinct_" + c[2:]))
        elif c.startswith("q_"):
            out += [F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p))).alias(f"{c[2:]}_p{round(100 * p)}") for p in at]
        else:
            out.append(F.col(c))
    return sketches.select(*out)


def totals(rows: DataFrame, by: list[str], how: str, aggregates: list) -> DataFrame:
    """(by, level, aggregates) over rollup or cube of properties. level tells which are summed over, as bits from the last
    one on, so that a null of the data isn't taken for a total. A list counts once for each of its distinct items, and a
    missing or empty one as null."""
    for c in by:
        if rows.schema[c].dataType.typeName() == "array":
            rows = rows.withColumn(c, F.explode_outer(F.array_distinct(c)))
    if how not in ("rollup", "cube"):
        raise ValueError(f"{how} is neither rollup nor cube")
    groups = rows.rollup(*by) if how == "rollup" else rows.cube(*by)
    return groups.agg(F.grouping_id().alias("level"), *aggregates)
