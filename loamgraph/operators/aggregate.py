"""Counts, groups and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, name: str) -> DataFrame:
    """(value, n) by a property, largest groups first, on a tie the group without a value last and the rest by value.
    Each distinct item of a list counts once, a missing or empty one as null."""
    if name in ("id", "path", "title"):
        raise ValueError(f"{name} is no property to group by")
    if rows.schema[name].dataType.typeName() == "array":
        rows = rows.select(F.explode_outer(F.array_distinct(name)).alias(name))
    groups = rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    return groups.orderBy(F.desc("n"), F.col("value").isNull(), "value")


def count_by_json(rows: DataFrame, name: str, json: str = "json") -> DataFrame:
    """(value, n) by an undeclared property of a JSON column, in the order of count_by(). Values are told apart as JSON:
    1 and 1.0 are one, "1" is another."""
    doc, path = F.try_parse_json(json), f"$['{name}']"
    value = F.try_variant_get(doc, path, "variant")
    items = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(doc, path, "array<variant>")).otherwise(F.array(value))
    kind = lambda v: F.schema_of_variant(v)
    number = lambda v: F.try_variant_get(v, "$", "double")
    key = lambda v: F.when(v.isNull() | (kind(v) == "VOID"), F.lit(None)).when(kind(v).isin("STRING", "BOOLEAN") | kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY"), F.to_json(v)).otherwise(F.regexp_replace(number(v).cast("string"), r"\.0$", ""))
    groups = rows.select(F.explode_outer(F.array_distinct(F.transform(items, key))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return groups.orderBy(F.desc("n"), F.col("value").isNull(), "value")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, in_degree) of every node with an edge."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i")).union(edges.select(F.col("target").alias("id"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("i").alias("in_degree"))
