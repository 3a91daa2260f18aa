"""Vectors given beside the bodies."""

from pyspark.sql import functions as F

from loamgraph.operators import hybrid


def test_vectors_apart_are_as_those_of_the_rows(spark):
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id") % 9, F.lit("#P"), "id").alias("id"), F.lit(0).alias("chunk"), F.col("id").cast("int").alias("ordinal"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("word nation "), F.col("id") % 7).alias("body"), F.col("id").alias("vec"), F.lit("new").alias("model"))
    vectors = spark.range(0, 40, 2).select(F.col("id").alias("vec"), F.array((F.col("id") + 1).cast("float"), F.lit(2.0).cast("float")).alias("vector"))
    own = rows.where("id like 'f3%'").select(F.substring("id", 1, 2).alias("id"), "chunk", "body", "vec", "model").limit(1)
    files = spark.createDataFrame([(f"f{i}",) for i in range(8)], "id string")
    joined = [x.join(vectors, "vec").drop("vec") for x in (rows, own)]
    want = hybrid.candidates(files, *joined, "new").measured("nation", [1.0, 2.0], True)
    got = hybrid.candidates(files, rows, own, "new", vectors).measured("nation", [1.0, 2.0], True)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
