"""Change capture: differences of snapshots, keyed upserts, and files that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def diff(before: DataFrame, after: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, change): insert, update or delete of what differs between two snapshots with one row a key."""
    a = before.select(key, F.xxhash64(*content).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in content])
    b = after.select(key, F.xxhash64(*content).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in content])
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    kind = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~same, "update")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; of rows that tie in `order`, the greatest as a whole."""
    rest = [c for c in rows.columns if c != key]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't in new, and all of new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files gone (id), their sub-units and what leaves them."""
    file = lambda c: F.split_part(F.col(c), F.lit("#"), F.lit(1))
    lost = gone.select(F.col("id").alias("_file")).distinct()
    return nodes.join(lost, file("id") == F.col("_file"), "left_anti"), edges.join(lost, file("source") == F.col("_file"), "left_anti")


def follow_files(spark: SparkSession, folder: str, endings: str = "*.{md,mdx,html,htm}", per_batch: int = 10_000) -> DataFrame:
    """Files as they arrive: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", endings).option("maxFilesPerTrigger", per_batch).load(folder)


def index_stream(files: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Each micro-batch goes to apply(rows, batch id) with the last version of a path only; a batch may come again
    after a loss, so apply must be idempotent, as an upsert by key is. Without `every`, what is there is read once."""

    def run(batch: DataFrame, number: int) -> None:
        apply(latest(batch, "path", ["modificationTime"]), number)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
