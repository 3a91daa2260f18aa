"""Events over time, as a stream or a batch: quiet periods, tumbling, sliding and session windows, and what comes too late."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamgraph.operators.storage import _path, shared_dir

#: Fixed value: how long a path must be quiet before its last event counts.
QUIET = "500 milliseconds"


def debounced(events: DataFrame, key: str, time: str, quiet: str = QUIET, late: str = "0 seconds") -> DataFrame:
    """The last event of each burst: events of a key less than `quiet` apart are one burst, and a burst ends when the key
    has been quiet for so long. Columns are those of the events, and n, how many the burst has.

    On a stream an event comes out when the watermark, `late` behind the newest event of any key, has passed the quiet
    time after it: bursts may stretch over any number of micro-batches, and state is one row a burst under way.
    Events that tie in time go by their other columns. Null keys are a key; events without a time are left out.
    """
    rest = [c for c in events.columns if c != time]
    last = F.max(F.struct(F.col(time), *rest)).alias("_last")
    rows = events.where(F.col(time).isNotNull()).withWatermark(time, late)
    bursts = rows.groupBy(F.session_window(time, quiet), F.col(key).alias("_key")).agg(last, F.count("*").alias("n"))
    return bursts.select(*(F.col(f"_last.{c}").alias(c) for c in events.columns), "n")


def windowed(events: DataFrame, time: str, keys: list[str], aggregates: list[Column], size: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(start, end, keys, aggregates) of windows of a fixed size: side by side, or every `slide`, so that one event is in several."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(w, *keys).agg(*aggregates)
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in rows.columns if c != "window"))


def sessions(events: DataFrame, time: str, keys: list[str], aggregates: list[Column], gap: str | Column, late: str = "0 seconds") -> DataFrame:
    """(start, end, keys, aggregates) of sessions: events of a key less than a gap apart. The gap may differ by event, as a column."""
    rows = events.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *(c for c in rows.columns if c != "session_window"))


def follow(spark: SparkSession, at: str, schema: str, files: int = 1, glob: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, `files` a micro-batch, oldest first; or a single file as one."""
    path, system = _path(spark, at)
    if system.exists(path) and system.getFileStatus(path).isFile():
        at = f"{at[:-1]}[{at[-1]}]"  # a stream reads folders, or what a pattern finds
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(at)


def settled(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """All that a stream gives for what is there now, and how many late rows its windows dropped.

    append: windows that the watermark has passed; complete: all windows as they stand. Files go to the shared folder,
    a folder for each batch, so a batch that comes again after a loss takes its own place.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path, system = _path(spark, at)
    system.deleteOnExit(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'all' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    there, system = _path(spark, f"{at}/out")
    if not system.exists(there):
        return spark.createDataFrame([], stream.schema), 0
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{at}/out"), dropped(query)


def dropped(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed their window, as the query's recent progress counts them."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
