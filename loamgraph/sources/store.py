"""Versioned tables: files in buckets, and a log of commits that names which files are the tables of each version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.operators.storage import kept, shuffles_removed

#: Times a merge is made anew when another writer has committed meanwhile.
TRIES = 5


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted."""


@dataclass
class Table:
    """schema, the columns that tell rows apart, how many buckets, and the folders of each bucket."""

    schema: str
    key: list[str]
    buckets: int
    folders: dict[str, list[str]] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")


class Store:
    """Tables under one folder that any executor can reach. A commit is one small file, made only if it isn't there yet, so
    readers see all of a commit or nothing, and of two writers of one version one fails. Data files are never changed:
    every version stays readable until vacuum().
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self, version: int):
        return self._path(f"{self.at}/_log/{version:020d}.json")

    def _read_log(self, version: int) -> dict | None:
        """The commit; None where there is none, or one whose writer died before its last byte."""
        path = self._log(version)
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def versions(self) -> list[int]:
        folder = self._path(f"{self.at}/_log")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(v for n in names if n.endswith(".json") and not n.startswith(".") and self._read_log(v := int(n[:-5])) is not None)

    def state(self, version: int | None = None) -> Commit:
        """What a version, or the last, holds; version 0 is an empty store."""
        if version is None:
            version = next(reversed(self.versions()), 0)
        got = self._read_log(version) if version else {"tables": {}, "meta": {}, "batches": {}}
        if got is None:
            raise KeyError(f"no version {version}")
        return Commit(self, version, {k: Table(**t) for k, t in got["tables"].items()}, got["meta"], got["batches"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.state(version).read(name)

    def update(self, change: Callable[[Commit], None], batch: tuple[str, int] | None = None) -> int:
        """Lets change() work on the last version and commits it, anew if another writer was faster. Returns the version.

        batch: who writes, and the number of the batch; one that has been committed before changes nothing, so a stream's
        batch that comes again after a loss counts once.
        """
        for _ in range(TRIES):
            now = self.state()
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now.version
            change(now)
            if batch:
                now.batches[batch[0]] = batch[1]
            try:
                return now.commit()
            except Conflict:
                continue
        raise Conflict(f"{TRIES} tries at {self.at} met other writers")

    def vacuum(self, keep: int = 1) -> int:
        """Removes the log of all but the last `keep` versions, and data that none of these names; how many folders went. No
        writer may be at work."""
        versions = self.versions()
        live = {d for v in versions[-keep:] for t in self.state(v).tables.values() for dirs in t.folders.values() for d in dirs}
        for v in versions[:-keep]:
            self._files.delete(self._log(v), False)
        gone = 0
        data = self._path(f"{self.at}/data")
        for write in self._files.listStatus(data) if self._files.exists(data) else ():
            for part in self._files.listStatus(write.getPath()):
                name = f"{write.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in live:
                    self._files.delete(part.getPath(), True)
                    gone += 1
        return gone

    def _commit(self, version: int, body: dict) -> None:
        data = (json.dumps(body) + "\n").encode()
        try:
            stream = self._files.create(self._log(version), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(str(version)) from e
            raise
        try:
            stream.write(data)
        finally:
            stream.close()


class Commit:
    """One version's tables, to read or to change; what is written shows with commit() only."""

    def __init__(self, store: Store, version: int, tables: dict[str, Table], meta: dict, batches: dict[str, int]):
        self.store, self.version, self.tables, self.meta, self.batches = store, version, tables, meta, batches

    def create(self, name: str, schema: str, key: list[str], buckets: int = 64) -> None:
        if name not in self.tables:
            self.tables[name] = Table(schema, key, buckets)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets: only their folders are read."""
        t = self.tables[name]
        some = t.folders.values() if buckets is None else [t.folders.get(str(b), []) for b in buckets]
        return self._stored(t, [d for dirs in some for d in dirs])

    def bucket_of(self, name: str, *values: object) -> int:
        """The bucket of one key."""
        t = self.tables[name]
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(t.schema)}
        row = self.store.spark.createDataFrame([values], T.StructType([T.StructField(k, kinds[k]) for k in t.key]))
        return row.select(t.bucket()).first()[0]

    def _write(self, t: Table, rows: DataFrame, order: list[str], parts: Column | None, then: Callable[[DataFrame, list[str]], DataFrame] | None = None, tasks: int | None = None) -> dict[str, str]:
        """Folders of the buckets that the rows fill. parts: a number by which a bucket's rows are dealt to several tasks. then:
        makes the table's columns of dealt rows, and keeps the place columns; grouping by these and more shuffles nothing."""
        name = uuid.uuid4().hex
        at = f"{self.store.at}/data/{name}"
        cols, place = [f.name for f in T.StructType.fromDDL(t.schema)], ["_bucket", "_part"]
        dealt = rows.select(*(rows.columns if then else cols), t.bucket().alias("_bucket"), (F.lit(0) if parts is None else parts).alias("_part"))
        dealt = dealt.repartition(*([tasks] if tasks else []), *place)
        made = (then(dealt, place) if then else dealt).select(*cols, "_bucket")
        with shuffles_removed(self.store.spark):
            made.sortWithinPartitions("_bucket", *order).write.partitionBy("_bucket").parquet(at)
        store = self.store
        found = [s.getPath().getName() for s in store._files.listStatus(store._path(at)) if s.isDirectory()]
        return {f.removeprefix("_bucket="): f"{name}/{f}" for f in found if f.startswith("_bucket=")}

    def append(self, name: str, rows: DataFrame, order: list[str] | None = None, parts: Column | None = None, then: Callable[[DataFrame, list[str]], DataFrame] | None = None, tasks: int | None = None) -> DataFrame:
        """Adds rows beside what is there; no file is read or rewritten. Returns what was written, to be read again."""
        t = self.tables[name]
        made = self._write(t, rows, order or t.key, parts, then, tasks)
        for bucket, folder in made.items():
            t.folders.setdefault(bucket, []).append(folder)
        return self._stored(t, list(made.values()))

    def overwrite(self, name: str, rows: DataFrame, order: list[str] | None = None, parts: Column | None = None, then: Callable[[DataFrame, list[str]], DataFrame] | None = None, tasks: int | None = None) -> DataFrame:
        t = self.tables[name]
        made = self._write(t, rows, order or t.key, parts, then, tasks)
        t.folders = {b: [f] for b, f in made.items()}
        return self._stored(t, list(made.values()))

    def _stored(self, t: Table, folders: list[str]) -> DataFrame:
        spark, schema = self.store.spark, T.StructType.fromDDL(t.schema)
        paths = [f"{self.store.at}/data/{d}" for d in folders]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(self, name: str, changes: DataFrame, deleted: str | None = None) -> list[int]:
        """Rows of changes take the place of those with their key; where the column `deleted` is true they only go. One row a
        key. Only buckets that hold a changed key are read and rewritten; returns these."""
        t = self.tables[name]
        some = kept(changes.withColumn("_b", t.bucket()))
        touched = sorted(r[0] for r in some.select("_b").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return []
        stay = self.read(name, touched).join(some.select(*t.key), t.key, "left_anti")
        new = some.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else some
        cols = [f.name for f in T.StructType.fromDDL(t.schema)]
        made = self._write(t, stay.select(*cols).unionByName(new.select(*cols)), t.key, None)
        for b in map(str, touched):
            t.folders.pop(b, None)
            if b in made:
                t.folders[b] = [made[b]]
        return touched

    def reset(self, name: str) -> None:
        """The table without rows; earlier versions keep theirs."""
        self.tables[name].folders = {}

    def commit(self) -> int:
        body = {"tables": {k: vars(t) for k, t in self.tables.items()}, "meta": self.meta, "batches": self.batches}
        self.store._commit(self.version + 1, body)
        self.version += 1
        return self.version
