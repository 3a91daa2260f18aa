"""A stored index of vectors: inverted lists around centroids, short codes of what is left, and exact re-ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators import rank
from loamgraph.operators.storage import kept

#: Rows, by hash of the id, that the centroids are learnt from, at most, and of these the ones that measure recall.
SAMPLE, MEASURED = 65_536, 128
#: Vectors of a stored block and queries of a block; candidates that are ranked exactly, as a multiple of those wanted.
ROWS, QUERIES, RERANK = 1024, 128, 8
ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


@dataclass
class Centroids:
    """Directions of the lists, and how many of them a search looks into."""

    at: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n lists of each unit vector, the nearest first."""
        score = x @ self.at.T
        some = np.argpartition(-score, min(n, score.shape[1]) - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> list[bytes]:
        """What the list's centroid leaves of each unit vector: its own step, and a byte a dimension of so many steps. So
        vectors close to their centroid are told apart as well as others."""
        left = x - self.at[lists]
        step = np.maximum(np.abs(left).max(1, initial=0), 1e-12) / 127
        codes = np.rint(left / step[:, None]).astype(np.int8)
        return [s.tobytes() + c.tobytes() for s, c in zip(step, codes, strict=True)]

    def decode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The steps, and the codes as numbers."""
        rows = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        return rows[:, :8].copy().view(np.float64)[:, 0], rows[:, 8:].copy().view(np.int8).astype(np.float64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    at = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(part @ at.T, axis=1) for part in np.array_split(x, math.ceil(len(x) / 4096))])
        order = np.argsort(own, kind="stable")
        begins = np.searchsorted(own[order], np.arange(k))
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]))]), begins, axis=0)
        n = np.bincount(own, minlength=k)
        sums[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))] if (n == 0).any() else 0
        at = _unit(sums)
    return at


class VectorIndex:
    """All vectors (id, vector) of one length, in lists of the nearest of about sqrt(rows) centroids; zero vectors are in a list, too.

    Lists are stored as blocks of ROWS vectors, so a list that a third of all rows fall in is many rows. Only centroids
    and the number of lists to look into come from a sample: at most SAMPLE rows, picked by hash of the id, of
    which MEASURED ask for their nearest ones. Every row is indexed.
    """

    def __init__(self, rows: DataFrame, centroids: Centroids, codes: DataFrame):
        self.rows, self.centroids, self.codes = rows, centroids, codes

    @classmethod
    def build(cls, rows: DataFrame, take: int = 20, recall: float = 0.97, seed: int = 3) -> VectorIndex:
        """recall: what the sample's own searches must reach; the least number of lists that does is looked into."""
        good = rows.where("id is not null and size(vector) > 0").select("id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
        counts = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if counts is None:
            raise ValueError("there are no vectors to index")
        d = counts[0]
        good = kept(good.where(F.size("vector") == d))
        n = good.count()
        part = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        sample = good.where(part < int((1 << 30) * min(1.0, SAMPLE / n))).select("vector").limit(2 * SAMPLE).toArrow()
        x = _unit(sample.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, d)) if sample.num_rows else np.zeros((0, d))
        if not len(x):
            x = _unit(np.array([good.first()["vector"]]))
        rng = np.random.default_rng(seed)
        x = x[np.lexsort(x.T[::-1])]
        k = max(1, min(len(x), int(math.sqrt(n))))
        at = _kmeans(x, k, rng)
        own = np.argmax(x @ at.T, axis=1)
        c = Centroids(at, k)
        asked = x[rng.choice(len(x), min(MEASURED, len(x)), replace=False)]
        near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :take]
        place = np.argsort(np.argsort(-(asked @ at.T), axis=1, kind="stable"), axis=1)
        hit = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        c.probes = int(hit[min(len(hit) - 1, math.ceil(recall * len(hit)) - 1)]) + 1
        return cls(good, c, kept(cls._blocks(good, c)))

    @staticmethod
    def _blocks(rows: DataFrame, c: Centroids) -> DataFrame:
        """(list, ids, codes): the vectors of a list, ROWS at a time."""
        kind = rows.schema["id"].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                own = c.nearest(x)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), pa.array(c.encode(x, own), pa.binary())], names=["list", "id", "code"])

        coded = kept(rows.mapInArrow(assign, f"list int, id {kind}, code binary"))
        sizes = coded.groupBy("list").agg(F.count("*").alias("size"))  # as many as there are lists
        dealt = coded.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / ROWS)))
        block = F.collect_list(F.struct("id", "code")).alias("b")
        return dealt.groupBy("list", "part").agg(block).select("list", F.col("b.id").alias("ids"), F.col("b.code").alias("codes"))

    def search(self, queries: DataFrame, take: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score): of every query (id, vector) the `take` rows of the highest cosine among those that its lists
        hold, ties by id. Codes choose RERANK times as many, and their vectors' own cosine ranks these.

        Queries meet the blocks of their lists in blocks of QUERIES; both sides of a large list are many rows.
        """
        c, n, more = self.centroids, probes or self.centroids.probes, take * RERANK
        d = c.at.shape[1]
        kinds = [df.schema["id"].dataType.simpleString() for df in (queries, self.rows)]
        asked = kept(queries.where(F.size("vector") == d).select("id", F.transform("vector", lambda v: v.cast("double")).alias("vector")))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                lists = c.nearest(x, n)
                at = np.repeat(np.arange(len(x)), lists.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column("id").take(pa.array(at)), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["list", "query_id", "q"])

        probed = kept(asked.mapInArrow(probe, f"list int, query_id {kinds[0]}, q binary"))
        sizes = probed.groupBy("list").agg(F.count("*").alias("size"))
        dealt = probed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("size") / QUERIES)))
        blocks = dealt.groupBy("list", "part").agg(F.collect_list(F.struct("query_id", "q")).alias("b")).select("list", F.col("b.query_id").alias("query_ids"), F.col("b.q").alias("qs"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    which = batch.column("list")[i].as_py()
                    ids, own = batch.column("ids")[i].values, batch.column("query_ids")[i].values
                    step, codes = c.decode(batch.column("codes")[i].as_py())
                    q = np.frombuffer(b"".join(batch.column("qs")[i].as_py())).reshape(len(own), d)
                    score = (q @ c.at[which])[:, None] + (q @ codes.T) * step
                    best = np.argpartition(-score, min(more, len(ids)) - 1, axis=1)[:, :more]
                    row = np.repeat(np.arange(len(own)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), ids.take(pa.array(best.ravel())), pa.array(score[row, best.ravel()])], names=["query_id", "id", "about"])

        about = self.codes.join(blocks, "list").mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, about double")
        place = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id"))
        chosen = about.withColumn("place", place("about")).where(F.col("place") <= more).select("query_id", "id")
        exact = chosen.join(self.rows, "id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id")
        scored = exact.select("query_id", "id", rank.cosine(F.col("vector"), F.col("q")).alias("score"))
        return scored.withColumn("place", place("score")).where(F.col("place") <= take).drop("place")
