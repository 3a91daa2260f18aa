"""Embedding whitening by matrix-free block subspace iteration over centred vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import map_arrow, materialize, table

COMPONENTS = 16
#: Columns of a block beside the components wanted; blocks kept for Rayleigh-Ritz, until the best of them start anew.
SPARE, KEPT = 16, 16
#: A component is certified when its residual is below this part of the largest eigenvalue.
RESIDUAL, MOST_PASSES = 1e-13, 400
#: Entries of a block of rows that a task multiplies at once, and tasks that add up what the others have summed.
BLOCK, ADDERS = 1 << 20, 32
SHIFT = 1_000_000


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x, with x = floor(64 c) + 1,000,000 for each entry c. Rows whose vector is null or holds a null or
    non-finite entry go, and so do rows whose length isn't the one that most rows have (of two such, the longer)."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col("embedding").isNotNull() & ~bad)
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths[0] if lengths else 0
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 64).cast("long") + SHIFT)
    return good.where(F.size("embedding") == d).select(F.col("vec_id").cast("long"), x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their vectors less SHIFT."""
    for batch in batches:
        col = batch.column("x")
        d = len(col[0])
        step = max(1, BLOCK // max(d, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d) - SHIFT


def _doubles(part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.astype(np.float64).tobytes()], pa.binary())], names=["part", "sums"])


def summed(vectors: DataFrame, fn, shape: tuple[int, ...]) -> np.ndarray:
    """fn(rows), an array of the shape, summed over all vectors: within each task, then in ADDERS tasks, then here.

    Tasks are added up in their order, so a rerun on the same rows gives the same sum.
    """

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            total = fn(x) if total is None else total + fn(x)
        if total is not None:
            yield _doubles(TaskContext.get().partitionId(), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, -1
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):  # noqa: B007
                more = np.frombuffer(raw)
                total = more if total is None else total + more
        if total is not None:
            yield _doubles(part, total)

    parts = map_arrow(vectors.select("x"), here, "part int, sums binary")
    got = map_arrow(parts.repartition(ADDERS, F.col("part") % ADDERS).sortWithinPartitions("part"), add, "part int, sums binary").collect()
    total = np.zeros(shape)
    for r in sorted(got):
        total = total + np.frombuffer(r["sums"]).reshape(shape)
    return total


@dataclass
class Whitening:
    """n and S of the fit list (S less n times SHIFT); eigenvalues of the covariance, falling, and their vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: integers of 64 bits where they fit, else Python's."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; None for one of over 63 bits, which a long can't hold."""
        m = self.centred(x)
        if m.dtype == object or int(np.abs(m).max(initial=0)) ** 2 * m.shape[1] >= 1 << 63:
            return [s if (s := sum(v * v for v in row)) < 1 << 63 else None for row in m.tolist()]
        return (m * m).sum(1).tolist()

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x).astype(np.float64) / self.n @ (self.vectors / np.sqrt(self.values))


def _orthonormal(y: np.ndarray, against: np.ndarray | None) -> np.ndarray:
    """QR of y, without what lies in the columns of `against` and without columns that vanish then."""
    for _ in range(3):
        if against is not None:
            y = y - against @ (against.T @ y)
        size = np.linalg.norm(y, axis=0)
        y = y[:, size > 1e-11] / size[size > 1e-11]
        if not y.shape[1]:
            return y
        q, r = np.linalg.qr(y)
        y = q[:, np.abs(np.diag(r)) > 1e-10]
    return y


def leading(product, d: int, k: int, seed: int = 7, spare: int = SPARE, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, int, float]:
    """The k largest eigenvalues and vectors of a symmetric matrix that is known by product(Q) only, one pass over the rows each.

    Each pass multiplies one orthonormal block; Rayleigh-Ritz then looks for the components in all blocks so far, at most
    `kept`, which costs no pass, and what the newest product holds beyond them is the next block. So d columns are
    reached after d / (k + spare) passes at most, where no gap between eigenvalues is needed any more; with more columns
    than are kept the best of them go on, as in plain subspace iteration. It ends when all k residuals are certified.
    """
    rng = np.random.default_rng(seed)
    width = min(d, k + spare)
    q = _orthonormal(rng.normal(size=(d, width)), None)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, MOST_PASSES + 1):
        y = product(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, y])
        h = basis.T @ image
        values, u = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, u = values[order], u[:, order]
        ritz, mapped = basis @ u, image @ u
        m = min(k, len(values))
        gap = np.linalg.norm(mapped[:, :m] - ritz[:, :m] * values[:m], axis=0)
        residual = float(gap.max(initial=0) / max(values[0], 1e-300)) if m else 0.0
        if basis.shape[1] >= d or m == k and residual <= RESIDUAL:
            break
        if basis.shape[1] + width > kept * width:
            basis, image = ritz[:, : 2 * width], mapped[:, : 2 * width]
        # What Ritz vectors' images hold beyond the basis; where that is nothing, directions not yet looked at.
        q = _orthonormal(mapped[:, :width] - ritz[:, :width] * values[:width], basis)[:, : d - basis.shape[1]]
        if q.shape[1] < min(width, d - basis.shape[1]):
            more = rng.normal(size=(d, min(width, d - basis.shape[1]) - q.shape[1]))
            q = np.hstack([q, _orthonormal(more, np.hstack([basis, q]))])
        if not q.shape[1]:
            break
    else:
        raise RuntimeError(f"{k} components are not certified after {MOST_PASSES} passes: residual {residual:.3g}")
    return values[:m], ritz[:, :m], passes, residual


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening:
    """Whitening from each distinct vector once. Every pass over them gives X'(X Q) of the centred rows, d by a block's
    columns, however many rows there are; the covariance itself is never built.

    Components whose eigenvalue is zero, to double precision, have no direction to be scaled and are left out: fewer than k are
    found where the vectors span less. Without vectors there are none.
    """
    first = vectors.select(F.size("x")).first()
    d = first[0] if first else 0
    n = vectors.count()
    if not d:
        return Whitening(n, [], np.zeros(0), np.zeros((d, 0)), 0.0, 0, 0.0)
    # Sums as integers in two halves, each exact in doubles.
    halves = summed(vectors, lambda x: np.stack([(x >> 20).sum(0), (x & ((1 << 20) - 1)).sum(0)]), (2, d))
    sums = [(int(a) << 20) + int(b) for a, b in zip(halves[0], halves[1], strict=True)]
    w = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0, 0.0)
    centred = lambda x: w.centred(x).astype(np.float64) / n
    w.trace = float(summed(vectors, lambda x: (centred(x) ** 2).sum(0), (d,)).sum() / n)

    def product(q: np.ndarray) -> np.ndarray:
        def one(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return summed(vectors, one, (d, q.shape[1])) / n

    if w.trace > 0:
        values, found, w.passes, w.residual = leading(product, d, min(k, d))
        some = values > 1e-12 * w.trace
        w.values, w.vectors = values[some], found[:, some]
    return w


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance, centred anew, less the identity."""
    k = len(w.values)
    if not k:
        return 0.0
    mean = summed(vectors, lambda x: w.whiten(x).sum(0), (k,)) / w.n

    def square(x: np.ndarray) -> np.ndarray:
        z = w.whiten(x) - mean
        return z.T @ z

    return float(np.abs(summed(vectors, square, (k, k)) / w.n - np.eye(k)).max())


def whitened(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    """One row for each vector of integer_vectors() and component."""
    shared = rows.sparkSession.sparkContext.broadcast(w)  # d by k numbers
    explained = (w.values / w.trace).tolist() if w.trace else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = shared.value, len(explained)
        for part, x in _matrices(batches) if k else ():
            m = part.num_rows
            again = np.repeat(np.arange(m), k)
            cols = [part.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([w.n] * (m * k), pa.int64()), pa.array(w.deviation(x), pa.int64()).take(pa.array(again))]
            cols += [pa.array(w.whiten(x).ravel()), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows.select("vec_id", "x"), run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_subspace_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all vectors in up to 16 components.

    Null ids stay null and repeated rows give repeated results, but a vector that many rows have counts once in the fit. Rows
    that integer_vectors() leaves out, an empty table, and vectors that are all alike give no rows. Other columns are not read.
    """
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    vectors = materialize(rows.select("x").distinct())
    w = fit(vectors)
    return whitened(rows, w, identity_error(vectors, w))
