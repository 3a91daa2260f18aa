"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import Texts, map_arrow, materialize, sliced, table
from loamgraph.llm.quality import measures

#: Parts of the labelled rows; each in turn judges what the others have taught.
FOLDS = 5
#: Weights of the pooled covariance, and of its own diagonal, that are tried.
POOLED, DIAGONAL = (0.0, 0.1, 0.3, 0.6, 0.9), (0.001, 0.01, 0.05, 0.2, 0.5)
#: Tasks that add up what the others have counted.
ADDERS = 32
#: Steps to a unit of the compressed log-density difference when it is calibrated.
STEPS = 20
NAMES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "shouts", "stutter", "bars", "non_letters", "distinct", "sentence_length", "digits")
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def statistics(texts: Texts) -> np.ndarray:
    """One row a text: its measures, counts on a log scale and shares on one that spreads the small ones.

    They come from the whole text and hold no word of it, so no language is favoured. A text without words is all zeros.
    """
    m = measures(texts)
    words = np.maximum(m["n_words"], 1).astype(float)
    h = texts.word_hashes()
    doc = np.repeat(np.arange(texts.n), texts.n_words)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=texts.n)
    last = texts.bytes[texts.ends - 1] if len(h) else np.zeros(0, np.uint8)
    stops = np.bincount(doc[(last == 46) | (last == 33) | (last == 63)], minlength=texts.n)
    share = lambda x: np.log1p(100 * np.maximum(x, 0))
    out = np.stack(
        [
            np.log1p(m["n_words"]),
            np.log1p(m["word_chars"] / words),
            share(m["symbols_per_word"]),
            share(m["dup_line_share"]),
            share(m["repeat_word_share"]),
            share(m["upper_share"]),
            share(m["shouts_per_word"]),
            share(m["stutter_share"]),
            share(m["bars_per_word"]),
            share(m["non_letter_share"]),
            np.log(np.maximum(distinct, 1) / words) / np.log(words + 2),
            np.log(words / (stops + 1)),
            share(texts.per_text(_DIGIT[texts.bytes]) / words),
        ],
        axis=1,
    )
    out[m["n_words"] == 0] = 0
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        x = statistics(Texts(batch.column("text"))).astype(np.float64)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its whole text; nothing else of a document goes on from here."""
    return map_arrow(docs.select("doc_id", "text"), _measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, len(NAMES)))


@dataclass
class Sums:
    """Count, mean, and squares around the mean, of one class: all that a Gaussian needs, and they add up exactly."""

    n: float
    mean: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Sums:
        mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        return cls(float(len(x)), mean, (x - mean).T @ (x - mean))

    def __add__(self, other: Sums) -> Sums:
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        return Sums(n, self.mean + gap * (other.n / n), self.square + other.square + np.outer(gap, gap) * (self.n * other.n / n))

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n], self.mean, self.square.ravel()])

    @classmethod
    def read(cls, flat: np.ndarray) -> Sums:
        d = len(NAMES)
        return cls(float(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each label and fold in this task."""
    part, sums = TaskContext.get().partitionId(), {}
    for batch in batches:
        x, y, fold = matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for key in set(zip(y.tolist(), fold.tolist(), strict=True)):
            more = Sums.of(x[(y == key[0]) & (fold == key[1])])
            sums[key] = sums[key] + more if key in sums else more
    yield _sums_batch(part, sums)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = {}
    for batch in batches:
        for y, fold, flat in zip(*(batch.column(c).to_pylist() for c in ("y", "fold", "sums")), strict=True):
            more = Sums.read(np.array(flat))
            sums[y, fold] = sums[y, fold] + more if (y, fold) in sums else more
    yield _sums_batch(TaskContext.get().partitionId(), sums)


def _sums_batch(part: int, sums: dict) -> pa.RecordBatch:
    keys = sorted(sums)
    cols = [pa.array([part] * len(keys), pa.int32()), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].flat().tolist() for k in keys], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cols, names=["part", "y", "fold", "sums"])


def gather(rows: DataFrame) -> dict[tuple[int, int], Sums]:
    """Sums by (label, fold) of rows (x, y, fold): added up in the tasks, then in ADDERS, and the last of them here."""
    schema = "part int, y int, fold int, sums array<double>"
    parts = map_arrow(rows.select("x", "y", "fold"), _summed, schema).repartition(ADDERS, F.col("part") % ADDERS).sortWithinPartitions("part")
    out: dict[tuple[int, int], Sums] = {}
    for r in sorted(map_arrow(parts, _added, schema).collect()):
        key, more = (r["y"], r["fold"]), Sums.read(np.array(r["sums"]))
        out[key] = out[key] + more if key in out else more
    return out


@dataclass
class Gaussian:
    """A class's log density by the Cholesky factor of its covariance, which is taken once."""

    mean: np.ndarray
    inverse: np.ndarray  # of the factor
    offset: float

    @classmethod
    def fit(cls, s: Sums, pooled: np.ndarray, scale: np.ndarray, weights: tuple[float, float]) -> Gaussian:
        own = s.square / max(s.n, 1)
        a, b = weights
        mixed = (1 - a) * own + a * pooled
        # Diagonal of the mixture, and of all rows, so that a statistic that a class always has alike keeps a width.
        cov = (1 - b) * mixed + b * np.diag(np.diag(mixed)) + 0.01 * np.diag(scale)
        factor = np.linalg.cholesky(cov)
        return cls(s.mean, np.linalg.inv(factor), -float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.offset - 0.5 * (z * z).sum(1)

    def log_likelihood(self, s: Sums) -> float:
        """Of all rows behind s; their sums suffice."""
        gap = self.inverse @ (s.mean - self.mean)
        return s.n * self.offset - 0.5 * (np.einsum("ij,jk,ik->", self.inverse, s.square, self.inverse) + s.n * gap @ gap)


@dataclass
class Model:
    """Log-density difference of good and bad, and the scale from it to a probability. Without a class: a constant."""

    classes: tuple[Gaussian, Gaussian] | None
    slope: float
    shift: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """The difference, large ones compressed."""
        if self.classes is None:
            return np.zeros(len(x))
        bad, good = self.classes
        return np.arcsinh(good.log_density(x) - bad.log_density(x))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(x) + self.shift, -60, 60)))


def _classes(sums: dict[tuple[int, int], Sums], weights: tuple[float, float], without: int | None = None) -> tuple[Gaussian, Gaussian] | None:
    both = [_total(s for (y, fold), s in sums.items() if y == label and fold != without) for label in (0, 1)]
    if not all(s.n for s in both):
        return None
    pooled = sum(s.square for s in both) / sum(s.n for s in both)
    whole = both[0] + both[1]
    scale = np.maximum(np.diag(whole.square) / whole.n, 1e-4)
    return tuple(Gaussian.fit(s, pooled, scale, weights) for s in both)


def _total(parts) -> Sums:
    out = Sums(0.0, np.zeros(len(NAMES)), np.zeros((len(NAMES),) * 2))
    for s in parts:
        out = out + s
    return out


def choose(sums: dict[tuple[int, int], Sums]) -> tuple[float, float]:
    """The weights under which each fold is likeliest by what the other folds teach; either label counts as much."""
    best = None
    n = [sum(s.n for (y, _), s in sums.items() if y == label) for label in (0, 1)]
    for a in POOLED:
        for b in DIAGONAL:
            total = 0.0
            for fold in {f for _, f in sums}:
                classes = _classes(sums, (a, b), fold)
                if classes is None:
                    continue
                total += sum(classes[y].log_likelihood(s) / n[y] for (y, f), s in sums.items() if f == fold)
            if best is None or total > best[0]:
                best = (total, (a, b))
    return best[1]


def _calibrated(rows: DataFrame, sums: dict[tuple[int, int], Sums], weights: tuple[float, float]) -> tuple[float, float]:
    """Logistic regression of the labels on the evidence of rows that the model hasn't seen: each fold is judged by the
    others. Counts of a bounded number of steps of evidence come here."""
    models = {fold: Model(_classes(sums, weights, fold), 1.0, 0.0) for fold in range(FOLDS)}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = matrix(batch.column("x")), batch.column("fold").to_numpy()
            z = np.zeros(len(x))
            for f in np.unique(fold).tolist():
                z[fold == f] = models[f].evidence(x[fold == f])
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(z * STEPS).astype(np.int64)), batch.column("y")], names=["step", "y"])

    got = np.array(map_arrow(rows.select("x", "y", "fold"), judged, "step long, y int").groupBy("step", "y").count().collect(), dtype=float)
    z, y, n = got[:, 0] / STEPS, got[:, 1], got[:, 2]
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w, g = n * p * (1 - p), n * (p - y)
        # Held lightly to (1, 0).
        grad = np.array([(g * z).sum() + (a - 1), g.sum() + b])
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labelled documents of rows (see measured()) that are not held out, not from a sample.

    A document is held out if the crc32 of its id is a multiple of 5. An id labelled twice has its higher label; documents
    that share it all count. Null ids and labels are left out. With one label, or none, the model is a constant.
    """
    key = F.col("doc_id").cast("string").cast("binary")
    known = labels.where("quality is not null and doc_id is not null").where(F.crc32(key) % 5 != 0).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    known = known.where("y in (0, 1)").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    taught = materialize(rows.join(known, "doc_id").select("x", "y", "fold"))
    sums = gather(taught)
    n = [sum(s.n for (y, _), s in sums.items() if y == label) for label in (0, 1)]
    if not all(n):
        return Model(None, 1.0, float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    weights = choose(sums)
    return Model(_classes(sums, weights), *_calibrated(taught, sums, weights))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of measured(); equal texts score alike."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two means and factors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value(matrix(batch.column("x"))))], names=["doc_id", "score"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op12_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of their labels.

    Texts are read once, whole; only their statistics are stored. Null and empty texts are scored as a text of zeros. Repeated
    rows score alike, null ids stay null (and are not held out), an empty table gives no rows, and other columns are not
    read. A very long text is measured by one task.
    """
    rows = materialize(measured(table(spark, sf_dir, "documents")))
    scored = score(rows, train(rows, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
