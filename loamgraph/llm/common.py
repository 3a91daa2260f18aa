"""What the operators of this package share: shared storage, text kernels, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.operators.components import star_components
from loamgraph.operators.storage import kept as materialize

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(rows: DataFrame, key: str) -> DataFrame:
    """rows with _nth: of rows that share the key, 0 for one, 1 for another, and so on; 0 for all others.

    Which of them gets which number is open, so rows that share a key must be interchangeable. A key that a third of
    all rows have is numbered in as many parts as the rows lie in, each in a task of its own.
    """
    many = materialize(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), slim=True)
    if many.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    again = materialize(rows.withColumn("_part", F.spark_partition_id()).join(many, key, "left_semi"))
    counts = again.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(key, "_part", F.coalesce(before, F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(key))
    numbered = again.withColumn("_within", within).join(begins, [key, "_part"]).withColumn("_nth", F.col("_begin") + F.col("_within") - 1)
    once = rows.join(many, key, "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    return once.unionByName(numbered.select(*once.columns))


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can: idle Python workers keep none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with empty batches left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fn(b for b in batches if b.num_rows):
            if batch.num_rows:
                yield batch
        give_back()

    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column holds about `most` bytes in each; a longer single text stays whole."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Texts:
    """The words of a batch of texts as arrays over one UTF-8 buffer; null counts as empty.

    A slice holds about 256 KB of texts, and a longer text is a slice of its own. Beside its bytes it takes 7 bytes a
    byte and some 30 a word, and hashes are taken in blocks: a text of 100 MB needs about 1.5 GB.
    """

    _space = np.zeros(256, dtype=bool)
    _space[[0x20, *range(0x09, 0x0E)]] = True

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_utf8())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.n = n
        self.offsets = offsets - offsets[0]
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.bytes = raw
        # A word starts where a byte that is no space follows a space or a text's start.
        word = ~self._space[raw]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[self.offsets] = True
        before = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0] = False
            before[1:] = word[:-1]
        start = word & (~before | first[:-1])
        after = np.empty(len(raw), dtype=bool)
        if len(raw):
            after[-1] = False
            after[:-1] = word[1:]
        end = word & (~after | first[1:])
        self.is_word = word
        self._hashes = None
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        # Words of text i: bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes with the flag each text has."""
        out = np.zeros(self.n, dtype=np.int64)
        some = self.offsets[1:] > self.offsets[:-1]
        if some.any():
            out[some] = np.add.reduceat(flags.view(np.uint8), self.offsets[:-1][some], dtype=np.int64)
        return out

    def word_hashes(self) -> np.ndarray:
        """64-bit hashes of the words: a polynomial over the bytes modulo 2^64, mixed with the length."""
        if self._hashes is None:
            self._hashes = run_hashes(self.bytes, self.starts, self.ends)
        return self._hashes

    def windows(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every run of k words, in order. short: a text of fewer words gives its whole sequence."""
        h = self.word_hashes()
        total = len(h)
        doc = np.repeat(np.arange(self.n), self.n_words)
        if total >= k:
            w = combine([h[i : total - k + 1 + i] for i in range(k)])
            inside = doc[: total - k + 1] == doc[k - 1 :]
            out, docs = w[inside], doc[: total - k + 1][inside]
        else:
            out, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if short:
            few = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
            if len(few):
                more = np.concatenate([combine([h[j : j + 1] for j in range(self.bounds[i], self.bounds[i + 1])]) for i in few])
                out, docs = np.concatenate([out, more]), np.concatenate([docs, few])
                order = np.argsort(docs, kind="stable")
                out, docs = out[order], docs[order]
        return out, docs


_BASE = 0x5851F42D4C957F2D
_BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for the places of one block."""
    if not _POWERS:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(_BLOCK + 1, b, dtype=np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(t, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs values[start:end]: polynomials modulo 2^64, mixed with the length.

    starts ascend. Prefix sums are made a block at a time, so memory beside the runs doesn't grow with the values.
    """
    power, inverse = _powers()
    out, shift = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    order = None if len(values) <= _BLOCK else np.argsort(ends, kind="stable")
    sorted_ends = ends if order is None else ends[order]
    carry, scale, back = 0, 1, 1
    with np.errstate(over="ignore"):
        for at in range(0, max(len(values), 1), _BLOCK):
            part = values[at : at + _BLOCK].astype(np.uint64)
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part + np.uint64(1)) * power[: len(part)], dtype=np.uint64, out=run[1:])
            run = run * np.uint64(scale) + np.uint64(carry)
            if order is None:
                out, shift = run[ends] - run[starts], inverse[starts]
            else:
                lo, hi = np.searchsorted(starts, (at, at + _BLOCK))
                out[lo:hi] -= run[starts[lo:hi] - at]
                shift[lo:hi] = inverse[starts[lo:hi] - at] * np.uint64(back)
                lo, hi = np.searchsorted(sorted_ends, (at, at + _BLOCK), side="right")
                out[order[lo:hi]] += run[sorted_ends[lo:hi] - at]
            carry, scale, back = int(run[-1]), scale * int(power[_BLOCK]) % (1 << 64), back * int(inverse[_BLOCK]) % (1 << 64)
        return mix(out * shift + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes; order and length matter."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        return mix(h)


def unique_per_text(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending, with bounds: text i has values[bounds[i]:bounds[i + 1]]."""
    order = np.argsort(h)
    if n <= 1 << 16:  # then a radix sort puts the texts in order
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def find(parent: dict, x):
    root = x
    while parent[root] != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def contract(pairs: Iterator[tuple[int, int]]) -> dict:
    """Union-find of pairs; the root of each set is its smallest member."""
    parent: dict = {}
    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return parent


_CONTRACT_EVERY = 1 << 20


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's links as stars around the smallest member it knows; memory is bounded by flushing."""

    def stars(parent: dict) -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := find(parent, x)) != x]
        a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    parent: dict = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > _CONTRACT_EVERY:
            yield stars(parent)
            parent = {}
    yield stars(parent)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by links (a, b), for every node that has a link to another.

    Tasks first contract their own links to stars; rounds of joins do the rest.
    """
    slim = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    stars = star_components(map_arrow(slim, _contract_batches, "a long, b long"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a stream that is sorted by them, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[at]:
                part = batch.slice(at, i - at)
                if held and rows[at] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
                last = rows[at]
                at = i
    if held:
        yield pa.Table.from_batches(held)
