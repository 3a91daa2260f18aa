"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamgraph.llm.common import Texts, map_arrow, mix, sliced, table, unique_per_text

#: Words of a shingle, and the share of an item's shingles that a document must hold.
SHINGLE, CONTAINED = 5, 0.8
#: MinHash functions. One equal value of an item and a block makes a candidate.
HASHES = 16
#: Text of the test items handled at a time; more items take more passes over the documents.
BLOCK_BYTES = 16 << 20

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _permuted(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th order of shingles: an odd multiple of the hash, its high bits folded in."""
    with np.errstate(over="ignore"):
        x = h * _SEEDS[j]
        return x ^ (x >> np.uint64(32))


class Items:
    """The test items of one block, in classes by size.

    An item of n shingles is in the class of the power of two s with s / 2 < n <= s. Documents are cut
    into blocks of s / 4 shingles for it, so wherever the item stands, several blocks lie inside it; in each
    of those the smallest values are those of the item's own shingles.
    """

    def __init__(self, ids: list, texts: pa.Array):
        t = Texts(texts, lower=True)
        h, doc = t.windows(SHINGLE)
        self.ids = ids
        self.values, self.bounds = unique_per_text(h, doc, t.n)
        n = np.diff(self.bounds)
        self.size = n
        self.need = np.ceil(n * CONTAINED - 1e-9).astype(np.int64)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        log = np.where(n > 0, np.ceil(np.log2(np.maximum(n, 1))).astype(int), -1)
        for c in sorted(set(log[log >= 0].tolist())):
            who = np.flatnonzero(log == c)
            signatures = []
            for j in range(HASHES):
                least = np.array([_permuted(self.values[self.bounds[i] : self.bounds[i + 1]], j).min() for i in who], dtype=np.uint64)
                order = np.argsort(least, kind="stable")
                signatures.append((least[order], who[order]))
            self.classes[max(0, c - 2)] = self.classes.get(max(0, c - 2), [])
            self.classes[max(0, c - 2)].append(signatures)

    def candidates(self, h: np.ndarray, doc: np.ndarray, n: int) -> set[tuple[int, int]]:
        """(document, item) pairs with an equal MinHash value of the item and of a block of the document."""
        found: set[tuple[int, int]] = set()
        if not self.classes or not len(h):
            return found
        begin = np.searchsorted(doc, np.arange(n))
        nth = np.arange(len(h)) - begin[doc]
        for j in range(HASHES):
            value, owner, at, level = _permuted(h, j), doc, nth, 0
            for c in sorted(self.classes):
                # Blocks of 2^level become blocks of 2^c by the smallest of each run.
                if c > level:
                    first = np.flatnonzero((at % (1 << (c - level)) == 0))
                    value, owner, at = np.minimum.reduceat(value, first), owner[first], at[first] >> (c - level)
                    level = c
                for signatures in self.classes[c]:
                    least, who = signatures[j]
                    where = np.searchsorted(least, value)
                    where[where == len(least)] = 0
                    for k in np.flatnonzero(least[where] == value).tolist():
                        i = int(where[k])
                        while i < len(least) and least[i] == value[k]:
                            found.add((int(owner[k]), int(who[i])))
                            i += 1
        return found

    def search(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(document, item, shingles found) of every candidate that holds enough of the item."""
        t = Texts(column, lower=True)
        h, doc = t.windows(SHINGLE)
        found = self.candidates(h, doc, t.n)
        if not found:
            return []
        out, now, own = [], -1, None
        bounds = np.searchsorted(doc, np.arange(t.n + 1))
        for d, i in sorted(found):
            if d != now:
                now, own = d, np.unique(h[bounds[d] : bounds[d + 1]])
            mine = self.values[self.bounds[i] : self.bounds[i + 1]]
            at = np.searchsorted(own, mine)
            common = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
            if common >= self.need[i]:
                out.append((d, i, common))
        return out


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The test items in blocks of about `most` bytes, each small enough to send to every executor."""
    known = benchmark.where("text is not null").select("item_id", "text")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        part = known if n == 1 else known.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        got = part.toArrow().combine_chunks().sort_by("item_id")
        text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
        yield Items(got.column("item_id").to_pylist(), text)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_shingles, found): every document with at least CONTAINED of an item's shingles.

    Shingles are SHINGLE words in a row, A-Z lower-cased, as a set over the whole document. Items of fewer words
    have no shingle and match nothing: one or four words are in clean documents too. Null texts match nothing. Repeated
    rows of either side give repeated pairs, null ids stay null, ids are of any type, and other columns are not read.
    Without items or documents the result is empty. A document of any length is searched whole, by one task. Where an
    item's shingles stand together, the 16 hashes miss less than one in 10^6; scattered in pieces over the document they
    can be missed, though CONTAINED leaves pieces so long that none of 900 tried was.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, item_shingles long, found long"
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            it = shared.value
            for batch in sliced(batches, "text"):
                hits = it.search(batch.column("text"))
                d = pa.array([x[0] for x in hits], pa.int64())
                ids = pa.array([it.ids[x[1]] for x in hits], id_type)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(d), ids, pa.array([int(it.size[x[1]]) for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.int64())], names=["doc_id", "item_id", "item_shingles", "found"])

        part = map_arrow(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, in all their columns, that hold no test item; they are filtered where they lie.

    Null and empty texts hold none and stay, repeated rows go or stay together; the rest is as search() says.
    """
    spark = docs.sparkSession
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[x[0] for x in shared.value.search(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op6_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of all documents for the benchmark's items."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """clean() by the benchmark's items: a document that holds one goes."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
ish AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS item_shingles FROM ish GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS found
FROM ish JOIN ds USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 5 * count(*) >= 4 * item_shingles
"""
