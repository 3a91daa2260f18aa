"""A stored inverted index: postings by term, bounds of blocks of texts, and exact top-k search that reads few of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import STOPWORDS, spaced_words, stem_of, terms_of
from loamgraph.operators.rank import LENGTH_PENALTY, SATURATION
from loamgraph.operators.storage import drop, kept
from loamgraph.sources.store import Commit, Store

#: Texts of a block, about; texts, of the first that are put, to a bucket of terms, of which there are 8 to 1,024; and to a
#: part of a bucket by block, of which there are 4 to 64, so that a term of all texts isn't one task's.
BLOCK, PER_BUCKET, PER_PART = 128, 8192, 1 << 19
#: Blocks scored first, to learn the least score that counts; blocks whose numbers a filter may list.
FIRST, LISTED = 4, 2000
#: Postings that one task sorts and writes, about; characters that Python splits at once.
PER_TASK, AT_ONCE = 1 << 20, 1 << 21

POSTINGS = "term string, id string, block long, seg int, tf int, n int"
#: What a segment adds to a term's texts in a block: most occurrences, shortest text, number of texts (less where they go).
BOUNDS = "term string, block long, tf int, n int, texts long"
TEXTS = "id string, n int, seg int"
GONE = "id string, seg int"
SAID = "id string, n int, said array<struct<term: string, tf: int>>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of AT_ONCE characters together, about; a longer text is a piece of its own."""
    for batch in batches:
        ends, at = np.cumsum(pc.utf8_length(batch.column("words")).to_numpy(zero_copy_only=False)), 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            yield batch.slice(at, to - at)
            at = to


def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, words with spaces between) as SAID: how many words but the stopwords, and how often each stem is said. A
    text's words are counted where it lies, so only its terms are shuffled, and once."""
    left_out = {"", *STOPWORDS}
    for piece in _pieces(batches):
        words = pc.split_pattern(piece.column("words"), " ")
        flat = words.flatten().dictionary_encode()
        # Each distinct word of the piece is stemmed once.
        codes: dict[str, int] = {}
        code = np.array([-1 if w in left_out else codes.setdefault(stem_of(w), len(codes)) for w in flat.dictionary.to_pylist()] or [-1])
        term, text = code[flat.indices.to_numpy()], pc.list_parent_indices(words).to_numpy()
        text, term = text[term >= 0], term[term >= 0]
        pairs, tf = np.unique(text * max(1, len(codes)) + term, return_counts=True)
        of, term = np.divmod(pairs, max(1, len(codes)))
        both = pa.StructArray.from_arrays([pa.array(codes, pa.string()).take(pa.array(term)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
        ends = np.searchsorted(of, np.arange(len(piece) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(np.bincount(text, minlength=len(piece)).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), both)], names=["id", "n", "said"])


class Index:
    """Texts (id, text) as postings in a Store. put() adds texts, or replaces those of the same id; remove() takes them out;
    search() finds the best. A version of the store is one state of the index, with its corpus figures.

    A text is split once, when it is put. A search reads the buckets of its own terms: first their bounds, then the
    postings of the blocks that can hold a result.
    """

    def __init__(self, store: Store, blocks: int | None = None):
        """blocks: how many there are once for all; by default as many as the first texts fill."""
        self.store, self.blocks = store, blocks

    def _begin(self, now: Commit, rows: DataFrame) -> None:
        if "blocks" in now.meta:
            return
        n = rows.count()
        for name, schema, key in (("postings", POSTINGS, ["term"]), ("bounds", BOUNDS, ["term"]), ("texts", TEXTS, ["id"]), ("gone", GONE, ["id"])):
            now.create(name, schema, key, min(1024, max(8, n // PER_BUCKET)))
        now.meta |= {"blocks": self.blocks or max(1, n // BLOCK), "parts": min(64, 4 + n // PER_PART), "seg": 0, "texts": 0, "words": 0}

    @staticmethod
    def _block(now: Commit) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(now.meta["blocks"]))

    @staticmethod
    def _add(now: Commit, name: str, rows: DataFrame, block: Column, then: Callable, tasks: int | None = None, whole: bool = False) -> DataFrame:
        """Rows by term and block to a table, or in place of it; as they are stored."""
        return (now.overwrite if whole else now.append)(name, rows, ["term", "block"], F.pmod(block, F.lit(now.meta["parts"])), then, tasks)

    def _add_bounds(self, now: Commit, rows: DataFrame, tasks: int | None = None, whole: bool = False, gone: bool = False) -> None:
        """The bounds of postings, or less texts where these are gone. A term's rows of a block are together once they are dealt
        for the write, so they are shuffled once."""
        tf, n, texts = (F.lit(0), F.lit(None).cast("int"), -F.count("*")) if gone else (F.max("tf"), F.min("n"), F.count("*"))
        bounds = lambda dealt, place: dealt.groupBy(*place, "term", "block").agg(tf.alias("tf"), n.alias("n"), texts.alias("texts"))
        self._add(now, "bounds", rows.select("term", "block", *(() if gone else ("tf", "n"))), F.col("block"), bounds, tasks, whole)

    def put(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds or replaces texts, one row an id; null ids are left out, a null text has no words."""

        def change(now: Commit) -> None:
            self._begin(now, rows)
            seg = now.meta["seg"] = now.meta["seg"] + 1
            words = rows.where("id is not null").select(F.col("id").cast("string").alias("id"), spaced_words(F.col("text")).alias("words"))
            split = kept(words.mapInArrow(said, SAID))
            self._take_out(now, split.select("id"), seg)
            n = split.agg(F.coalesce(F.sum(F.size("said")), F.lit(0))).first()[0]
            tasks = max(split.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PER_TASK))
            # The block follows from the id, so it needn't be shuffled.
            whole = lambda dealt, place: dealt.select(*place, "term", "id", self._block(now).alias("block"), F.lit(seg).alias("seg"), "tf", "n")
            stored = self._add(now, "postings", split.select("id", "n", F.inline("said")), self._block(now), whole, tasks)
            self._add_bounds(now, stored, tasks)
            now.append("texts", split.select("id", "n", F.lit(seg).alias("seg")))
            self._count(now, split, 1)
            drop(split)

        return self.store.update(change, batch)

    def remove(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Takes out the texts of the ids (id)."""

        def change(now: Commit) -> None:
            self._begin(now, ids)
            seg = now.meta["seg"] = now.meta["seg"] + 1
            self._take_out(now, ids.where("id is not null").select(F.col("id").cast("string").alias("id")).distinct(), seg)

        return self.store.update(change, batch)

    def _take_out(self, now: Commit, ids: DataFrame, seg: int) -> None:
        """Marks what older segments hold of the ids as gone, and counts it out of bounds and corpus figures."""
        old = kept(now.read("texts").join(ids, "id", "left_semi"), slim=True)
        if old.isEmpty():
            return
        dead = now.read("postings").join(old.select("id", "seg", self._block(now).alias("block")), ["id", "seg", "block"], "left_semi")
        self._add_bounds(now, dead, gone=True)
        now.merge("gone", old.select("id", F.lit(seg).alias("seg")))
        now.merge("texts", old.withColumn("out", F.lit(True)), "out")
        self._count(now, old, -1)

    @staticmethod
    def _count(now: Commit, rows: DataFrame, sign: int) -> None:
        n, words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        now.meta["texts"] += sign * n
        now.meta["words"] += sign * words

    def compact(self) -> int:
        """Postings and bounds without what is gone, in one segment's files."""

        def change(now: Commit) -> None:
            live = self._live(now, now.read("postings"))
            stored = self._add(now, "postings", live, F.col("block"), lambda dealt, place: dealt, whole=True)
            self._add_bounds(now, stored, whole=True)
            now.reset("gone")

        return self.store.update(change)

    @staticmethod
    def _live(now: Commit, postings: DataFrame) -> DataFrame:
        if not now.tables["gone"].folders:
            return postings
        gone = now.read("gone").select("id", F.col("seg").alias("_gone"))
        return postings.join(gone, "id", "left").where("_gone is null or seg >= _gone").drop("_gone")

    def search(self, query: str, take: int | None = None, version: int | None = None) -> DataFrame:
        """(id, lexical): BM25 over the best score of all texts that share a word with the query, or the `take` best of them, ties by id.

        The `take` best are exact: the texts of the blocks with the highest bounds are scored first, and the score of their
        last then rules out every block whose bound is below it. Bounds hold whatever the mean length becomes.
        """
        now = self.store.state(version)
        terms, spark = terms_of(query), self.store.spark
        none = spark.createDataFrame([], "id string, lexical double")
        if not terms or not now.meta.get("texts"):
            return none
        buckets = sorted({now.bucket_of("postings", t) for t in terms})
        bounds = now.read("bounds", buckets).where(F.col("term").isin(terms)).groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("n").alias("n"), F.sum("texts").alias("texts"))
        bounds = kept(bounds.where("texts > 0"), slim=True)
        df = dict(bounds.groupBy("term").agg(F.sum("texts")).collect())
        if not df:
            return none
        docs, mean = now.meta["texts"], now.meta["words"] / now.meta["texts"]

        def part(term: str, tf: Column, n: Column) -> Column:
            idf = math.log(1 + (docs - df[term] + 0.5) / (df[term] + 0.5))
            return F.lit(idf) * tf * (SATURATION + 1) / (tf + SATURATION * (1 - LENGTH_PENALTY + LENGTH_PENALTY * n / F.lit(mean)))

        known = [t for t in terms if t in df]

        def total(rows: DataFrame, by: str) -> DataFrame:
            """Scores by the key; terms are added in the query's order, as a scan adds them."""
            of = lambda t, c: F.when(F.col("term") == t, F.col(c).cast("double"))
            said = rows.groupBy(by).agg(*(f(of(t, c)).alias(f"{c}{i}") for i, t in enumerate(known) for f, c in ((F.max, "tf"), (F.min, "n"))))
            parts = [F.coalesce(part(t, F.col(f"tf{i}"), F.col(f"n{i}")), F.lit(0.0)) for i, t in enumerate(known)]
            return said.select(by, reduce(lambda a, b: a + b, parts).alias("raw"))

        def scored(blocks: DataFrame | None) -> DataFrame:
            rows = now.read("postings", buckets).where(F.col("term").isin(known))
            if blocks is not None:
                few = [r[0] for r in blocks.select("block").limit(LISTED + 1).collect()]
                # Files are sorted by term and block, so a list of blocks skips most of them.
                rows = rows.where(F.col("block").isin(few)) if len(few) <= LISTED else rows.join(blocks.select("block"), "block", "left_semi")
            return total(self._live(now, rows), "id")

        if take is None:
            found = kept(scored(None), slim=True)
            best = found.agg(F.max("raw")).first()[0]
            return found.select("id", (F.col("raw") / best).alias("lexical"))
        ceilings = kept(total(bounds, "block"), slim=True)
        first = ceilings.orderBy(F.desc("raw"), "block").limit(max(FIRST, math.ceil(4 * take / BLOCK)))
        least = [r[0] for r in scored(first).orderBy(F.desc("raw"), "id").limit(take).select("raw").collect()]
        # A hair below, as sums of bounds and of scores are rounded apart.
        blocks = ceilings.where(F.col("raw") >= least[-1] * (1 - 1e-9)) if len(least) == take else None
        top = kept(scored(blocks).orderBy(F.desc("raw"), "id").limit(take), slim=True)
        best = top.agg(F.max("raw")).first()[0]
        return top.select("id", (F.col("raw") / best).alias("lexical"))
