"""Substring deduplication by sliding sentence spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import Texts, map_arrow, run_hashes, sliced, table

#: Sentences or pieces of a span, and words, at least.
RUN, LEAST_WORDS = 3, 20
LENGTHS = 1 << 24
#: A sentence of more words than this is cut where a word's hash says so (one in four) and after a word said
#: three times or more in a row, so that equal passages in text without punctuation are cut alike.
LONG, CUT = 16, np.uint64(3)
#: Pieces are cut so in sentences of any length, and after the least hash of every GAP words in a row without a cut.
GAP = 9
#: Spans a task holds before it tells which of them can't be first, and the tasks that share the others of one span.
HELD, SALTS = 1 << 19, 1 << 16


def ends_of(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each word, and whether it ends a sentence and a piece. A sentence ends after a word that ends in . ! or ?,
    before a line break, at the text's end, or in a long one as the words there say. Pieces end there too, and where
    the words next to it say so, whatever sentence surrounds them: equal passages have equal pieces inside."""
    n = len(t.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    last = t.bytes[t.ends - 1]
    ends = (last == 46) | (last == 33) | (last == 63)
    breaks = np.concatenate([[0], np.cumsum(t.bytes == 10)])
    ends[:-1] |= breaks[t.starts[1:]] > breaks[t.ends[:-1]]
    doc = np.repeat(np.arange(t.n), t.n_words)
    ends[:-1] |= doc[1:] != doc[:-1]
    ends[-1] = True
    # Cuts inside sentences: after words that hash to a cut.
    start = np.concatenate([[True], ends[:-1]])
    h = t.word_hashes()
    same = np.zeros(n, dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    cuts = ((h & CUT) == 0) & ~same
    cuts[1:-1] |= same[1:-1] & same[:-2] & ~same[2:]
    length = np.diff(np.flatnonzero(np.concatenate([start, [True]])))
    long = np.repeat(length > LONG, length)
    pieces = ends | cuts
    if n >= GAP:
        total = np.concatenate([[0], np.cumsum(pieces)])
        free = np.flatnonzero(total[GAP:] == total[:-GAP])
        key = np.where(same, np.uint64(2**64 - 1), h)
        least = free + GAP - 1 - np.argmin(np.lib.stride_tricks.sliding_window_view(key, GAP)[free][:, ::-1], axis=1)
        pieces[least[~same[least]]] = True
    return doc, ends | cuts & long, pieces


def spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of the shortest run from each sentence on that has RUN sentences and LEAST_WORDS words,
    and the same of pieces. The place is LENGTHS times the first piece's number plus the run's length in pieces."""
    doc, *both = ends_of(t)
    n = len(doc)
    pairs = []
    for ends in both:
        stop = np.flatnonzero(ends) + 1
        begin = np.concatenate([[0], stop[:-1]])[: len(stop)]
        # Ends are RUN sentences on, or where the words suffice.
        end = np.maximum(np.arange(len(stop)) + RUN, np.searchsorted(stop, begin + LEAST_WORDS) + 1)
        per = np.searchsorted(stop, t.bounds, side="right")
        ok = np.flatnonzero(end <= per[doc[begin] + 1])
        pairs.append(begin[ok] * (n + 1) + stop[end[ok] - 1])
    first, end = np.divmod(np.unique(np.concatenate(pairs)).astype(np.int64), n + 1)
    number = np.concatenate([[0], np.cumsum(both[1])])
    whole = run_hashes(t.word_hashes(), first, end)
    text = doc[first]
    return whole, text, (number[first] - number[t.bounds[text]]) * LENGTHS + number[end] - number[first]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans with their places. Of a span that HELD spans of the task have more than once, only the least place competes
    for the first (salt 0), once; what comes after it is never first, and goes elsewhere by a salt."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        span = rows.column("span").to_numpy()
        order = np.argsort(span, kind="stable")
        same = span[order][1:] == span[order][:-1]
        shared = np.zeros(len(span), dtype=bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        salt = np.zeros(len(span), dtype=np.int32)
        if not shared.any():
            return rows.append_column("salt", pa.array(salt)).to_batches()[0]
        at = np.flatnonzero(shared)
        some = rows.take(pa.array(at))
        by = np.asarray(pc.sort_indices(some, sort_keys=[("span", "ascending"), ("doc_id", "ascending"), ("key", "ascending"), ("nth", "ascending")], null_placement="at_end"))
        some, at = some.take(pa.array(by)), at[by]
        code = np.asarray(some.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1))
        columns = [some.column("span").to_numpy(), code, some.column("key").to_numpy(), some.column("nth").to_numpy()]
        new = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
        alike = np.concatenate([[False], np.all([c[1:] == c[:-1] for c in columns], axis=0)])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        salt[at] = np.where(new, 0, 1 + (np.arange(len(new)) - begin) % SALTS)
        keep = np.ones(len(span), dtype=bool)
        keep[at[alike]] = False  # rows that are there twice have equal places
        return rows.append_column("salt", pa.array(salt)).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in sliced(batches, "text"):
        h, doc, nth = spans(Texts(batch.column("text")))
        if len(h):
            doc = pa.array(doc)
            held.append(pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("doc_id").take(doc), batch.column("key").take(doc), pa.array(nth)], names=["span", "doc_id", "key", "nth"]))
        if sum(x.num_rows for x in held) >= HELD:
            yield told(held)
    if held:
        yield told(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the pieces of repeated spans out of each text; what stays keeps its own white space. Of a text in several
    copies the first is cut so, and of the others the pieces of all spans."""
    for batch in sliced(batches, "text"):
        t = Texts(batch.column("text"))
        _, sentence, piece = ends_of(t)
        stop = np.flatnonzero(piece) + 1
        begin = np.concatenate([[0], stop[:-1]])[: len(stop)]
        per = np.searchsorted(stop, t.bounds, side="right")
        # Sentences before each word.
        nth = np.concatenate([[0], np.cumsum(sentence)])
        originals = batch.column("text").to_pylist()
        copies = np.asarray(batch.column("copies"))
        more = np.flatnonzero(copies > 1)
        every = {i: [] for i in more.tolist()}
        if len(more):
            _, text, place = spans(t)
            for i in every:
                every[i] = place[np.searchsorted(text, i) : np.searchsorted(text, i, side="right")].tolist()
        texts, cut, words = [], [], []

        def take(i: int, found: list[int] | None) -> None:
            if not found:
                texts.append(originals[i])
                cut.append(0)
                words.append(0)
                return
            gone = np.zeros(per[i + 1] - per[i], dtype=bool)
            for k in found:
                gone[k // LENGTHS : k // LENGTHS + k % LENGTHS] = True
            raw = t.bytes[t.offsets[i] : t.offsets[i + 1]].tobytes()
            b, e = begin[per[i] : per[i + 1]], stop[per[i] : per[i + 1]]
            # A piece reaches to the start of the next one.
            lo = t.starts[b] - t.offsets[i]
            hi = np.concatenate([lo[1:], [len(raw)]])
            kept = b"".join(raw[x:y] for x, y, g in zip(lo.tolist(), hi.tolist(), gone.tolist(), strict=True) if not g)
            texts.append((raw[: lo[0]] + kept).decode())
            cut.append(len(np.unique(nth[b[gone]])))
            words.append(int((e - b)[gone].sum()))

        for i, found in enumerate(batch.column("found").to_pylist()):
            take(i, found)
        n_sentences = np.diff(nth[t.bounds]).astype(np.int64)
        ids = batch.column("doc_id")
        yield _rows(ids, n_sentences, cut, words, texts)
        for i, places in every.items():
            take(i, places)
            # In batches of about a slice.
            most, left = 1 + (1 << 18) // (1 + len(texts[-1] or "")), int(copies[i]) - 1
            while left:
                n = min(most, left)
                yield _rows(ids.take(pa.array([i] * n)), np.repeat(n_sentences[i], n), cut[-1:] * n, words[-1:] * n, texts[-1:] * n)
                left -= n


def _rows(ids: pa.Array, n_sentences: np.ndarray, cut: list[int], words: list[int], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n_sentences), pa.array(cut, pa.int64()), pa.array(words, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_sentences", "cut_sentences", "cut_words", "text"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, cut_sentences, cut_words and the text without the pieces of sentences covered by any span
    that stood before: of equal spans the one in the smallest doc_id, and there the first, stays. cut_sentences
    counts the sentences that lost a piece or all.

    Spans are runs of RUN sentences, and of RUN pieces of sentences, more where these have fewer than LEAST_WORDS words,
    compared word by word with their case. A passage of 51 words is found wherever it starts and ends, unless it says
    one word GAP times in a row; up to some words at its edges stay. Texts of fewer sentences stay whole, as null and empty ones do.

    Rows are told apart by doc_id and a hash of the text. Different texts of one doc_id, or without one, are cut each by
    what it repeats; the smallest hash is first, null ids after all others. Rows that repeat a doc_id and its text are cut
    alike; of equal texts without a doc_id the others lose what the first one has said. An empty table gives no rows, other
    columns are not read, and a text of any length is cut whole, by one task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = F.xxhash64("text")
    # 32 bits tell the few texts of one id apart, and keep the shuffle small.
    key = F.when(F.col("doc_id").isNull(), whole).otherwise(whole.bitwiseAND(F.lit((1 << 32) - 1)))
    found = map_arrow(docs.select("doc_id", "text", key.alias("key")), _emit, f"span long, doc_id {kind}, key long, nth long, salt int")
    # All but the first place of each span; equal rows have equal places.
    nth = F.rank().over(Window.partitionBy("span", "salt").orderBy(F.asc_nulls_last("doc_id"), "key", "nth"))
    again = found.withColumn("rank", nth).where("salt > 0 or rank > 1")
    by_row = again.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("nth")).alias("found"))
    nulls = docs.where("doc_id is null").groupBy("text").agg(F.count("*").alias("copies"), F.first("doc_id").alias("doc_id"))
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.lit(1).cast("long").alias("copies")).union(nulls.select("doc_id", "text", "copies"))
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.key") == F.col("b.key"))
    held = rows.withColumn("key", key).alias("d").join(by_row.alias("b"), same, "left").select("d.doc_id", "d.text", "d.copies", "b.found")
    return map_arrow(held, _cut, f"doc_id {kind}, n_sentences long, cut_sentences long, cut_words long, text string")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup() of all documents; nulls, repeated rows and the rest as it says."""
    return dedup(table(spark, sf_dir, "documents"))
