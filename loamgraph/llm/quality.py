"""Quality rules under weak supervision: rules vote or abstain, and a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import Texts, combine, map_arrow, materialize, run_hashes, sliced, table

ABSTAIN, BAD, GOOD = 0, 1, 2

#: (name, measure, votes bad from or above, votes good up to): in between a rule abstains.
RULES = (
    ("symbols_per_word", "symbols_per_word", 0.10, 0.02),
    ("dup_line_share", "dup_line_share", 0.30, 0.02),
    ("repeat_word_share", "repeat_word_share", 0.20, 0.02),
    ("upper_share", "upper_share", 0.50, 0.15),
    ("shouts_per_word", "shouts_per_word", 0.20, 0.02),
    ("odd_word_length", "odd_word_length", 5.0, 3.0),
    ("non_letter_share", "non_letter_share", 0.30, 0.12),
    ("shortness", "shortness", 1 / 20, 1 / 60),
    ("stutter_share", "stutter_share", 0.40, 0.02),
    ("bars_per_word", "bars_per_word", 0.01, 0.0),
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def measures(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of each text, and the shares the rules look at."""
    b = texts.bytes
    lead = (b & 0xC0) != 0x80
    n_words = texts.n_words.astype(np.int64)
    out = {"n_words": n_words, "word_chars": texts.per_text(texts.is_word & lead), "n_symbols": texts.per_text(_SYMBOL[b])}
    out["n_dup_lines"], n_lines = _dup_lines(texts)
    out["n_repeat_words"] = _repeat_words(texts)
    words = np.maximum(n_words, 1)
    ascii_letters = np.maximum(texts.per_text(_ALPHA[b]), 1)
    letters = texts.per_text(_ALPHA[b] | (lead & (b >= 128)))
    chars = np.maximum(out["word_chars"], 1)
    out["symbols_per_word"] = out["n_symbols"] / words
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(n_lines, 1)
    out["repeat_word_share"] = out["n_repeat_words"] / words
    out["upper_share"] = texts.per_text(_UPPER[b]) / ascii_letters
    out["shouts_per_word"] = texts.per_text(b == 33) / words
    h = texts.word_hashes()
    same = np.concatenate([[0], np.cumsum(h[1:] == h[:-1]), [0]]) if len(h) else np.zeros(2, np.int64)
    out["stutter_share"] = np.where(n_words > 1, same[np.maximum(texts.bounds[1:] - 1, 0)] - same[np.minimum(texts.bounds[:-1], len(h) and len(h) - 1)], 0) / words
    out["bars_per_word"] = texts.per_text(b == 124) / words
    out["odd_word_length"] = np.abs(out["word_chars"] / words - 6.5)
    out["non_letter_share"] = 1 - letters / chars
    out["shortness"] = 1 / words
    return out


def _dup_lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line, and lines with a word, of each text."""
    b = texts.bytes
    breaks = np.flatnonzero(b == 10)
    starts = np.concatenate([texts.offsets[:-1], breaks + 1])
    ends = np.concatenate([texts.offsets[1:], breaks])
    # The last line of a text begins after its last break; pair starts and ends in order of position.
    starts.sort()
    ends.sort()
    seen = np.concatenate([[0], np.cumsum(texts.is_word, dtype=np.int64)])
    full = seen[ends] > seen[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(texts.offsets, starts, side="right") - 1
    h = run_hashes(b, starts, ends)
    order = np.lexsort((h, doc))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][again], minlength=texts.n), np.bincount(doc, minlength=texts.n)


def _repeat_words(texts: Texts, k: int = 8) -> np.ndarray:
    """Words of each text that lie in a window of k words found twice or more in it, the first time included."""
    h = texts.word_hashes()
    total = len(h)
    if total < k:
        return np.zeros(texts.n, dtype=np.int64)
    doc = np.repeat(np.arange(texts.n), texts.n_words)
    w = combine([h[i : total - k + 1 + i] for i in range(k)])
    at = np.flatnonzero(doc[: total - k + 1] == doc[k - 1 :])
    w, wd = w[at], doc[at]
    order = np.lexsort((w, wd))
    same = (w[order][1:] == w[order][:-1]) & (wd[order][1:] == wd[order][:-1])
    twice = np.zeros(len(w), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:total] > 0)])
    return covered[texts.bounds[1:]] - covered[texts.bounds[:-1]]


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def patterns(m: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all rules as one number in base 3."""
    code = np.zeros(len(m["n_words"]), dtype=np.int64)
    for _, measure, bad, good in RULES:
        x = m[measure]
        code = code * 3 + np.where(x >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN))
    return code


def votes(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], axis=1)


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict:
    """Expectation-maximisation over vote patterns: each rule's accuracy in either class, and the share of good.

    A rule's two rates (P(bad vote | junk), P(bad vote | good)) count only where it votes. The start holds
    a document for junk if any rule votes so; rates are smoothed and a rule may not turn against its meaning.
    """
    v = votes(codes)
    post = np.where((v == BAD).any(axis=1), 0.1, 0.95)
    n = counts.astype(float)
    for _ in range(rounds):
        rate = np.empty((v.shape[1], 2))
        for c, w in enumerate((n * (1 - post), n * post)):
            bad = ((v == BAD) * w[:, None]).sum(0)
            cast = ((v != ABSTAIN) * w[:, None]).sum(0)
            rate[:, c] = (bad + (0.5, 0.02)[c]) / (cast + 1)
        rate[:, 0] = np.maximum(rate[:, 0], rate[:, 1])
        prior = (n @ post + 1) / (n.sum() + 2)
        new = posterior(v, rate, prior)
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    return {"rate": rate, "prior": prior, "posterior": dict(zip(codes.tolist(), post.tolist(), strict=True))}


def posterior(v: np.ndarray, rate: np.ndarray, prior: float) -> np.ndarray:
    """P(good | votes)."""
    log = np.log(np.clip(np.stack([rate, 1 - rate]), 1e-6, 1))  # [bad vote or good vote, rule, class]
    score = np.array([np.log(1 - prior), np.log(prior)]) + (v == BAD) @ log[0] + (v == GOOD) @ log[1]
    return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        m = measures(Texts(batch.column("text")))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        cols = [batch.column("doc_id"), *(pa.array(m[k].astype(np.int64)) for k in names), pa.array(base_failed(m)), pa.array(patterns(m))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *names, "base_failed", "pattern"])


def measured(docs: DataFrame) -> DataFrame:
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern long"
    return map_arrow(docs.select("doc_id", "text"), _measured, schema)


def fit_on(rows: DataFrame) -> dict:
    """The label model over the votes of all rows; what comes to the driver is bounded by 3^rules patterns."""
    got = rows.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    return fit(np.array([r[0] for r in got], dtype=np.int64), np.array([r[1] for r in got], dtype=np.int64))


def judge(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Base measures, base_failed, quality (posterior probability) and kept of every document.

    A null or empty text has no words, so it fails. Repeated rows get equal verdicts, null ids stay null, an empty table
    gives none, and columns other than doc_id and text are not read. A text of any length is measured whole, by one task.
    """
    spark = docs.sparkSession
    rows = materialize(measured(docs))
    model = fit_on(rows)
    if not model["posterior"]:
        return rows.withColumns({"quality": F.lit(0.0), "kept": F.lit(False)})
    known = spark.createDataFrame(list(model["posterior"].items()), "pattern long, quality double")
    return rows.join(F.broadcast(known), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= at_least))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents."""
    got = judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, in all their columns; texts are measured twice and never shuffled.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    known = fit_on(measured(docs))["posterior"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            m = measures(Texts(batch.column("text")))
            good = np.array([known.get(x, 0.0) >= 0.5 for x in patterns(m).tolist()], dtype=bool)
            yield batch.filter(pa.array(good & ~base_failed(m)))

    return map_arrow(docs, keep, docs.schema)
