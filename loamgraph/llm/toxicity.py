"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import Texts, map_arrow, materialize, mix, sliced, table

BUCKETS = 1 << 17
DIM = 16
#: Byte n-grams of a word between its edge marks; the whole word is one more.
GRAMS = (3, 4, 5, 6)
#: Words of a window; windows overlap by half. A window is the sum over its fresh words by WINDOW, and a
#: word is fresh unless one of the WINDOW - 1 before it in its text is the same. A text is as toxic as its worst windows:
#: the mean of one in WORST, MOST_WORST at most.
WINDOW, WORST, MOST_WORST = 8, 16, 8
#: Toxic texts are rare among labelled ones, and a miss costs more than their share says.
EVEN = 0.75
#: Bounds of what is learnt from: labelled rows of either label, and words of each, as windows picked by hash.
MOST_TOXIC, MOST_CLEAN, MOST_WORDS = 1500, 3000, 384


def subwords(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the subwords of words, flattened by word, and where each word's begin (one more at the end)."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    total = int(at[-1])
    word = np.repeat(np.arange(len(starts)), sizes)
    inner = np.arange(total) - at[:-1][word]
    marked = np.full(total, ord("<"), dtype=np.uint64)
    body = (inner > 0) & (inner < sizes[word] - 1)
    marked[body] = texts.bytes[(starts[word] + inner - 1)[body]]
    marked[inner == sizes[word] - 1] = ord(">")
    ids, owner = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(total, dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if total < n:
                break
            rolling = rolling[: total - n + 1] * np.uint64(0x100000001B3) + marked[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                inside = np.flatnonzero(inner[: total - n + 1] + n <= sizes[word[: total - n + 1]])
                ids.append((mix(rolling[inside]) & np.uint64(BUCKETS - 1)).astype(np.int32))
                owner.append(word[inside])
    h = texts.word_hashes()[np.searchsorted(texts.starts, starts)]
    ids.append((mix(h) & np.uint64(BUCKETS - 1)).astype(np.int32))
    owner.append(np.arange(len(starts)))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of every window; a text of fewer words than a window has one."""
    n = np.diff(bounds)
    step = WINDOW // 2
    count = np.where(n > 0, np.maximum(1, np.ceil((n - WINDOW) / step).astype(np.int64) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    # The last window of a text ends with it.
    last = np.maximum(n - WINDOW, 0)[text]
    first = bounds[:-1][text] + np.minimum(nth * step, last)
    return first, np.minimum(first + WINDOW, bounds[1:][text]), text


def fresh(texts: Texts) -> np.ndarray:
    """Whether each word differs from the WINDOW - 1 before it in its text."""
    h = texts.word_hashes()
    out = np.ones(len(h), dtype=bool)
    nth = np.arange(len(h)) - np.repeat(texts.bounds[:-1], texts.n_words)
    for d in range(1, min(WINDOW, len(h))):
        out[d:] &= (h[d:] != h[:-d]) | (nth[d:] < d)
    return out


def rank_in_text(score: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Each window's place among those of its text, the highest score first."""
    order = np.lexsort((-score, text))
    rank = np.empty(len(text), dtype=np.int64)
    rank[order] = np.arange(len(text)) - np.searchsorted(text, np.arange(n))[text[order]]
    return rank


@dataclass
class Model:
    """score: what each subword adds to the log odds of its word; bias: of a window; the rest scales to a document."""

    score: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_scores(self, texts: Texts) -> np.ndarray:
        h = texts.word_hashes()
        if not len(h):
            return np.zeros(0)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        ids, at = subwords(texts, texts.starts[first], texts.ends[first])
        run = np.concatenate([[0.0], np.cumsum(self.score[ids])])
        return ((run[at[1:]] - run[at[:-1]]) / (at[1:] - at[:-1]))[back]

    def worst(self, texts: Texts) -> np.ndarray:
        """Mean log odds of each text's worst windows; the bias alone where there are no words."""
        run = np.concatenate([[0.0], np.cumsum(self.word_scores(texts) * fresh(texts))])
        first, end, text = windows_of(texts.bounds)
        odds = (run[end] - run[first]) / WINDOW + self.bias
        rank = rank_in_text(odds, text, texts.n)
        use = rank < np.clip(np.bincount(text, minlength=texts.n) // WORST, 1, MOST_WORST)[text]
        n = np.bincount(text[use], minlength=texts.n)
        return np.where(n > 0, np.bincount(text[use], odds[use], minlength=texts.n) / np.maximum(n, 1), self.bias)

    def __call__(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.shift, -60, 60)))


def fit(column: pa.Array, labels: np.ndarray, seed: int = 11, passes: tuple[int, ...] = (2, 2, 2)) -> Model:
    """Embeddings and softmax from labelled texts, null ones and repeats included; one label alone gives a constant.

    At first every window has its text's label. Then, round by round, a toxic text keeps only the windows that
    the model so far finds worst, and a clean text its worst windows beside others, so that the toxic words and
    not their surroundings are learnt. The scale from worst windows to probability comes from a third of the texts,
    judged by a model of the others, as a model is too sure of what it has learnt from.
    """
    if labels.min(initial=1) == labels.max(initial=0):
        p = (labels.sum() + 0.5) / (len(labels) + 10)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, math.log(p / (1 - p)))
    m = _trained(column, labels, seed, passes)
    out = np.zeros(len(labels), dtype=bool)
    for y in (0, 1):
        out[np.flatnonzero(labels == y)[::3]] = True
    judged, known = pa.array(np.flatnonzero(out)), pa.array(np.flatnonzero(~out))
    if 0 < labels[~out].sum() < (~out).sum():
        other = _trained(column.take(known), labels[~out], seed, passes)
        m.slope, m.shift = _scale(other.worst(Texts(column.take(judged), lower=True)), labels[out])
    else:
        m.slope, m.shift = _scale(m.worst(Texts(column, lower=True)), labels)
    return m


def _spread(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 ... for lens[0] numbers, then those from begin[1] on, and so on."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())


def _trained(column: pa.Array, labels: np.ndarray, seed: int, passes: tuple[int, ...]) -> Model:
    rng = np.random.default_rng(seed)
    texts = Texts(column, lower=True)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    if not len(texts.starts):
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    _, first_at, word = np.unique(texts.word_hashes(), return_index=True, return_inverse=True)
    ids, at = subwords(texts, texts.starts[first_at], texts.ends[first_at])
    first, end, text = windows_of(texts.bounds)
    # Positions among the fresh words only.
    new = fresh(texts)
    before = np.concatenate([[0], np.cumsum(new)])
    word, first, end = word[new].astype(np.int32), before[first], before[end]
    toxic = labels[text] == 1
    emb2, out2 = np.full(BUCKETS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32)

    def model() -> Model:
        return Model((emb @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]), 1.0, 0.0)

    def odds() -> np.ndarray:
        m = model()
        run = np.concatenate([[0.0], np.cumsum(m.score[ids])])
        w = (run[at[1:]] - run[at[:-1]]) / (at[1:] - at[:-1])
        run = np.concatenate([[0.0], np.cumsum(w[word])])
        return (run[end] - run[first]) / WINDOW + m.bias

    n_windows = np.bincount(text, minlength=texts.n)
    for nth, epochs in enumerate(passes):
        rank = rank_in_text(rng.random(len(text)) if nth == 0 else odds(), text, texts.n)
        if nth == 0:
            use = np.where(toxic, rank < 40, rank < 12)
        else:
            some = rng.random(len(text)) < 12 / np.maximum(n_windows[text], 12)
            use = np.where(toxic, rank < np.maximum(1, np.minimum(16, n_windows[text] // 8)), (rank < 6) | some)
        chosen = np.flatnonzero(use & (end > first))
        weight_toxic = max(1.0, 0.3 * (~toxic[chosen]).sum() / max(1, toxic[chosen].sum()))
        for _ in range(epochs):
            rng.shuffle(chosen)
            for b in range(0, len(chosen), 256):
                part = chosen[b : b + 256]
                lens = end[part] - first[part]
                # Each word of the batch is looked up once.
                own, place = np.unique(word[_spread(first[part], lens)], return_inverse=True)
                grams = at[own + 1] - at[own]
                gi = ids[_spread(at[own], grams)]
                vec = np.add.reduceat(emb[gi], np.concatenate([[0], np.cumsum(grams)[:-1]]), axis=0) / grams[:, None].astype(np.float32)
                win = np.add.reduceat(vec[place], np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0) / WINDOW
                z = win @ out.T + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                y = toxic[part].astype(int)
                g = p.copy()
                g[np.arange(len(part)), y] -= 1
                g = (g * np.where(y == 1, weight_toxic, 1.0)[:, None]).astype(np.float32)
                back = (g @ out) / WINDOW
                g_out = g.T @ win / len(part)
                bias -= 0.1 * g.mean(axis=0)
                out2 += g_out**2
                out -= 0.2 * g_out / np.sqrt(out2)
                order = np.argsort(place, kind="stable")
                of_word = np.add.reduceat(np.repeat(back, lens, axis=0)[order], np.searchsorted(place[order], np.arange(len(own))), axis=0)
                order = np.argsort(gi, kind="stable")
                new = np.flatnonzero(np.concatenate([[True], gi[order][1:] != gi[order][:-1]]))
                hit = gi[order][new]
                grad = np.add.reduceat(np.repeat(of_word / grams[:, None].astype(np.float32), grams, axis=0)[order], new, axis=0)
                emb2[hit] += (grad**2).mean(axis=1)
                emb[hit] -= 0.1 * grad / np.sqrt(emb2[hit])[:, None]
    return model()


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one variable by Newton's method, lightly held to slope 1. Toxic texts weigh so much
    more that the prior is EVEN of the way to an even one, in log odds."""
    weight = np.where(y == 1, max(1.0, (1 - y).sum() / max(1, y.sum())) ** EVEN, 1.0)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        w = weight * p * (1 - p) + 1e-6
        ga, gb = (weight * (p - target) * x).sum() + (a - 1), (weight * (p - target)).sum()
        haa, hab, hbb = (w * x * x).sum() + 1, (w * x).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -5, 5)
    return max(float(a), 1e-3), float(b)


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a text of more than MOST_WORDS words, as many of its windows (end to end) as these hold, by hash, in order."""
    for batch in sliced(batches, "text"):
        t = Texts(batch.column("text"))
        h = t.word_hashes()
        texts = []
        for i in range(t.n):
            raw, begin, end = t.bytes[t.offsets[i] : t.offsets[i + 1]].tobytes(), t.bounds[i], t.bounds[i + 1]
            if end - begin > MOST_WORDS:
                at = np.arange(begin, end, WINDOW)
                order = np.argsort(mix(h[at] + np.arange(len(at), dtype=np.uint64)), kind="stable")
                at = np.sort(at[order[: MOST_WORDS // WINDOW]])
                stop = np.minimum(at + WINDOW, end) - 1
                raw = b" ".join(raw[x:y] for x, y in zip((t.starts[at] - t.offsets[i]).tolist(), (t.ends[stop] - t.offsets[i]).tolist(), strict=True))
            texts.append(raw.decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("y")], names=["doc_id", "text", "y"])


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Learns from labelled documents that are not held out: of either label about so many at most, by hash of the id,
    and of each text MOST_WORDS words at most, cut where it lies. An id labelled twice has its higher label; of
    documents that share it one is taken. Null ids, labels and texts are left out. Without labels the model is constant.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = materialize(known, slim=True)
    there = dict(known.groupBy("y").count().collect())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.where(F.when(F.col("y") == 1, part < most_toxic / max(1, there.get(1, 0))).otherwise(part < most_clean / max(1, there.get(0, 0))))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    cut = map_arrow(rows, _excerpts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, y int")
    got = cut.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toArrow().sort_by("doc_id")
    text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    return fit(text, np.asarray(got.column("y"), dtype=np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; only the text is looked at.

    Null and empty texts get the score of a text without evidence. Repeated rows score alike, beside any other; null ids
    stay null. An empty table gives no rows; other columns are not read. A very long text is scored by one task.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m(Texts(batch.column("text"), lower=True)))], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op10_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model of their labels; see train() and score() for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
