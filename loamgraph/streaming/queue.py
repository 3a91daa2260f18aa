"""Incremental work: what is due, retries, embeddings that are reused, sub-units that changed, forced passes, change signals.

A run claims nothing: what is due follows from what is stored, results are stored by key, and a run that is lost is run again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import expand
from loamgraph.operators.storage import kept
from loamgraph.streaming import changes

# Fixed value: attempts before work is parked.
ATTEMPTS = 3


class Embedder(Protocol):
    """Texts to vectors. `model` names what they are comparable with."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Vectors without a model or a network: signed counts of the texts' words and letter triples, scaled to length 1."""

    dim: int = 64
    model: str = "hashing-64"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                for g in (w, *(w[j : j + 3] for j in range(len(w) - 2))):
                    h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                    out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def vector_key(model: str, context: int | None = None) -> str:
    """What vectors are comparable: the model, and the length of its context where one is set."""
    return model if context is None else f"{model}#ctx={context}"


def fingerprint(settings: dict) -> str:
    """A hash of settings: what was made under another one is to be made anew."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def forced(stored: dict[str, str] | None, now: dict[str, str]) -> list[str]:
    """The settings whose change forces a full pass: all of them in a first one."""
    return sorted(k for k in now if not stored or stored.get(k) != now[k])


def due(work: DataFrame, done: DataFrame, failures: DataFrame, key: str = "id", content: str = "content_hash") -> DataFrame:
    """Rows of work (key, content ...) that aren't done (key, content) with this content, and not parked: failures (key,
    content, attempts) with ATTEMPTS on the same content wait until it changes."""
    parked = failures.where(F.col("attempts") >= ATTEMPTS).select(key, content)
    return work.join(done.select(key, content), [key, content], "left_anti").join(parked, [key, content], "left_anti")


def failed(failures: DataFrame, now: DataFrame, done: DataFrame, key: str = "id", content: str = "content_hash") -> DataFrame:
    """The failures after a run: now (key, content, error) counts one more attempt on equal content and starts anew on
    other; what is done since, or has changed, is left out."""
    before = failures.select(key, content, F.col("attempts").alias("_n"))
    again = now.join(before, [key, content], "left").select(key, content, (F.coalesce("_n", F.lit(0)) + 1).alias("attempts"), "error")
    rest = failures.join(now.select(key), key, "left_anti").join(done.select(key, content), [key, content], "left_anti")
    return again.unionByName(rest.select(*again.columns))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(content_hash, body) of chunks without a vector of the model: equal bodies once."""
    have = vectors.where(F.col("model") == model).select("content_hash")
    return chunks.join(have, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("body").alias("body"))


def has_vectors(chunks: DataFrame, vectors: DataFrame, files: DataFrame, model: str) -> bool:
    """Whether any chunk of the files has a vector of the model."""
    some = chunks.withColumn("file", expand.file_of(F.col("id"))).join(files.select(F.col("id").alias("file")), "file", "left_semi")
    return not some.join(vectors.where(F.col("model") == model).select("content_hash"), "content_hash", "left_semi").isEmpty()


def vectors_of(chunks: DataFrame, vectors: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """(id, chunk, body, vector, model) of the files' chunks that have a vector of the model."""
    some = chunks.withColumn("file", expand.file_of(F.col("id"))).join(files.select(F.col("id").alias("file")), "file", "left_semi")
    return some.join(vectors.where(F.col("model") == model), "content_hash").select("id", "chunk", "body", "vector", "model")


def drain(chunks: DataFrame, vectors: DataFrame, embedder: Embedder, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """vectors (content_hash, model, vector) with those of chunks (id, chunk, content_hash, body) that had none, and the
    failures (content_hash, error). Vectors that no chunk names go. A batch that fails is tried text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts, keys = part.column("body").to_pylist(), part.column("content_hash").to_pylist()
                try:
                    found: list = [(v, None) for v in embedder.embed(texts)]
                except Exception:  # noqa: BLE001
                    found = []
                    for t in texts:
                        try:
                            found.append((embedder.embed([t])[0], None))
                        except Exception as e:  # noqa: BLE001
                            found.append((None, f"{type(e).__name__}: {e}"[:200]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([f[0] for f in found], pa.list_(pa.float32())), pa.array([f[1] for f in found], pa.string())], names=["content_hash", "vector", "error"])

    made = kept(missing_vectors(chunks, vectors, embedder.model).mapInArrow(run, "content_hash string, vector array<float>, error string"))
    new = made.where("error is null").select("content_hash", F.lit(embedder.model).alias("model"), "vector")
    live = vectors.join(chunks.select("content_hash").distinct(), "content_hash", "left_semi").select("content_hash", "model", "vector")
    return live.unionByName(new), made.where("error is not null").select("content_hash", "error")


def unit_changes(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, change) of sub-units (id, content_hash, ordinal): insert, update (other content), move (other place) or delete."""
    a = stored.select("id", F.col("content_hash").alias("_h"), F.col("ordinal").alias("_o"))
    b = parsed.select("id", F.col("content_hash").alias("h"), F.col("ordinal").alias("o"))
    kind = F.when(F.col("_h").isNull(), "insert").when(F.col("h").isNull(), "delete").when(F.col("h") != F.col("_h"), "update").when(F.col("o") != F.col("_o"), "move")
    return a.join(b, "id", "full_outer").select("id", kind.alias("change")).where("change is not null")


def synced(stored: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Sub-units after a sync of some files: theirs as parsed, all others as stored."""
    rest = stored.join(files.select(F.col("id").alias("_file")), expand.file_of(F.col("id")) == F.col("_file"), "left_anti")
    return rest.select(*stored.columns).unionByName(parsed.select(*stored.columns))


def to_heal(refs: DataFrame, changed: DataFrame) -> DataFrame:
    """(id) of files whose references (source, target, state) failed, or lead to what changed (id): to be looked up again."""
    broken = refs.where("state <> 'ok'").select(F.col("source").alias("id"))
    hit = refs.join(changed.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    return broken.union(hit).distinct()


def walk_state(stored: DataFrame, listing: DataFrame, generation: int) -> DataFrame:
    """(path, content_hash, modified, size, state, generation) after a walk: what is listed (path, content_hash, modified,
    size) is live in this generation, what isn't is a tombstone of the one it was last seen in."""
    live = listing.select("path", "content_hash", "modified", "size", F.lit("live").alias("state"), F.lit(generation).alias("generation"))
    gone = stored.join(listing.select("path"), "path", "left_anti").withColumn("state", F.lit("tombstone"))
    return live.unionByName(gone.select(*live.columns))


def to_read(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files (path, modified, size) whose time and size aren't those stored: only these need to be read."""
    same = stored.where("state = 'live'").select("path", "modified", "size")
    return listing.join(same, ["path", "modified", "size"], "left_anti")


@dataclass
class Signal:
    """Tells when tables have changed: a number that grows with each content, and the epoch, which a reset starts anew."""

    epoch: int = 0
    generation: int = 0
    last: str = ""

    def poll(self, *tables: DataFrame) -> bool:
        """Whether the tables hold other rows than at the last poll; one number a table is collected."""
        now = [str(t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).first()) for t in tables]
        seen = fingerprint({"tables": now})
        changed, self.last = seen != self.last, seen
        self.generation += changed
        return changed

    def reset(self) -> None:
        self.epoch, self.generation, self.last = self.epoch + 1, 0, ""


def reindexed(stored: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows with those of a batch of changes, the last of each key: content null deletes."""
    last = changes.latest(batch, key, ["modified"])
    return changes.upsert(stored.join(last.where("content is null").select(key), key, "left_anti"), last.where("content is not null").select(*stored.columns), key)
