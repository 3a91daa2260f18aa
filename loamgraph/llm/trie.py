"""Prefix trie of conversations: digest-keyed parent edges, rolled up to all ancestors by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import map_arrow, materialize, table
from loamgraph.operators.storage import drop

#: Prefix digests are sums of turn digests times powers of _BASE modulo the prime _P: those of parts of a conversation add up.
_P, _BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F
_ROOT = bytes(16)
#: Characters of a turn's role and text by which turns are dealt to tasks; longer ones still sort whole.
_PART = 64
#: Bytes of ids that one row carries to the hash of a node's ends.
_IDS = 1 << 16
_FLUSH = 1 << 15

TURNS = "conv_id long, depth long, digest binary, bytes long, parent binary, node binary"


def turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with null roles and texts as empty; rows without a conv_id belong to no conversation."""
    some = rows.where("conv_id is not null")
    return some.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big") % _P


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix digests of each turn within its conversation, as far as this task has it; rows come in order."""
    part = TaskContext.get().partitionId()
    first = now = None
    place, power, before = 0, 1, 0
    for batch in batches:
        convs, digests = batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist()
        places, befores, afters, firsts = [], [], [], []
        for conv, digest in zip(convs, digests, strict=True):
            if conv != now:
                first = conv if first is None else first
                now, place, power, before = conv, 0, 1, 0
            place, power = place + 1, power * _BASE % _P
            after = (before + _number(digest) * power) % _P
            places.append(place)
            befores.append(before.to_bytes(16, "big"))
            afters.append(after.to_bytes(16, "big"))
            firsts.append(conv == first)
            before = after
        cols = [batch.column("conv_id"), pa.array(places, pa.int64()), batch.column("digest"), batch.column("bytes"), pa.array(befores, pa.binary()), pa.array(afters, pa.binary()), pa.array([part] * len(places), pa.int32()), pa.array(firsts, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "depth", "digest", "bytes", "parent", "node", "part", "first"])


def numbered(rows: DataFrame, deal: list[Column], order: list[Column]) -> DataFrame:
    """TURNS of every row (conv_id, digest, bytes): depth numbers the rows of a conversation from 1 in the order,
    node is the digest of the rows so far, and parent that of the rows before.

    Tasks get ranges of (conv_id, deal), so a conversation that holds a third of all rows is spread over a third of the tasks. What
    such a conversation has in one task is moved on by what it has in earlier ones. Only the first conversation of a
    task can have begun before, so these moves, which the driver adds up, are twice as many as tasks at most.
    """
    tasks = rows.repartitionByRange("conv_id", *deal).sortWithinPartitions("conv_id", *order).select("conv_id", "digest", "bytes")
    here = materialize(map_arrow(tasks, _running, f"{TURNS}, part int, first boolean"))
    maybe = here.where("first").select("conv_id").distinct()
    ends = here.join(F.broadcast(maybe), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.max("depth").alias("n"), F.max_by("node", "depth").alias("node"))
    moves, last = {}, None
    for r in ends.orderBy("conv_id", "part").collect():
        conv, part, n, node = r
        if conv != last:
            last, at, so_far = conv, 0, 0
        if at:
            moves[conv, part] = (at, so_far, pow(_BASE, at, _P))
        so_far = (so_far + pow(_BASE, at, _P) * int.from_bytes(node, "big")) % _P
        at += n
    if not moves:
        return here.select("conv_id", "depth", "digest", "bytes", "parent", "node")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, parent, node = (batch.column(c).to_pylist() for c in ("depth", "parent", "node"))
            for i, key in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if key in moves:
                    at, so_far, power = moves[key]
                    depth[i] += at
                    parent[i], node[i] = (((so_far + power * int.from_bytes(x, "big")) % _P).to_bytes(16, "big") for x in (parent[i], node[i]))
            cols = [batch.column("conv_id"), pa.array(depth, pa.int64()), batch.column("digest"), batch.column("bytes"), pa.array(parent, pa.binary()), pa.array(node, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "depth", "digest", "bytes", "parent", "node"])

    return materialize(map_arrow(here.drop("first"), move, TURNS))


def turns(rows: DataFrame) -> DataFrame:
    """TURNS of conversations, by turn (null first), then role, then text; texts go no further than this."""
    short = F.length("role") < _PART
    deal = [F.col("turn"), F.substring("role", 1, _PART), F.when(short, F.substring("text", 1, _PART)).otherwise("")]
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    slim = turn_rows(rows).withColumns({"digest": F.unhex(F.substring(F.sha2(said, 256), 1, 32)), "bytes": F.octet_length("text").cast("long")})
    return numbered(slim, deal, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five: crc32 of its decimal id modulo 9."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(of: DataFrame) -> DataFrame:
    """TURNS of every conversation c made anew: the first h turns of c - c % 5, then its own after its first h.

    Own turns are picked by their number alone. The first eight of every fifth conversation go to the nine ids around
    it that may want them, so no side grows with the length of a conversation.
    """
    ids = of.select("conv_id").distinct()
    heads = of.where("conv_id % 5 = 0 and depth <= 8").withColumn("for", F.explode(F.sequence(F.col("conv_id") - 4, F.col("conv_id") + 4)))
    heads = heads.where((F.col("for") - F.col("for") % 5 == F.col("conv_id")) & (F.col("depth") <= shared_turns(F.col("for"))))
    heads = heads.select(F.col("for").alias("conv_id"), F.lit(0).alias("own"), "depth", "digest", "bytes").join(ids, "conv_id", "left_semi")
    tails = of.where(F.col("depth") > shared_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("own"), "depth", "digest", "bytes")
    order = [F.col("own"), F.col("depth")]
    return numbered(heads.unionByName(tails), order, order)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, comma-joined, in rows of about _IDS bytes; they come sorted by node and id."""
    out: list[tuple] = []
    now, begin, ids, size = None, None, [], 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["node", "begin", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if node != now or size > _IDS:
                if ids:
                    out.append((now, begin, ",".join(ids)))
                now, begin, ids, size = node, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) > 1024:
            yield flush()
    if ids:
        out.append((now, begin, ",".join(ids)))
    yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; a row of them at a time is held."""
    nodes, digests = [], []
    now = sha = None
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != now:
                if sha:
                    nodes.append(now)
                    digests.append(sha.hexdigest())
                now, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(nodes) > _FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
            nodes, digests = [], []
    if sha:
        nodes.append(now)
        digests.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id). Ids are sorted by ranges over all tasks and joined to long rows there; only
    these rows meet, one after the other, in the hash of their node, which has to see them in order."""
    lists = map_arrow(materialize(ends, slim=True).repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id"), _listed, "node binary, begin long, ids string")
    return map_arrow(lists.repartition("node").sortWithinPartitions("node", "begin").select("node", "ids"), _hashed, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (node, parent, depth and the columns to sum) with each of these summed over the node's subtree.

    Round k: every node passes what it has gathered to the ancestor 2^k above it, and learns from that one the
    ancestor 2^(k+1) above. So there are as many rounds as the depth has binary digits. Sums are combined before they
    are shuffled; nodes whose next ancestor would lie above the root ask for none, so the root is no hot key.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = materialize(nodes.select("node", F.col("parent").alias("up"), "depth", *sums), slim=True), 1
    while step <= deepest:
        passed = now.where("up is not null").select(F.col("up").alias("node"), *sums)
        got = now.select("node", *sums).unionByName(passed).groupBy("node").agg(*(F.sum(c).alias(c) for c in sums))
        further = now.where(F.col("depth") >= 2 * step).select("node", "up").join(now.select(F.col("node").alias("up"), F.col("up").alias("further")), "up")
        later = got.join(now.select("node", "depth"), "node").join(further.select("node", F.col("further").alias("up")), "node", "left")
        later = materialize(later.select("node", "up", "depth", *sums), slim=True)
        drop(now)
        now, step = later, 2 * step
    return now.select("node", *sums)


def prefix_trie(of: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie of all conversations: one row a node, with the columns of the query below.

    of: TURNS of the conversations; ids (conv_id): all of them, those without turns included. A node's conv_id is its
    smallest member, so with depth it names the node. Equal conversations are one leaf. Counts of members are combined
    before they are shuffled, as the root and a common first turn have all or a third of the rows. Digests have 127
    bits; nodes with equal digests count as one. Without conversations there are no nodes.
    """
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("binary").alias("parent"), F.lit(_ROOT).alias("node"))
    members = of.select("conv_id", "depth", "bytes", "parent", "node").unionByName(root)
    # A node's digest settles its parent, depth and bytes, too; as keys they can be hashed while they are counted.
    nodes = members.groupBy("node", "parent", "depth", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = materialize(nodes, slim=True)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).join(above, "parent", "left")
    full = materialize(full, slim=True)
    own = full.select("node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    last = of.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("node", F.lit(_ROOT)).alias("node"), "conv_id")
    out = full.join(rolled_up(own, ["n_leaves", "saved_tokens"]), "node").join(ends_digests(ends), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations.

    Turns with equal numbers go by role and text; repeated rows are turns of their own. Rows without a conv_id are left out. Null
    turns come first, null roles and texts are empty. Texts of any length are hashed where they lie. An empty table gives
    no rows; other columns are not read.
    """
    rows = table(spark, sf_dir, "conversations")
    ordered = turns(rows)
    ids = ordered.select("conv_id").distinct()
    return prefix_trie(rebuilt(ordered), ids)


SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
b AS (
  SELECT c.conv_id, 0 AS own, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
d AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER w) AS node
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT conv_id, depth, bytes, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM d
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (
  SELECT a.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
  FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN k ON k.node = n.node GROUP BY a.node),
e AS (SELECT arg_max(node, depth) AS node, conv_id FROM p GROUP BY conv_id),
x AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM e GROUP BY node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
  coalesce(x.ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN x USING (node) LEFT JOIN n u ON u.node = n.parent
"""
