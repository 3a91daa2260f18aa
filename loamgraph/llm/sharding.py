"""Sharding by fixed virtual slots and a versioned slot map; DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import materialize, occurrences, table
from loamgraph.operators.storage import shared_dir

SLOTS = 4096
#: Parts in which rows of a slot are numbered, so that no task numbers a whole slot.
PARTS = 16
SHARDS = 40


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, the hash of the text and that of text and id. A null text counts as empty: 16 bytes, CRC 0."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.xxhash64(text, "doc_id").alias("_row"))


def spread_groups(slim: DataFrame, n_shards: int) -> DataFrame:
    """Text hashes of the groups of equal texts that no shard can hold, as they have more bytes than a shard has on
    average. There are fewer than n_shards of them."""
    total = slim.agg(F.sum("size")).first()[0] or 0
    by_text = slim.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return by_text.where((F.col("n") > 1) & (F.col("bytes") * n_shards > total)).select("text_hash")


def with_slots(slim: DataFrame, spread: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Each row's virtual slot: by its text, so that equal texts meet. Rows of a spread group go by text, id and a number
    among the rows that share both."""
    one = F.pmod(F.xxhash64("text_hash"), F.lit(slots)).cast("int")
    if spread.isEmpty():
        return slim.withColumn("virtual_slot", one)
    whole = slim.join(F.broadcast(spread), "text_hash", "left_anti").withColumn("virtual_slot", one)
    dealt = occurrences(slim.join(F.broadcast(spread), "text_hash", "left_semi"), "_row")
    each = F.pmod(F.xxhash64("_row", "_nth"), F.lit(slots)).cast("int")
    return whole.unionByName(dealt.withColumn("virtual_slot", each).select(*whole.columns))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def edit_map(loads: DataFrame, n_shards: int, previous: DataFrame | None = None, version: int = 0, slack: float = 0.02) -> DataFrame:
    """The slot-to-shard map of one version: version, virtual_slot, shard.

    Slots by falling bytes; a slot stays where the previous version has it as long as that shard stays within
    the mean load and `slack`, and else goes to the emptiest shard. So the first version is a greedy balance,
    and a later one moves only what growth or new shards require. The fold is over at most SLOTS values.
    """
    old = previous.select("virtual_slot", F.col("shard").alias("old")) if previous is not None else None
    rows = loads.join(old, "virtual_slot", "left") if old is not None else loads.withColumn("old", F.lit(None).cast("int"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct(F.col("bytes"), (-F.col("virtual_slot")).alias("s"), F.coalesce("old", F.lit(-1)).alias("old"))), asc=False).alias("l"), F.sum("bytes").alias("total"))
    one = one.withColumn("most", F.col("total") * ((1 + slack) / n_shards))
    # Spark's fold needs one state type, so the chosen place is computed inside the new state.
    place = f"if(x.old >= 0 and x.old < {n_shards} and element_at(a.load, greatest(x.old, 0) % {n_shards} + 1) + x.bytes <= most, x.old + 1, cast(array_position(a.load, array_min(a.load)) as int))"
    fold = f"""aggregate(l,
        named_struct('load', array_repeat(0L, {n_shards}), 'shard', cast(array() as array<int>)),
        (a, x) -> transform(array({place}), p -> named_struct(
            'load', transform(a.load, (v, i) -> if(i = p - 1, v + x.bytes, v)),
            'shard', concat(a.shard, array(p - 1))))[0])"""
    placed = one.withColumn("state", F.expr(fold))
    pairs = placed.select(F.explode(F.arrays_zip(F.col("l.s").alias("s"), F.col("state.shard").alias("shard"))).alias("x"))
    return pairs.select(F.lit(version).alias("version"), (-F.col("x.s")).cast("int").alias("virtual_slot"), F.col("x.shard").cast("int").alias("shard"))


def store_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Writes one version beside the others, which stay readable; writing it again replaces it."""
    slot_map.select("virtual_slot", "shard").write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """version, virtual_slot and shard of a version, the last one without a number."""
    versions = spark.read.parquet(path)
    version = versions.agg(F.max("version")).first()[0] if version is None else version
    return versions.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def mapped(slotted: DataFrame, n_shards: int, maps: str | None = None, version: int = 0) -> DataFrame:
    """The map for rows with slots, stored as a version under the folder `maps` and read back. With a later version,
    the one before it is edited."""
    spark = slotted.sparkSession
    maps = maps or f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    previous = load_map(spark, maps, version - 1) if version else None
    store_map(edit_map(slot_bytes(slotted), n_shards, previous, version), maps, version)
    return load_map(spark, maps, version)


def assign(slim: DataFrame, n_shards: int, slots: int = SLOTS, maps: str | None = None, version: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of sized() with virtual slot and shard, and the map; see mapped() for its folder and version.

    Equal texts are in one shard unless they have more bytes than a shard on average: such a group is spread over all
    slots. Both small sides are bounded: by n_shards and by slots. Rows that repeat are placed each; an empty table
    gives no rows and an empty map; columns beside those of sized() go through.
    """
    slotted = with_slots(slim, materialize(spread_groups(slim, n_shards), slim=True), slots)
    slot_map = mapped(slotted, n_shards, maps, version)
    return slotted.join(F.broadcast(slot_map.drop("version")), "virtual_slot"), slot_map


def numbered(placed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A gapless number from 0 of each row in its shard, by virtual slot, part, doc_id and text.

    Rows are only ever sorted within a part of a slot; where each part begins comes from its count.
    """
    parts = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int"))
    counts = parts.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("virtual_slot", "part", F.coalesce(before, F.lit(0)).alias("begin"))  # slots * PARTS rows at most
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    return parts.withColumn("rank", rank).join(F.broadcast(begins), ["virtual_slot", "part"]).withColumn("slot", F.col("begin") + F.col("rank") - 1)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: shard sizes near equal, equal texts together but for groups larger than a shard.

    Null texts count as empty, null ids are values like others, repeated rows each get a number, and an empty
    table gives no rows; further columns are not read.
    """
    slim = materialize(sized(table(spark, sf_dir, "documents")))
    placed, _ = assign(slim, SHARDS)
    return numbered(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their virtual_slot and shard, which replace columns of these names. Texts are not shuffled
    unless a group of equal ones is larger than a shard: all but such groups take their slot where they lie.

    Null and empty texts are a group of equal texts; null ids, repeated rows and empty tables are as assign() says.
    """
    rest = [c for c in docs.columns if c not in ("virtual_slot", "shard")]
    slim = materialize(sized(docs))
    spread = materialize(spread_groups(slim, SHARDS), slim=True)
    slot_map = mapped(with_slots(slim, spread), SHARDS)
    slotted = with_slots(sized(docs, F.struct(*rest).alias("_d")), spread)
    return slotted.join(F.broadcast(slot_map.drop("version")), "virtual_slot").select("_d.*", "virtual_slot", "shard")
