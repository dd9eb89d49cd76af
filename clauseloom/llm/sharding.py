"""Sharding by jump consistent hashing, in column functions only.

A key walks upwards through the shard numbers: from shard b it jumps to
floor((b + 1) / u) for a uniform u in (0, 1] drawn from the key and the number of the
draw; the last stop below the number of shards is its shard.  There is no ring table,
and one more shard only takes keys whose next stop is that shard: it changes nothing
for all other keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut

#: Draws until the walk ends.  The number of jumps among n shards has mean
#: ln n + 0.58; among a million shards more than 128 have a chance below 1e-60.
DRAWS = 128


def jump_shards(key: Column, shards: int, grown: int | None = None) -> Column:
    """A struct (shard, grown) of one walk; null keys are a key like any other."""
    grown = grown or shards + 1
    draws = min(grown, DRAWS)

    def step(state: Column, draw: Column) -> Column:
        # 53 bits of the hash make a double in (0, 1]
        u = (F.shiftrightunsigned(F.xxhash64(key, draw), 11) + 1) / F.lit(float(1 << 53))
        stop = F.least(F.floor((state["last"] + 1) / u), F.lit(grown).cast("long"))
        going = state["last"] < grown
        return F.struct(
            F.when(going & (stop < shards), stop).otherwise(state["shard"]).alias("shard"),
            F.when(going & (stop < grown), stop).otherwise(state["grown"]).alias("grown"),
            F.when(going, stop).otherwise(state["last"]).alias("last"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("shard"), zero.alias("grown"), zero.alias("last"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), start, step)
    return F.struct(walk["shard"].cast("int").alias("shard"), walk["grown"].cast("int").alias("grown"))


def shard_by_key(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per document.

    The law is ``key``: id and number of shards alone decide.  Size is the text's UTF-8
    bytes plus 8 (null text: 8, with the crc of nothing).  Null ids are one key.  Rows
    with the same id share a shard, whatever their texts, and get slots of their own.

    Slots count within a shard by input part, then id: parts are numbered when the narrow
    rows are written, so each count is over a part of a shard, never over a whole shard
    or over one id, and an offset per part (a table of parts times shards) is added.
    """
    data = F.coalesce(column(docs, text), F.lit("")).cast("binary")
    key = column(docs, doc_id)
    walked = docs.select(
        key.alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        jump_shards(key, shards).alias("walk"), F.spark_partition_id().alias("part"))
    placed = cut(walked.select(
        "doc_id", "size", "text_crc32", F.col("walk.shard").alias("shard"),
        F.col("walk.grown").alias("grown_shard"), "part"), "shards")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("local", F.row_number().over(within))
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("offset") + F.col("local") - 1).cast("long").alias("slot"), "grown_shard")
    )
