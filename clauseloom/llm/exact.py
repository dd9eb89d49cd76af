"""Exact dedup by deterministic block naming, in column functions only.

Normalised texts are cut into blocks of a fixed size.  The different blocks, sorted, get
integer names.  Then neighbouring names are paired and the different pairs, sorted, get
new names, until each document is one name.  Equal names mean equal bytes: names stand
for values, not for hashes, so nothing can collide.

Blocks are sorted by a hash and then by their bytes.  So all bytes are moved once, to find
the different blocks of each hash; where a hash has one block only, which is the rule,
the hash alone finds the name again.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut

BLOCK = 8192


def normalised(text: Column) -> Column:
    """Lower case in A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """The different values of ``keys``, sorted, with a number that grows with them.

    Sorted by range over many tasks; the number holds the task and the place in it.
    Written once, so a lost executor cannot number them differently.
    """
    width = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = values.select(*keys).distinct()
    return cut(apart.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
               .withColumn("name", F.monotonically_increasing_id()), "names")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     block: int = BLOCK, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per document.

    Of equal normalised texts the row with the largest id stays; null ids are smallest.
    Rows alike in id and text count in the group and come out as often as they go in,
    one of them kept.  Null texts are empty, and an empty text is one empty block.
    ``text_sha256`` only reports; with the id it tells rows apart, identity comes from
    the names.
    """
    data = normalised(column(docs, text)).cast("binary")
    texts = docs.select(column(docs, doc_id).alias("doc_id"), data.alias("data"))
    blocks = texts.select(
        "doc_id", F.unhex(F.sha2("data", 256)).alias("sha"), "data",
        F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block)).cast("int").alias("n"))
    blocks = blocks.select(
        "doc_id", "sha", "n", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.col("n") - 1),
            lambda i: F.expr("data").substr(i * block + 1, F.lit(block)))).alias("pos", "block"))
    blocks = blocks.withColumn("h", digest(F.col("block")))
    different = blocks.select("h", "block").distinct()
    kinds = cut(different.groupBy("h").agg(F.count("*").alias("kinds")), "kinds")
    names = _named(kinds.select("h", F.explode(F.sequence(F.lit(1).cast("long"), "kinds")).alias("kind")), ["h", "kind"])
    shared = kinds.where("kinds > 1").select("h")
    kind = F.lit(1).cast("long").alias("kind")
    if shared.isEmpty():
        told = blocks.select("doc_id", "sha", "n", "pos", "h", kind)
    else:  # different blocks with one hash: told apart by their bytes
        by_bytes = Window.partitionBy("h").orderBy("block")
        order = different.join(shared, "h", "left_semi").withColumn("kind", F.row_number().over(by_bytes).cast("long"))
        told = blocks.join(shared, "h", "left_anti").select("doc_id", "sha", "n", "pos", "h", kind).union(
            blocks.join(order, ["h", "block"]).select("doc_id", "sha", "n", "pos", "h", "kind"))
    row = cut(told.join(names, ["h", "kind"]).select("doc_id", "sha", "n", "pos", "name"), "named")
    # rows alike in id and text are folded into one with a count
    row = row.groupBy("doc_id", "sha", "n", "pos").agg(
        F.max("name").alias("name"), F.count("*").alias("copies"))
    done = row.where("n = 1").select("doc_id", "sha", "copies", F.lit(0).alias("level"), "name")
    left, level = row.where("n > 1"), 0
    longest = left.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level += 1
        paired = left.groupBy("doc_id", "sha", "n", F.expr("pos div 2").alias("pos")).agg(
            F.max("copies").alias("copies"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        paired = cut(paired, "pairs")
        names = _named(paired, ["a", "b"])
        row = paired.join(names, ["a", "b"]).select(
            "doc_id", "sha", F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "copies", "name")
        done = done.union(row.where("n = 1").select(
            "doc_id", "sha", "copies", F.lit(level).alias("level"), "name"))
        left = row.where("n > 1")
        longest = (longest + 1) // 2
    identity = ["level", "name"]
    kept = done.groupBy(*identity).agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = done.join(kept, identity).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                      "text_sha256")
