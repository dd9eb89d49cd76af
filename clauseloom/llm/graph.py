"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.store import cut


def _stars(edges: DataFrame, pairs: DataFrame, own_only: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them.

    ``pairs`` holds (node, near).  Least neighbours are partial sums, and the join back
    is one that Spark splits for a node with very many neighbours.
    """
    least = pairs.groupBy("node").agg(F.min("near").alias("m"))
    least = least.select("node", F.least("node", "m").alias("m"))
    joined = pairs.join(least, "node")
    if own_only:  # small star: neighbours below the node, and the node itself
        out = joined.select(F.col("near").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    else:  # large star: neighbours above the node
        out = joined.where("near > node").select(F.col("near").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node that has an edge.

    ``edges`` has two long columns.  Alternates large and small stars until nothing
    changes; each round is written to the shared folder, and the driver sees only a
    count and a checksum.  Self-loops and repeats are allowed.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
              .where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("near")).union(
            now.select(F.col("b").alias("node"), F.col("a").alias("near")))
        large = _stars(now, both, own_only=False)
        down = large.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
        now = cut(_stars(large, down, own_only=True), "edges")
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sums == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = sums
