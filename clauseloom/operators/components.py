"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node; edges are two columns of one type.

    Every round each node takes the least label among itself and its neighbours, then the
    label of that label, so labels travel twice as far in each round as in the one before.
    Minima combine before the shuffle, and a round is a written table.
    """
    a, b = edges.columns
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("near"))
               .union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy("node").agg(F.min("near").alias("near")).select(
        "node", F.least("node", "near").alias("root")))
    while True:
        of_near = labels.select(F.col("node").alias("near"), F.col("root").alias("seen"))
        seen = both.join(of_near, "near").groupBy("node").agg(F.min("seen").alias("seen"))
        met = labels.join(seen, "node").select("node", "root", F.least("root", "seen").alias("best"))
        # whoever shares a label hears of the least that any of them has seen
        told = met.groupBy("root").agg(F.min("best").alias("told"))
        heard = met.join(told, "root").select("node", F.col("root").alias("old"), "told")
        further = labels.select(F.col("node").alias("told"), F.col("root").alias("jump"))
        moved = cut(heard.join(further, "told").select(
            "node", F.least("told", "jump").alias("root"), (F.col("old") != F.least("told", "jump")).alias("moved")))
        labels = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return labels
