"""Shortlists of comparisons too large to meet every clause with every other.

The right clauses of a comparison are dealt to pivots, evenly spaced clauses of their own
side, each to its nearest; a left clause looks at the right clauses of its nearest pivots
only.  With n right clauses and p probes there are sqrt(p n) pivots, so a left clause meets
about 2 sqrt(p n) vectors instead of n.  What it finds is ranked by the exact cosine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom import fixed
from clauseloom.operators.align import BLOCK, _block_best
from clauseloom.session import cut, fan_out

PROBES = 32
_FOUND = ["comparison_id", "index_v1", "index_v2", "cosine"]


def _best_in_cells(left: DataFrame, right: DataFrame, cell: list[str], top_k: int, block: int) -> DataFrame:
    """The best ``top_k`` of each left vector within each cell that it shares with right ones.

    A crowded cell is cut into blocks on both sides, by hash, and its pairs of blocks are
    groups of their own, so no cell is one task's work.
    """
    def blocks(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sizes = blocks(left, "_lefts").join(blocks(right, "_rights"), cell)

    def dealt(frame: DataFrame, own: str, owns: str, other: str, others: str) -> DataFrame:
        return frame.join(sizes, cell).select(
            *[F.col(c).alias(c) for c in cell],
            F.pmod(F.xxhash64("idx"), F.col(owns)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other),
            F.col("idx").cast("int").alias("idx"), F.col("vector").alias("vector"))

    group = [*cell, "_left", "_right"]
    columns = [*group, "idx", "vector"]
    lefts = dealt(left, "_left", "_lefts", "_right", "_rights").select(*columns)
    rights = dealt(right, "_right", "_rights", "_left", "_lefts").select(*columns)
    kind = dict(left.dtypes)["comparison_id"]
    return lefts.groupBy(*group).cogroup(rights.groupBy(*group)).applyInArrow(
        lambda a, b: _block_best(a, b, top_k),
        f"comparison_id {kind}, index_v1 int, index_v2 int, cosine double")


def _first(found: DataFrame, top_k: int) -> DataFrame:
    best = Window.partitionBy("comparison_id", "index_v1").orderBy(F.desc("cosine"), "index_v2")
    spread = fan_out(found, F.col("comparison_id"), F.col("index_v1"))
    return spread.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top_k).drop("_rank")


def spacing(size: Column, probes: int) -> Column:
    """Every how many right clauses one is a pivot."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(size.cast("double") / F.lit(float(probes)))))


def pivots_of(right: DataFrame, probes: int = PROBES) -> DataFrame:
    """Evenly spaced right clauses, sqrt(probes * n) of n."""
    sizes = right.groupBy("comparison_id").agg(F.count("*").alias("_n"))
    return right.join(sizes, "comparison_id").filter(
        F.col("idx") % spacing(F.col("_n"), probes) == 0).select("comparison_id", "idx", "vector")


def homes(frame: DataFrame, pivots: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Each vector with its ``n`` nearest pivots, a row for each."""
    near = _first(_best_in_cells(frame, pivots, ["comparison_id"], n, block), n).select(
        "comparison_id", F.col("index_v1").alias("idx"), F.col("index_v2").alias("pivot"))
    return cut(frame.join(near, ["comparison_id", "idx"]))


def nearest_by_pivots(sides: DataFrame, top_k: int = fixed.TOP_K, probes: int = PROBES,
                      block: int = BLOCK) -> DataFrame:
    """About the ``top_k`` nearest right clauses of every left clause, with their exact cosine.

    Same columns as ``align.nearest``; what is returned is right, but a nearer clause may be
    missing.  Up to ``probes`` right clauses are all pivots, and the result is exact.  A left clause whose pivots hold too few clauses is taken
    against the whole other side, so each gets ``top_k`` rows, or all there are.  Null
    vectors take no part; a comparison with an empty side has no rows.
    """
    vectors = cut(sides.filter(F.col("vector").isNotNull()).select("comparison_id", "side", "idx", "vector"))
    left = vectors.filter("side = 1").drop("side")
    right = vectors.filter("side = 2").drop("side")
    pivots = pivots_of(right, probes)
    found = cut(_first(_best_in_cells(
        homes(left, pivots, probes, block), homes(right, pivots, 1, block),
        ["comparison_id", "pivot"], top_k, block), top_k).select(*_FOUND))
    sizes = right.groupBy("comparison_id").agg(F.count("*").alias("_n"))
    counts = found.groupBy("comparison_id", F.col("index_v1").alias("idx")).agg(F.count("*").alias("_found"))
    few = (left.select("comparison_id", "idx", "vector").join(sizes, "comparison_id")
           .join(counts, ["comparison_id", "idx"], "left")
           .filter(F.coalesce("_found", F.lit(0)) < F.least(F.lit(top_k), F.col("_n")))
           .select("comparison_id", "idx", "vector"))
    whole = _first(_best_in_cells(cut(few), right, ["comparison_id"], top_k, block), top_k)
    enough = found.join(whole.select("comparison_id", "index_v1").distinct(),
                        ["comparison_id", "index_v1"], "left_anti")
    return enough.select(*_FOUND).unionByName(whole.select(*_FOUND))
