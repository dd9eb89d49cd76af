"""Alignment of two clause lists, for many comparisons in one plan.

``sides`` holds one row per clause and side: comparison_id, side (1 or 2), idx
(position in the version, from 0), clause_number, section, title, content.  Positions are
counted over ranges (``positions.numbered``): no window holds a version or a comparison.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom import fixed
from clauseloom.functions.text import token_set
from clauseloom.operators.components import components
from clauseloom.operators.positions import numbered
from clauseloom.session import cut, fan_out, scratch_path

BLOCK = 1024
CELL = 256
GROUP_LIMIT = 250_000
PAIR = ["comparison_id", "index_v1", "index_v2", "match_score", "embedding_score", "method"]


def with_position(clauses: DataFrame) -> DataFrame:
    """Add idx and version_size from the (ordinal, id) order of each version."""
    placed = numbered(clauses, ["version_id"], ["ordinal", "id"], "idx", size="version_size")
    return placed.withColumns({c: F.col(c).cast("int") for c in ("idx", "version_size")})


def comparison_sides(comparisons: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses of both versions of every comparison."""
    # written, so that its size is known and clauses are not shuffled to it
    wanted = cut(comparisons.select("comparison_id", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("version_v1").alias("version_id")),
        F.struct(F.lit(2).alias("side"), F.col("version_v2").alias("version_id")),
    )).alias("s")).select("comparison_id", "s.*"))
    # only wanted versions are ordered
    compared = clauses.join(wanted.select("version_id").distinct(), "version_id", "left_semi")
    return wanted.join(with_position(compared), "version_id")


def identifier_overlap(sides: DataFrame) -> DataFrame:
    """Shared share of the smaller set of distinct numbers, per comparison."""
    numbers = sides.groupBy("comparison_id", "clause_number").agg(
        F.max(F.col("side") == 1).alias("a"), F.max(F.col("side") == 2).alias("b"))
    counts = numbers.groupBy("comparison_id").agg(
        F.count_if("a").alias("a"), F.count_if("b").alias("b"),
        F.count_if(F.col("a") & F.col("b")).alias("both"))
    smaller = F.least("a", "b")
    return counts.select("comparison_id", F.when(smaller == 0, F.lit(0.0)).otherwise(
        F.col("both").cast("double") / smaller.cast("double")).alias("identifier_overlap"))


def choose_strategy(same_country: Column, overlap: Column, requested: Column) -> Column:
    """Numbers are trusted within one country only, and only when enough are shared."""
    return (F.when(requested != fixed.AUTO, requested)
            .when(same_country & (overlap >= fixed.IDENTIFIER_OVERLAP_MIN),
                  F.lit(fixed.IDENTIFIER))
            .otherwise(F.lit(fixed.SEMANTIC)))


def align_by_identifier(sides: DataFrame) -> DataFrame:
    """The k-th clause with a number pairs with the k-th one on the other side."""
    occurrence = Window.partitionBy("comparison_id", "side", "clause_number").orderBy("idx")
    ranked = sides.select("comparison_id", "side", "clause_number", "idx",
                          F.row_number().over(occurrence).alias("k"))
    key = ["comparison_id", "clause_number", "k"]
    left = ranked.filter("side = 1").select(*key, F.col("idx").alias("index_v1"))
    right = ranked.filter("side = 2").select(*key, F.col("idx").alias("index_v2"))
    nothing = F.lit(None).cast("double")
    return left.join(right, key, "full_outer").select(
        "comparison_id", "index_v1", "index_v2", nothing.alias("match_score"),
        nothing.alias("embedding_score"), F.lit(fixed.IDENTIFIER).alias("method"))


# -- candidates --------------------------------------------------------------

def _block_best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest right vectors of every left vector of one block pair."""
    def matrix(table: pa.Table) -> np.ndarray:
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64, copy=False).reshape(table.num_rows, -1)

    empty = left.num_rows == 0 or right.num_rows == 0
    if empty:
        i = j = np.zeros(0, dtype=np.int32)
        score, comparison = np.zeros(0), left["comparison_id"].slice(0, 0)
    else:
        # nine places, so that ties do not depend on how the blocks were cut
        cosines = np.round(matrix(left) @ matrix(right).T, 9)
        columns = right["idx"].to_numpy()
        width = min(k, len(columns))
        order = np.lexsort((np.broadcast_to(columns, cosines.shape), -cosines), axis=1)
        top = order[:, :width]
        score = np.take_along_axis(cosines, top, axis=1).ravel()
        i = np.repeat(left["idx"].to_numpy(), width)
        j = columns[top].ravel()
        comparison = left["comparison_id"].take(pa.array(np.repeat(np.arange(left.num_rows), width)))
    return pa.table({
        "comparison_id": comparison, "index_v1": pa.array(i, pa.int32()),
        "index_v2": pa.array(j, pa.int32()), "cosine": pa.array(score, pa.float64())})


def nearest(sides: DataFrame, top_k: int = fixed.TOP_K, block: int = BLOCK) -> DataFrame:
    """Exact top-k right clauses of every left clause by cosine.

    Both sides are cut into blocks; each pair of blocks is one bounded group that
    returns k rows per left clause, so no pair list is ever built and a single huge
    comparison spreads over as many tasks as it has block pairs.  Comparisons of at
    most one block per side are not copied at all.
    """
    vectors = sides.select("comparison_id", "side", F.col("idx").cast("int").alias("idx"), "vector")
    sizes = vectors.groupBy("comparison_id").agg(*[
        F.floor((F.max(F.when(F.col("side") == s, F.col("idx"))) / block)).cast("int").alias(name)
        for s, name in ((1, "_last_left"), (2, "_last_right"))])
    cells = vectors.join(sizes, "comparison_id").withColumn(
        "_own", F.floor(F.col("idx") / block).cast("int"))

    def spread_over(side: int, own: str, other: str, last: str) -> DataFrame:
        # every column is renamed, since both sides descend from one frame
        return (cells.filter((F.col("side") == side) & F.col(last).isNotNull())
                .select(F.col("comparison_id").alias("comparison_id"), F.col("_own").alias(own),
                        F.explode(F.sequence(F.lit(0), F.col(last))).alias(other),
                        F.col("idx").alias("idx"), F.col("vector").alias("vector")))

    cell = ["comparison_id", "left_block", "right_block"]
    left = spread_over(1, "left_block", "right_block", "_last_right").select(*cell, "idx", "vector")
    right = spread_over(2, "right_block", "left_block", "_last_left").select(*cell, "idx", "vector")
    kind = dict(vectors.dtypes)["comparison_id"]
    partial = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        lambda a, b: _block_best(a, b, top_k),
        f"comparison_id {kind}, index_v1 int, index_v2 int, cosine double")
    best = Window.partitionBy("comparison_id", "index_v1").orderBy(F.desc("cosine"), "index_v2")
    # the rows are narrow, what is joined to them later is not: keep all partitions
    partial = fan_out(partial, F.col("comparison_id"), F.col("index_v1"))
    return (partial.withColumn("_rank", F.row_number().over(best))
            .filter(F.col("_rank") <= top_k).drop("_rank"))


def place(idx: Column, size: Column) -> Column:
    """Relative position in the version."""
    return idx.cast("double") / F.greatest(F.lit(1), size - 1).cast("double")


def composite_score(cosine: Column, lexical: Column, positional: Column) -> Column:
    return (F.lit(fixed.WEIGHT_EMBEDDING) * cosine + F.lit(fixed.WEIGHT_LEXICAL) * lexical
            + F.lit(fixed.WEIGHT_POSITION) * positional)


def _likeness(pairs: pa.Table, clauses: pa.Table) -> pa.Table:
    """Token sets shared and distance in place of the pairs of one cell."""
    known = {(side, idx): (where, set(terms)) for side, idx, where, terms in zip(
        *(clauses[c].to_pylist() for c in ("side", "idx", "place", "terms")))}
    lexical, positional = [], []
    for i, j in zip(pairs["index_v1"].to_pylist(), pairs["index_v2"].to_pylist()):
        (here, a), (there, b) = known[1, i], known[2, j]
        shared = float(len(a & b))
        lexical.append(shared / (len(a) + len(b) - shared) if a and b else 0.0)
        positional.append(1.0 - abs(here - there))
    return pairs.drop_columns(["_left", "_right"]).append_column(
        "lexical", pa.array(lexical, pa.float64())).append_column(
        "positional", pa.array(positional, pa.float64()))


def with_likeness(pairs: DataFrame, sides: DataFrame, top_k: int = fixed.TOP_K,
                  cell: int = CELL) -> DataFrame:
    """Add ``lexical`` and ``positional`` to shortlisted pairs.

    Pairs meet the token sets of their clauses in cells of ``cell`` by ``cell`` clauses, so a
    set of an ordinary comparison moves once, not with every pair.  Where a stretch of clauses
    meets at most ``top_k`` others, all of it goes to their cells; elsewhere a clause goes
    only to the cells that have a pair of it.
    """
    key = ["comparison_id", "_left", "_right"]
    met = cut(pairs.withColumns({name: F.floor(F.col(index) / cell).cast("int") for name, index in (
        ("_left", "index_v1"), ("_right", "index_v2"))}))
    clauses = sides.select(
        "comparison_id", F.col("side").cast("int").alias("side"), F.col("idx").cast("int").alias("idx"),
        place(F.col("idx"), F.col("version_size")).alias("place"),
        token_set(F.coalesce("content", F.lit(""))).alias("terms"))
    stretch = F.floor(F.col("idx") / cell).cast("int")
    cells = met.select(*key).distinct()
    sent = None
    for side, mine, other in ((1, "_left", "_right"), (2, "_right", "_left")):
        own = clauses.filter(F.col("side") == side).withColumn(mine, stretch)
        # a row a stretch, written so that Spark knows how small it is
        others = cut(cells.groupBy("comparison_id", mine).agg(F.collect_set(other).alias("_others")))
        few = F.size("_others") <= top_k
        whole = own.join(others.filter(few), ["comparison_id", mine]).withColumn(
            other, F.explode("_others"))
        parts = [whole]
        if not others.filter(~few).isEmpty():
            many = met.join(others.filter(~few), ["comparison_id", mine]).select(
                *key, F.col(f"index_v{side}").alias("idx")).distinct()
            parts.append(own.join(many, ["comparison_id", mine, "idx"]))
        for part in parts:
            part = part.select(*key, "side", "idx", "place", "terms")
            sent = part if sent is None else sent.unionByName(part)
    fields = ", ".join(f"{name} {kind}" for name, kind in pairs.dtypes)
    return met.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(
        lambda a, b: _likeness(a, b), f"{fields}, lexical double, positional double")


def candidates(sides: DataFrame, top_k: int = fixed.TOP_K, block: int = BLOCK,
               shortlist: Callable[..., DataFrame] = nearest) -> DataFrame:
    """Shortlisted pairs at or above the acceptance score.

    ``shortlist`` is exact; ``shortlist.nearest_by_pivots`` in its place is not, but meets
    far fewer vectors where comparisons are very large.
    """
    scored = with_likeness(shortlist(sides, top_k=top_k, block=block), sides).withColumn(
        "score", composite_score(F.col("cosine"), F.col("lexical"), F.col("positional")))
    return scored.filter(F.col("score") >= fixed.ACCEPT_MIN).select(
        "comparison_id", "index_v1", "index_v2", "cosine", "lexical", "positional", "score")


# -- one to one --------------------------------------------------------------

def _greedy(table: pa.Table) -> pa.Table:
    i, j = table["index_v1"].to_numpy(), table["index_v2"].to_numpy()
    taken_i, taken_j, kept = set(), set(), []
    for row in np.lexsort((j, i, -table["score"].to_numpy())):
        if i[row] not in taken_i and j[row] not in taken_j:
            taken_i.add(i[row])
            taken_j.add(j[row])
            kept.append(row)
    return table.take(pa.array(kept, pa.int64()))


def match_in_groups(scored: DataFrame) -> DataFrame:
    """Best-first matching of each comparison in one task; for bounded comparisons."""
    return scored.groupBy("comparison_id").applyInArrow(_greedy, scored.schema)


def match_in_rounds(scored: DataFrame) -> DataFrame:
    """Best-first matching for comparisons of any size.

    A pair that is the strongest of both its clauses is what the sequential greedy would
    take sooner or later, so all such pairs are taken at once; the rest goes on without
    their clauses.  Per-clause maxima combine before the shuffle, so a clause that nearly
    every other one points at is no burden.  Rounds go on while each at least halves the
    rest.  A chain of falling scores would take a round for each pair: what is left is
    matched component by component, each in one task that holds three numbers a candidate.

    Winners are one table, a folder for each round.
    """
    spark, path = scored.sparkSession, scratch_path(scored.sparkSession, "matched")
    rank = F.struct("score", -F.col("index_v1"), -F.col("index_v2"))
    left, right = ["comparison_id", "index_v1"], ["comparison_id", "index_v2"]
    rest, number = cut(scored), 0
    left_over = rest.count()
    while left_over:
        best_left = rest.groupBy(*left).agg(F.max_by("index_v2", rank).alias("index_v2"))
        best_right = rest.groupBy(*right).agg(F.max_by("index_v1", rank).alias("index_v1"))
        mutual = best_left.join(best_right, ["comparison_id", "index_v1", "index_v2"])
        won = rest.join(mutual, ["comparison_id", "index_v1", "index_v2"], "left_semi")
        won.write.parquet(f"{path}/round={number}")
        won = spark.read.schema(scored.schema).parquet(f"{path}/round={number}")
        rest = cut(rest.join(won, left, "left_anti").join(won, right, "left_anti"))
        before, left_over, number = left_over, rest.count(), number + 1
        if 2 * left_over > before:
            break
    if left_over:
        def clause(side: int) -> Column:
            return F.struct("comparison_id", F.lit(side).alias("side"), F.col(f"index_v{side}").alias("idx"))

        root = components(rest.select(clause(1).alias("a"), clause(2).alias("b"))).select(
            F.col("node").alias("_node"), F.col("root").alias("_root"))
        named = rest.withColumn("_node", clause(1)).join(root, "_node").drop("_node")
        matched = named.groupBy("_root").applyInArrow(
            lambda table: _greedy(table.drop_columns(["_root"])), scored.schema)
        matched.write.parquet(f"{path}/round={number}")
        number += 1
    if not number:
        return rest
    return spark.read.schema(scored.schema).option("basePath", path).parquet(
        *[f"{path}/round={i}" for i in range(number)]).select(*scored.columns)


def one_to_one(scored: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Best-first one-to-one assignment under the order (score desc, index_v1, index_v2).

    Comparisons of up to ``group_limit`` candidates, which a task holds easily, take one
    shuffle; larger ones go through the rounds.  Both give the same pairs.
    """
    scored = cut(scored)
    large = scored.groupBy("comparison_id").count().filter(
        F.col("count") > group_limit).select("comparison_id")
    small = match_in_groups(scored.join(large, "comparison_id", "left_anti"))
    if large.isEmpty():
        return small
    return small.unionByName(match_in_rounds(scored.join(large, "comparison_id", "left_semi")))


def unmatched(sides: DataFrame, pairs: DataFrame, method: str) -> DataFrame:
    """One-sided rows for every clause that is in no pair."""
    out = None
    for side in (1, 2):
        index = f"index_v{side}"
        alone = (sides.filter(F.col("side") == side)
                 .select("comparison_id", F.col("idx").cast("int").alias(index))
                 .join(pairs.filter(F.col(index).isNotNull()).select("comparison_id", index),
                       ["comparison_id", index], "left_anti")
                 .withColumn(f"index_v{3 - side}", F.lit(None).cast("int")))
        out = alone if out is None else out.unionByName(alone)
    nothing = F.lit(None).cast("double")
    return out.select("comparison_id", "index_v1", "index_v2", nothing.alias("match_score"),
                      nothing.alias("embedding_score"), F.lit(method).alias("method"))


def align_semantic(sides: DataFrame, top_k: int = fixed.TOP_K, block: int = BLOCK,
                   group_limit: int = GROUP_LIMIT,
                   shortlist: Callable[..., DataFrame] = nearest) -> DataFrame:
    """Match on meaning, vocabulary and reading position; ``sides`` carries ``vector``."""
    matched = one_to_one(candidates(sides, top_k, block, shortlist), group_limit).select(
        "comparison_id", "index_v1", "index_v2", F.round("score", 4).alias("match_score"),
        F.round("cosine", 4).alias("embedding_score"), F.lit(fixed.SEMANTIC).alias("method"))
    return matched.unionByName(unmatched(sides, matched, fixed.SEMANTIC))


def reading_order(pairs: DataFrame) -> DataFrame:
    """Add ``row_index``: baseline order, with right-only rows projected onto it.

    Every clause is in exactly one row, so the clause counts are counts over the pairs.
    """
    pairs = cut(pairs)
    sizes = pairs.groupBy("comparison_id").agg(
        F.count("index_v1").alias("_n1"), F.count("index_v2").alias("_n2"))
    scale = F.when(F.col("_n2") > 1, (F.col("_n1") - 1).cast("double")
                   / F.greatest(F.lit(1), F.col("_n2") - 1).cast("double")).otherwise(F.lit(1.0))
    key = F.coalesce(F.col("index_v1").cast("double"), F.col("index_v2") * scale)
    keyed = pairs.join(sizes, "comparison_id").withColumn("_key", key).drop("_n1", "_n2")
    return numbered(keyed, ["comparison_id"], ["_key", F.col("index_v1").isNull(), "index_v2"],
                    "row_index").drop("_key")
