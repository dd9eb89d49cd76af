"""Scores over labelled rows, for any number of groups in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def with_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1, rounded, to tp/fp/fn counts."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return (counts.withColumn("precision", F.round(precision(tp, fp), 4))
            .withColumn("recall", F.round(recall(tp, fn), 4))
            .withColumn("f1", F.round(f1(tp, fp, fn), 4)))


def score_flags(members: DataFrame, *by: str, predicted: str = "predicted",
                actual: str = "actual") -> DataFrame:
    """Scores of a predicted set against an actual one.

    ``members`` is the universe, one row per member with two boolean flags; true
    negatives are the members in neither set.
    """
    p, a = F.col(predicted), F.col(actual)
    return with_scores(members.groupBy(*by).agg(
        F.count_if(p & a).alias("true_positives"), F.count_if(p & ~a).alias("false_positives"),
        F.count_if(~p & a).alias("false_negatives"),
        F.count_if(~p & ~a).alias("true_negatives")))


def score_sets(predicted: DataFrame, actual: DataFrame, keys: list[str],
               universe: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores of two sets given as frames of distinct keys."""
    members = predicted.select(*keys).distinct().withColumn("predicted", F.lit(True)).join(
        actual.select(*keys).distinct().withColumn("actual", F.lit(True)), keys, "full_outer")
    if universe is not None:
        members = members.join(universe.select(*keys).distinct(), keys, "full_outer")
    flags = members.withColumn("predicted", F.coalesce("predicted", F.lit(False))).withColumn(
        "actual", F.coalesce("actual", F.lit(False)))
    return score_flags(flags, *by)


def confusion(rows: DataFrame, *by: str, truth: str = "truth",
              predicted: str = "prediction") -> DataFrame:
    """Counts per (truth, prediction)."""
    return rows.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("prediction")) \
        .agg(F.count("*").alias("n"))


def per_label(matrix: DataFrame, labels: list[str], *by: str) -> DataFrame:
    """One-vs-rest scores for every label, those without a row included.

    Each cell is read as seen from its true and from its predicted label; a
    zero cell per label and group keeps the grid full.
    """
    keys = list(by) or ["_all"]
    matrix = matrix if by else matrix.withColumn("_all", F.lit(1))
    grid = matrix.groupBy(*keys).agg(F.sum("n").alias("_total")).select(
        *keys, "_total", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    views = F.array(
        F.struct(F.col("truth").alias("label"), (F.col("truth") == F.col("prediction"))
                 .alias("hit"), F.lit(True).alias("as_truth")),
        F.struct(F.col("prediction").alias("label"), F.lit(False).alias("hit"),
                 F.lit(False).alias("as_truth")))
    seen = matrix.select(*keys, "n", F.explode(views).alias("v")).select(*keys, "n", "v.*")
    n = F.col("n")
    sums = seen.groupBy(*keys, "label").agg(
        F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("true_positives"),
        F.sum(F.when(~F.col("as_truth"), n).otherwise(0)).alias("_predicted"),
        F.sum(F.when(F.col("as_truth"), n).otherwise(0)).alias("support"))
    joined = grid.join(sums, [*keys, "label"], "left").na.fill(
        0, ["true_positives", "_predicted", "support"])
    tp = F.col("true_positives")
    counted = (joined.withColumn("false_positives", F.col("_predicted") - tp)
               .withColumn("false_negatives", F.col("support") - tp)
               .withColumn("true_negatives", F.col("_total") - F.col("_predicted")
                           - F.col("support") + tp))
    return counted.select(*by, "label", "true_positives", "false_positives", "false_negatives",
                          "true_negatives", "support", "_total")


def matrix_scores(matrix: DataFrame, labels: list[str], *by: str) -> DataFrame:
    """Accuracy, macro F1 over labels with support, support-weighted F1, and kappa."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    scored = per_label(matrix, labels, *by).withColumn("_f1", f1(tp, fp, fn))
    support, total = F.col("support"), F.max("_total")
    agreement = ratio(F.sum(tp), total)
    chance = F.sum(ratio(support, F.col("_total")) * ratio(tp + fp, F.col("_total")))
    kappa = F.when(chance >= 1.0, F.lit(1.0)).otherwise((agreement - chance) / (1 - chance))
    return scored.groupBy(*by).agg(
        total.alias("rows"), F.round(agreement, 4).alias("accuracy"),
        F.round(F.coalesce(F.avg(F.when(support > 0, F.col("_f1"))), F.lit(0.0)), 4)
        .alias("macro_f1"),
        F.round(ratio(F.sum(F.col("_f1") * support), F.sum(support)), 4).alias("weighted_f1"),
        F.round(kappa, 4).alias("kappa"))


def _four(value: Column) -> Column:
    """Four places; a value between two of them goes up whatever its last bit."""
    return F.round(value + F.lit(1e-12), 4)


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, min, quartiles and max of a score, per group.

    Values are counted first, so what a group gathers is its distinct scores; a
    score rounded to four places has at most ten thousand and one of them.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    v, n = F.col(value).cast("double"), F.col("n")
    quartiles = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    out = counted.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"),
        _four(F.sum(v * n) / F.sum(n)).alias("mean"),
        F.round(F.min(v), 4).alias("min"), quartiles.alias("_q"),
        F.round(F.max(v), 4).alias("max"))
    for place, name in enumerate(("p25", "median", "p75")):
        out = out.withColumn(name, _four(F.get("_q", F.lit(place))))
    return out.select(*by, "count", "mean", "min", "p25", "median", "p75", "max")


def top(counts: DataFrame, limit: int, *by: str, name: str, count: str = "n") -> DataFrame:
    """The most frequent names per group, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.desc(count), name)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
