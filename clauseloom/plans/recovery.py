"""How much of a known pairing the semantic alignment finds again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom.operators import metrics

PAIR = ["comparison_id", "index_v1", "index_v2"]


def judged_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Full outer join of both pairings; one-sided rows of either are left out."""
    both = F.col("index_v1").isNotNull() & F.col("index_v2").isNotNull()
    known = truth.filter(both).select(*PAIR, F.lit(True).alias("actual"))
    seen = found.filter(both).select(*PAIR, "match_score", F.lit(True).alias("predicted"))
    return known.join(seen, PAIR, "full_outer").na.fill(False, ["actual", "predicted"])


def recovery(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs recovered, paired wrongly and left alone, with precision, recall and F1."""
    judged = judged_pairs(truth, found)
    scores = metrics.score_flags(judged, "comparison_id")
    left = judged.groupBy("comparison_id", "index_v1").agg(
        F.bool_or("actual").alias("known"), F.bool_or("predicted").alias("paired"),
        F.bool_or(F.col("actual") & F.col("predicted")).alias("right"))
    outcome = left.filter("known").groupBy("comparison_id").agg(
        F.count_if(F.col("paired") & ~F.col("right")).alias("disagreed"),
        F.count_if(~F.col("paired")).alias("missed"))
    return (scores.join(outcome, "comparison_id", "left").na.fill(0, ["disagreed", "missed"])
            .withColumn("recovered", F.col("true_positives"))
            .withColumn("identifier_pairs", F.col("true_positives") + F.col("false_negatives"))
            .withColumn("semantic_pairs", F.col("true_positives") + F.col("false_positives")))


def score_distributions(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Match scores of right and of wrong pairs."""
    paired = judged_pairs(truth, found).filter("predicted").withColumn("correct", F.col("actual"))
    return metrics.describe(paired, "match_score", "comparison_id", "correct")
