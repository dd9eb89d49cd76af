"""Change localisation against published registers.

``scope`` (comparison_id, set_id) says which register sets a comparison is scored
against, ``amendments`` carries set_id, ``rows`` are ``scored_rows``.  Everything is
keyed by (comparison_id, set_id), so several registers are scored in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom import fixed
from clauseloom.operators import metrics, register
from clauseloom.operators.report import row_number_of

CASE = ["comparison_id", "set_id"]
AMENDMENT = ["booklet", "volume", "reference", "operation"]


def scored_rows(rows: DataFrame) -> DataFrame:
    """What localisation needs of report rows, without texts and markup.

    The other functions take this; write or cache it once, they read it repeatedly.
    """
    both = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    return rows.select(
        "comparison_id", "row_index", row_number_of().alias("number"), "change_type",
        "similarity_score", F.col("redline.word_change_ratio").alias("ratio"),
        F.col("redline.words_added").alias("words_added"),
        F.col("redline.words_removed").alias("words_removed"),
        F.coalesce(both & (F.col("v1.content") != F.col("v2.content")), F.lit(False))
        .alias("text_differs"))


def flagged_numbers(rows: DataFrame) -> DataFrame:
    """Universe of clause numbers; ``peak`` is the largest ratio of a changed row, null if none."""
    changed = F.col("change_type") != fixed.UNCHANGED
    return rows.groupBy("comparison_id", "number").agg(
        F.max(F.when(changed, F.col("ratio"))).alias("peak"))


def in_scope(amendments: DataFrame, scope: DataFrame) -> DataFrame:
    return amendments.join(scope, "set_id")


def covered(amendments: DataFrame, scope: DataFrame, numbers: DataFrame) -> DataFrame:
    """(case, amendment, number, peak) for every clause an amendment reaches."""
    left = register.amendment_keys(in_scope(amendments, scope), *CASE, *AMENDMENT)
    right = register.number_keys(numbers, "comparison_id", "number", "peak", number="number")
    return left.join(right, ["comparison_id", "cover_key"]).drop("cover_key").distinct()


def gold(reached: DataFrame) -> DataFrame:
    """Distinct clause numbers in the reference set of each case."""
    return reached.select(*CASE, "number", "peak").distinct()


def sweep(numbers: DataFrame, gold_numbers: DataFrame, scope: DataFrame) -> DataFrame:
    """Scores per minimum change ratio; the thresholds are aggregates, not a join."""
    def counts(name: str):
        return F.array(*[F.struct(F.lit(t).alias("min_ratio"), F.count_if(
            F.col("peak") >= t).alias(name)) for t in fixed.SWEEP_RATIOS])

    universe = numbers.groupBy("comparison_id").agg(
        F.count("*").alias("universe"), counts("flagged").alias("_flagged"))
    hits = gold_numbers.groupBy(*CASE).agg(
        F.count("*").alias("gold"), counts("hits").alias("_hits"))
    cases = scope.join(universe, "comparison_id").join(hits, CASE, "left")
    stepped = cases.select(*CASE, "universe", F.coalesce("gold", F.lit(0)).alias("gold"),
                           "_hits", F.posexplode("_flagged").alias("_step", "f"))
    tp = F.coalesce(F.get("_hits", F.col("_step"))["hits"], F.lit(0))
    counted = stepped.select(
        *CASE, F.col("f.min_ratio").alias("min_ratio"), F.col("f.flagged").alias("flagged"),
        tp.alias("true_positives"), (F.col("f.flagged") - tp).alias("false_positives"),
        (F.col("gold") - tp).alias("false_negatives"),
        (F.col("universe") - F.col("f.flagged") - F.col("gold") + tp).alias("true_negatives"))
    return metrics.with_scores(counted)


def operating_point(swept: DataFrame) -> DataFrame:
    """Fewest flags at full recall, else the highest recall; ties to the lowest ratio."""
    full = F.col("recall") >= 1.0
    order = F.when(full, F.struct(F.lit(0), F.col("flagged").cast("double"), F.col("min_ratio"))) \
        .otherwise(F.struct(F.lit(1), -F.col("recall"), F.col("min_ratio")))
    fields = [c for c in swept.columns if c not in CASE]
    return swept.groupBy(*CASE).agg(F.min_by(F.struct(*fields), order).alias("_p")).select(
        *CASE, "_p.*")


def amendment_status(reached: DataFrame) -> DataFrame:
    """An amendment is found once any clause it reaches is flagged."""
    return reached.groupBy(*CASE, *AMENDMENT).agg(
        F.count("*").alias("clauses"), F.bool_or(F.col("peak").isNotNull()).alias("found"))


def amendment_recall(status: DataFrame) -> DataFrame:
    return status.groupBy(*CASE).agg(
        F.count("*").alias("scored"), F.count_if("found").alias("found"),
        F.round(metrics.ratio(F.count_if("found"), F.count("*")), 4).alias("amendment_recall"))


def uncovered_references(amendments: DataFrame, scope: DataFrame,
                         reached: DataFrame) -> DataFrame:
    """References no clause of the comparison answers to."""
    # compared by reference: two amendments of one reference reach the same clauses
    return in_scope(amendments, scope).select(*CASE, "reference").distinct().join(
        reached.select(*CASE, "reference").distinct(), [*CASE, "reference"], "left_anti")


def missed_numbers(gold_numbers: DataFrame) -> DataFrame:
    """Reference clauses that were not flagged."""
    return gold_numbers.filter(F.col("peak").isNull()).select(*CASE, "number")


def silent_misses(rows: DataFrame, gold_numbers: DataFrame) -> DataFrame:
    """Amended clauses whose text differs but which were classified Unchanged."""
    quiet = rows.filter((F.col("change_type") == fixed.UNCHANGED) & F.col("text_differs"))
    return quiet.join(gold_numbers.select(*CASE, "number"), ["comparison_id", "number"]).select(
        *CASE, "row_index", "number", "similarity_score", "ratio", "words_added", "words_removed")


def unlisted(rows: DataFrame, gold_numbers: DataFrame, scope: DataFrame) -> DataFrame:
    """What was flagged without being in the register, one row per case."""
    changed = rows.filter(F.col("change_type") != fixed.UNCHANGED).join(
        scope, "comparison_id").join(
        gold_numbers.select(*CASE, "number"), [*CASE, "number"], "left_anti")
    edited = F.col("change_type").isin(fixed.MINOR, fixed.SIGNIFICANT)
    counts = changed.groupBy(*CASE).agg(
        F.count("*").alias("unlisted"), F.count_if(edited).alias("edited"),
        F.count_if(~edited).alias("one_sided"),
        F.count_if(edited & (F.col("ratio") < 0.02)).alias("edited_under_2_percent"),
        F.count_if(edited & (F.col("ratio") >= 0.20)).alias("edited_over_20_percent"))
    spread = metrics.describe(changed.filter(edited), "ratio", *CASE)
    return counts.join(spread.drop("count"), CASE, "left")
