"""Blind samples for human labelling, and their scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom import fixed
from clauseloom.functions.text import clip, strip
from clauseloom.operators import metrics

YES = ["y", "yes", "true", "1"]
NO = ["n", "no", "false", "0"]


def draw(rows: DataFrame, size: int = fixed.SAMPLE_SIZE,
         seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    """Even quota per class, the shortfall drawn from the rest, in shuffled order.

    Repeatable for a seed.  Only the first ``size`` rows of a class can be drawn; the others
    go before the shuffle (a group limit), so the windows hold ``size`` rows a class.
    """
    drawn = rows.withColumn("_draw", F.md5(F.concat_ws(
        "-", "comparison_id", "row_index", F.lit(seed)).cast("binary")))
    within = Window.partitionBy("comparison_id", "change_type").orderBy("_draw", "row_index")
    ranked = drawn.withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= size)
    # every class present has exactly one row of rank one
    classes = F.count_if(F.col("_rank") == 1).over(Window.partitionBy("comparison_id"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / classes))
    ranked = ranked.withColumn("_spare", F.col("_rank") > quota)
    # quota members first, then the rest in draw order: one cut does both selections
    overall = Window.partitionBy("comparison_id").orderBy("_spare", "_draw", "row_index")
    chosen = ranked.withColumn("_place", F.row_number().over(overall)).filter(
        F.col("_place") <= size)
    shuffle = Window.partitionBy("comparison_id").orderBy(
        F.md5(F.concat_ws("-", "_draw", F.lit(seed)).cast("binary")), "row_index")
    return chosen.withColumn("id", (F.row_number().over(shuffle) - 1).cast("long")).drop(
        "_draw", "_rank", "_spare", "_place")


def to_label(rows: DataFrame) -> DataFrame:
    """What a draw, a sheet and its key read of report rows: both texts, no marked ones.

    A draw moves its rows twice, so marked texts would be most of what is moved.
    """
    def side(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(
            *[F.col(f"{name}.{field}").alias(field) for field in ("clause_number", "section", "content")])).alias(name)

    return rows.select(
        "comparison_id", "row_index", "change_type", "similarity_score", "match_score", "match_method",
        side("v1"), side("v2"), F.struct("redline.word_change_ratio").alias("redline"))


def sheet(drawn: DataFrame, limit: int | None = None) -> DataFrame:
    """The texts and empty label columns, nothing the system said; whole texts unless limited."""
    blank, none = F.lit(""), F.lit("")
    return drawn.select(
        "comparison_id", "id",
        F.coalesce("v1.clause_number", none).alias("clause_v1"),
        F.coalesce("v2.clause_number", none).alias("clause_v2"),
        F.coalesce(F.nullif(F.col("v2.section"), none), F.nullif(F.col("v1.section"), none), none)
        .alias("section"),
        clip(F.col("v1.content"), limit).alias("text_v1"),
        clip(F.col("v2.content"), limit).alias("text_v2"),
        blank.alias("annotator_change_type"), blank.alias("annotator_alignment_ok"),
        blank.alias("annotator_notes"))


def answer_key(drawn: DataFrame) -> DataFrame:
    return drawn.select(
        "comparison_id", "id", F.col("change_type").alias("system_change_type"),
        F.col("similarity_score").alias("system_similarity"),
        F.col("match_score").alias("system_match_score"),
        F.col("match_method").alias("system_alignment_method"),
        F.col("redline.word_change_ratio").alias("word_change_ratio"))


def canonical(label: Column) -> Column:
    """A label in its own spelling, whatever case it was typed in; null when unknown."""
    names = F.create_map(*[F.lit(x) for t in fixed.CHANGE_TYPES for x in (t.lower(), t)])
    return F.try_element_at(names, F.lower(strip(label)))


def labelled(sheets: DataFrame, key: DataFrame, strict: bool = True) -> DataFrame:
    """Sheet rows with ``truth`` and ``prediction``; a skipped row has neither.

    A label that is not a change type is an error, or with ``strict=False`` null.
    """
    own = ["comparison_id", "id"]
    answers = key.select(*own, "system_change_type", "system_similarity")
    joined = sheets.join(answers, own, "left")
    given = strip(F.coalesce("annotator_change_type", F.lit("")))
    counted = (given != "") & F.col("system_change_type").isNotNull()
    wrong = F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(": unknown label "), given)
    label = canonical(given)
    if strict:
        label = F.coalesce(label, F.raise_error(wrong).cast("string"))
    flag = F.lower(strip(F.coalesce("annotator_alignment_ok", F.lit(""))))
    return (joined.withColumn("truth", F.when(counted, label))
            .withColumn("prediction", F.when(counted, F.col("system_change_type")))
            .withColumn("alignment", F.when(flag.isin(*YES), True).when(flag.isin(*NO), False)))


def agreement(rows: DataFrame) -> DataFrame:
    """Annotated and skipped rows, alignment tallies, accuracy, F1s and kappa."""
    used = F.col("truth").isNotNull()
    counts = rows.groupBy("comparison_id").agg(
        F.count_if(used).alias("annotated_rows"), F.count_if(~used).alias("skipped_rows"),
        F.count_if(used & F.col("alignment")).alias("alignment_correct"),
        F.count_if(used & ~F.col("alignment")).alias("alignment_wrong"),
        F.count_if(used & F.col("alignment").isNull()).alias("alignment_unlabelled"))
    judged = F.col("alignment_correct") + F.col("alignment_wrong")
    counts = counts.withColumn("alignment_accuracy", F.when(
        judged > 0, F.round(F.col("alignment_correct").cast("double") / judged, 4)))
    matrix = metrics.confusion(rows.filter(used), "comparison_id")
    scores = metrics.matrix_scores(matrix, fixed.CHANGE_TYPES, "comparison_id")
    return counts.join(scores.drop("rows"), "comparison_id", "left")


def disagreements(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("truth") != F.col("prediction")).select(
        "comparison_id", "id", "clause_v1", "clause_v2", F.col("truth").alias("annotator"),
        F.col("prediction").alias("system"), F.col("system_similarity").alias("similarity"),
        F.col("annotator_notes").alias("notes"))
