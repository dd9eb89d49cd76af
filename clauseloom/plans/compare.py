"""Comparison of version pairs, end to end, many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom import fixed
from clauseloom.functions.text import alignment_text, lexical_similarity
from clauseloom.operators import align, embed, report
from clauseloom.operators.redline import with_redline
from clauseloom.session import cut, fan_out


def split_rejects(comparisons: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comparable, rejected with a reason): equal versions and empty sides are refused."""
    stored = clauses.select("version_id").distinct()
    checked = comparisons
    for side in (1, 2):
        known = stored.select(F.col("version_id").alias(f"version_v{side}"),
                              F.lit(True).alias(f"_has{side}"))
        checked = checked.join(known, f"version_v{side}", "left")
    reason = (F.when(F.col("version_v1") == F.col("version_v2"), "same version")
              .when(F.col("_has1").isNull() | F.col("_has2").isNull(), "no stored clauses"))
    checked = checked.withColumn("reason", reason).drop("_has1", "_has2")
    return (checked.filter(F.col("reason").isNull()).drop("reason"),
            checked.filter(F.col("reason").isNotNull()))


def with_strategy(comparisons: DataFrame, sides: DataFrame) -> DataFrame:
    """Add identifier_overlap and the resolved ``method``."""
    requested = F.col("strategy") if "strategy" in comparisons.columns else F.lit(fixed.AUTO)
    return (
        comparisons.join(align.identifier_overlap(sides), "comparison_id", "left")
        .withColumn("identifier_overlap", F.coalesce("identifier_overlap", F.lit(0.0)))
        .withColumn("method", align.choose_strategy(
            F.coalesce("country_v1", F.lit(fixed.DEFAULT_COUNTRY))
            == F.coalesce("country_v2", F.lit(fixed.DEFAULT_COUNTRY)),
            F.col("identifier_overlap"), requested))
    )


def content_similarity(encoder: embed.ColumnEncoder | None) -> Column:
    """Similarity of paired contents; without an encoder the shared vocabulary stands in."""
    a, b = F.col("v1.content"), F.col("v2.content")
    both = a.isNotNull() & b.isNotNull()
    if encoder is None:
        return F.when(both, lexical_similarity(a, b))
    return F.when(both, embed.cosine(embed.encode_column(a, encoder),
                                     embed.encode_column(b, encoder)))


def _encoded_similarity(pairs: DataFrame, sides: DataFrame, encoder: embed.FrameEncoder) -> DataFrame:
    """Add the cosine of paired contents, each clause's chunks encoded once as rows.

    Vectors meet the pairs before the texts do, which then need not move to them.
    """
    vectors = embed.encode_frame(sides.filter("content IS NOT NULL"), ["comparison_id", "side", "idx"],
                                 F.col("content"), encoder)
    for side in (1, 2):
        own = vectors.filter(F.col("side") == side).select(
            "comparison_id", F.col("idx").alias(f"index_v{side}"), F.col("vector").alias(f"_vector{side}"))
        pairs = pairs.join(own, ["comparison_id", f"index_v{side}"], "left")
    both = F.col("_vector1").isNotNull() & F.col("_vector2").isNotNull()
    # written: the pairs are read once for themselves and once for each of their texts
    return cut(pairs.withColumn("similarity", F.when(both, embed.cosine(
        F.col("_vector1"), F.col("_vector2")))).drop("_vector1", "_vector2"))


def identifier_rows(sides: DataFrame, encoder: embed.ColumnEncoder | embed.FrameEncoder | None = None,
                    unified: bool = False, in_row: bool = True) -> DataFrame:
    """Report rows of comparisons aligned by clause number."""
    pairs = align.reading_order(align.align_by_identifier(sides))
    if not in_row:
        scored = _encoded_similarity(pairs, sides, encoder)
        return report.build_rows(_redlined(report.attach_sides(scored, sides)), unified)
    # similarity behind the redline, where the pairs are spread over all partitions
    redlined = _redlined(report.attach_sides(pairs, sides)).withColumn("similarity", content_similarity(encoder))
    return report.build_rows(redlined, unified)


def semantic_rows(sides: DataFrame, encoder: embed.ColumnEncoder | embed.FrameEncoder | None,
                  unified: bool = False, in_row: bool = True, **limits: int) -> DataFrame:
    """Report rows of comparisons aligned by meaning; similarity is the alignment's cosine.

    ``sides`` may bring its own ``vector`` column; otherwise the encoder supplies it.
    """
    if "vector" not in sides.columns:
        text = alignment_text(F.col("section"), F.col("title"), F.col("content"))
        # encoded once; alignment reads the written copy several times
        spread_sides = fan_out(sides, F.col("comparison_id"), F.col("side"), F.col("idx"))
        sides = cut(embed.with_vector(spread_sides, ["comparison_id", "side", "idx"], text, encoder,
                                      in_row=in_row))
    pairs = align.reading_order(align.align_semantic(sides, **limits))
    joined = report.attach_sides(pairs, sides)
    redlined = _redlined(joined.withColumn("similarity", F.col("embedding_score")))
    return report.build_rows(redlined, unified)


def _redlined(joined: DataFrame) -> DataFrame:
    texts = joined.withColumn("_a", F.col("v1.content")).withColumn("_b", F.col("v2.content"))
    return with_redline(texts, "_a", "_b", by=["comparison_id", "row_index"]).drop("_a", "_b")


def compare(comparisons: DataFrame, clauses: DataFrame, encoder: embed.ColumnEncoder | embed.FrameEncoder,
            unified: bool = False, in_row: bool = True) -> DataFrame:
    """Rows of every comparison, each aligned by the method chosen for it.

    An encoder of chunk rows (a model, hashed terms) is passed with ``in_row=False``.
    """
    # tables of a row a comparison are written, so that Spark knows how small they are
    accepted = cut(split_rejects(comparisons, clauses)[0])
    sides = align.comparison_sides(accepted, clauses)
    methods = cut(with_strategy(accepted, sides).select("comparison_id", "method"))
    chosen = sides.join(methods, "comparison_id")
    numbered = identifier_rows(
        chosen.filter(F.col("method") == fixed.IDENTIFIER).drop("method"), encoder, unified, in_row)
    meant = semantic_rows(
        chosen.filter(F.col("method") == fixed.SEMANTIC).drop("method"), encoder, unified, in_row)
    return numbered.unionByName(meant)
