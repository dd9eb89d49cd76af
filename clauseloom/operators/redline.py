"""Redline of every aligned pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom.functions import markup
from clauseloom.functions.diff import redline_udf
from clauseloom.functions.text import token_count
from clauseloom.session import fan_out


def _struct(html_v1: Column, html_v2: Column, unified: Column, removed: Column, added: Column,
            unchanged: Column) -> Column:
    return F.struct(
        html_v1.alias("html_v1"), html_v2.alias("html_v2"), unified.alias("html_unified"),
        removed.cast("long").alias("words_removed"), added.cast("long").alias("words_added"),
        unchanged.cast("long").alias("words_unchanged"))


def with_redline(pairs: DataFrame, left: str = "content_v1", right: str = "content_v2",
                 out: str = "redline", by: Sequence[str] = ()) -> DataFrame:
    """Add the redline struct.

    Missing sides and equal texts are rendered in the JVM; only pairs that differ
    are shipped to Python.  The pairs are spread over all partitions first, by the columns
    ``by`` that tell them apart or else in turn: never by text, as many pairs may share one.
    """
    a, b = F.col(left), F.col(right)
    none, empty = F.lit(0), F.lit("")
    differing = a.isNotNull() & b.isNotNull() & (a != b)
    marked = redline_udf(F.when(differing, a), F.when(differing, b))
    return (
        fan_out(pairs, *[F.col(c) for c in by])
        .withColumn("_diff", marked)
        .withColumn(out, F.when(differing, F.col("_diff"))
                    .when(a.isNull() & b.isNull(), _struct(empty, empty, empty, none, none, none))
                    .when(a.isNull(), _struct(empty, markup.inserted(b), markup.inserted(b),
                                              none, token_count(b), none))
                    .when(b.isNull(), _struct(markup.deleted(a), empty, markup.deleted(a),
                                              token_count(a), none, none))
                    .otherwise(_struct(markup.escape(a), markup.escape(a), markup.escape(a),
                                       none, none, token_count(a))))
        .drop("_diff")
    )


def change_ratio(removed: Column, added: Column, unchanged: Column) -> Column:
    """Share of words touched; 0 without words, 1 when one side is missing."""
    total = removed + added + unchanged
    return F.when(total == 0, F.lit(0.0)).otherwise(
        (removed + added).cast("double") / total.cast("double"))


def redline_ratio(redline: str = "redline") -> Column:
    return change_ratio(*[F.col(f"{redline}.words_{part}")
                          for part in ("removed", "added", "unchanged")])


def public_redline(redline: str = "redline", unified: bool = False) -> Column:
    """The output form: ratio to four places, the unified view only on request."""
    names = ["html_v1", "html_v2", "words_removed", "words_added", "words_unchanged"]
    fields = [F.col(f"{redline}.{name}").alias(name) for name in names]
    fields.append(F.round(redline_ratio(redline), 4).alias("word_change_ratio"))
    if unified:
        fields.append(F.col(f"{redline}.html_unified").alias("html_unified"))
    return F.struct(*fields)
