"""Classification, report rows, summaries and the change map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom import fixed
from clauseloom.operators.redline import public_redline, redline_ratio
from clauseloom.session import cut, fan_out


def classify_similarity(similarity: Column) -> Column:
    """Similarity bands alone."""
    return (F.when(similarity >= fixed.UNCHANGED_MIN, fixed.UNCHANGED)
            .when(similarity >= fixed.MINOR_MIN, fixed.MINOR)
            .otherwise(fixed.SIGNIFICANT))


def classify(similarity: Column, ratio: Column, touched: Column) -> Column:
    """Similarity bands, overruled by the words where the two disagree."""
    rewritten = ((ratio >= fixed.SIGNIFICANT_MIN_RATIO)
                 | (touched >= fixed.SIGNIFICANT_MIN_WORDS))
    edited = (ratio > fixed.UNCHANGED_MAX_RATIO) | (touched > fixed.UNCHANGED_MAX_WORDS)
    return (F.when(rewritten, fixed.SIGNIFICANT)
            .when((similarity >= fixed.UNCHANGED_MIN) & edited, fixed.MINOR)
            .otherwise(classify_similarity(similarity)))


def change_type(left: Column, right: Column, similarity: Column, ratio: Column,
                touched: Column) -> Column:
    """Full classification of a row; a missing side decides on its own."""
    return (F.when(right.isNull(), fixed.REMOVED).when(left.isNull(), fixed.ADDED)
            .otherwise(classify(F.coalesce(similarity, F.lit(0.0)), ratio, touched)))


def label(left: Column, right: Column) -> Column:
    """What to call a row: both numbers when they differ."""
    a, b = F.nullif(left, F.lit("")), F.nullif(right, F.lit(""))
    return (F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(a, F.lit(" → "), b))
            .otherwise(F.coalesce(a, b, F.lit("—"))))


def severity(kind: Column) -> Column:
    """0 is what an auditor acts on first."""
    ranks = F.create_map(*[F.lit(x) for i, t in enumerate(fixed.SEVERITY) for x in (t, i)])
    return F.try_element_at(ranks, kind)


def attach_sides(pairs: DataFrame, sides: DataFrame, *extra: str) -> DataFrame:
    """Bring both clauses of a row in as structs ``v1`` and ``v2``.

    A text moves to its pair's row number, then both texts of a row meet where the redline
    takes place; neither is carried along while the other is sought.
    """
    fields = ["clause_number", "title", "section", "content", "ordinal", *extra]
    row = ["comparison_id", "row_index"]
    spread = [F.col(c) for c in row]
    out = fan_out(pairs, *spread)
    for side in (1, 2):
        own = sides.filter(F.col("side") == side).select(
            "comparison_id", F.col("idx").cast("int").alias(f"index_v{side}"),
            F.struct(*fields).alias(f"v{side}"))
        placed = pairs.select(*row, f"index_v{side}").join(own, ["comparison_id", f"index_v{side}"])
        out = out.join(fan_out(placed.select(*row, f"v{side}"), *spread), row, "left")
    return out


def build_rows(redlined: DataFrame, unified: bool = False) -> DataFrame:
    """Finished report rows from pairs with v1, v2, similarity and redline."""
    touched = F.col("redline.words_removed") + F.col("redline.words_added")
    both = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    fields = ["clause_number", "title", "section", "content", "ordinal"]

    def side(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(
            *[F.col(f"{name}.{f}").alias(f) for f in fields]))

    return redlined.select(
        "comparison_id", "row_index",
        label(F.col("v1.clause_number"), F.col("v2.clause_number")).alias("label"),
        change_type(F.col("v1"), F.col("v2"), F.col("similarity"), redline_ratio(), touched)
        .alias("change_type"),
        F.when(both, F.round("similarity", 4)).alias("similarity_score"),
        "match_score", F.col("method").alias("match_method"),
        side("v1").alias("v1"), side("v2").alias("v2"),
        public_redline(unified=unified).alias("redline"))


def row_number_of() -> Column:
    """The clause number a row is counted under: the baseline's, else the revision's."""
    return F.coalesce("v1.clause_number", "v2.clause_number")


def summarise(rows: DataFrame) -> DataFrame:
    """Counts per type and words touched, one row per comparison."""
    kind = F.col("change_type")
    names = {"unchanged": fixed.UNCHANGED, "minor_edits": fixed.MINOR,
             "significant_changes": fixed.SIGNIFICANT, "added": fixed.ADDED,
             "removed": fixed.REMOVED}
    counted = rows.groupBy("comparison_id").agg(
        F.count("*").alias("total_clauses"),
        *[F.count_if(kind == value).alias(name) for name, value in names.items()],
        F.sum("redline.words_added").alias("words_added"),
        F.sum("redline.words_removed").alias("words_removed"))
    changed = F.col("total_clauses") - F.col("unchanged")
    return counted.withColumn("changed", changed).withColumn("change_rate", F.round(
        F.col("changed").cast("double") / F.col("total_clauses") * 100, 2))


def tallies(summary: DataFrame, country_v1: str = "country_v1",
            country_v2: str = "country_v2") -> DataFrame:
    """The headline strip, re-framed when two countries are compared; one row per tally."""
    aligned = F.col("unchanged") + F.col("minor_edits") + F.col("significant_changes")

    def strip(*entries: tuple[str, Column, Column]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(key).alias("tally"),
                                  text.alias("label"), value.cast("long").alias("value"))
                         for i, (key, text, value) in enumerate(entries)])

    abroad = strip(
        ("aligned", F.lit("Aligned"), aligned),
        ("close", F.lit("Close wording"), F.col("minor_edits")),
        ("diverging", F.lit("Diverging"), F.col("significant_changes")),
        ("only2", F.concat(F.lit("Only in "), F.col(country_v2)), F.col("added")),
        ("only1", F.concat(F.lit("Only in "), F.col(country_v1)), F.col("removed")))
    home = strip(
        ("total", F.lit("Clauses"), F.col("total_clauses")),
        ("unchanged", F.lit("Unchanged"), F.col("unchanged")),
        ("minor", F.lit("Minor edit"), F.col("minor_edits")),
        ("significant", F.lit("Significant"), F.col("significant_changes")),
        ("added", F.lit("Added"), F.col("added")),
        ("removed", F.lit("Removed"), F.col("removed")))
    return summary.select("comparison_id", F.explode(F.when(
        F.col(country_v1) != F.col(country_v2), abroad).otherwise(home)).alias("t")).select(
        "comparison_id", "t.*")


def chip(kind: Column, country_v1: Column, country_v2: Column) -> Column:
    """What a row's chip says."""
    abroad = (F.when(kind == fixed.ADDED, F.concat(F.lit("only in "), country_v2))
              .when(kind == fixed.REMOVED, F.concat(F.lit("only in "), country_v1))
              .when(kind.isin(fixed.UNCHANGED, fixed.MINOR), "close wording")
              .otherwise("diverging"))
    return F.when(country_v1 != country_v2, abroad).otherwise(kind)


def change_spine(rows: DataFrame, segments: int = fixed.SPINE_SEGMENTS) -> DataFrame:
    """At most ``segments`` stretches per comparison, each with its most severe type."""
    total = rows.groupBy("comparison_id").agg(F.count("*").alias("_total"))
    size = F.ceil(F.col("_total") / segments)
    stretch = F.floor(F.col("row_index") / F.col("_size"))
    return (
        rows.select("comparison_id", "row_index", "change_type").join(total, "comparison_id")
        .withColumn("_size", F.greatest(F.lit(1), size))
        .withColumn("_stretch", stretch)
        .groupBy("comparison_id", "_stretch")
        .agg(F.min("row_index").alias("start"), F.count("*").alias("clauses"),
             F.min_by("change_type", severity(F.col("change_type"))).alias("change_type"))
        .drop("_stretch")
    )


def filter_rows(rows: DataFrame, term: str = "", excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the kept types that mention the term anywhere."""
    if excluded:
        rows = rows.filter(~F.col("change_type").isin(*excluded))
    needle = term.strip().lower()
    if len(needle) < fixed.TERM_MIN_CHARS:
        return rows
    fields = [f"{side}.{field}" for field in ("content", "title", "section")
              for side in ("v1", "v2")] + ["label"]
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(F.contains(F.lower(field), F.lit(needle)), F.lit(False))
    return rows.filter(hit)


def toggle_types(excluded: tuple[str, ...], chosen: tuple[str, ...]) -> tuple[str, ...]:
    """Selecting a tally isolates its types; selecting again shows everything."""
    if not chosen or excluded:
        return ()
    return tuple(t for t in fixed.CHANGE_TYPES if t not in chosen)


def export_rows(rows: DataFrame, label_v1: str, label_v2: str) -> DataFrame:
    """Flat rows of one comparison for a CSV file, headed by the two version labels."""
    def score(name: str) -> Column:
        return F.coalesce(F.format_string("%.4f", F.col(name)), F.lit("N/A"))

    def part(side: str, field: str, missing: str) -> Column:
        return F.when(F.col(side).isNull(), missing).otherwise(
            F.coalesce(f"{side}.{field}", F.lit("")))

    columns = [F.col("change_type").alias("Change Type")]
    for side, heading in (("v1", label_v1), ("v2", label_v2)):
        columns += [part(side, "clause_number", "").alias(f"{heading} Clause"),
                    part(side, "section", "").alias(f"{heading} Section"),
                    part(side, "content", fixed.NOT_PRESENT).alias(f"{heading} Text")]
    similarity, confidence = [
        F.when(F.col(name).isNull(), "N/A").otherwise(score(name))
        for name in ("similarity_score", "match_score")]
    flat = rows.select(
        "row_index", *columns, similarity.alias("Similarity"), confidence.alias("Match Confidence"),
        F.col("redline.words_added").alias("Words Added"),
        F.col("redline.words_removed").alias("Words Removed"))
    # a sort reads its input twice, for the ranges and for the rows: written, it is redlined once
    return cut(flat).orderBy("row_index").drop("row_index")
