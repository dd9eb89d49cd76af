"""How an instrument grew and where it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom import fixed
from clauseloom.functions.text import word_total
from clauseloom.operators import metrics, register, report
from clauseloom.sources.library import country_name

TOP_SECTIONS = 8
TOP_PER_REGISTER = 4
TOP_TOTALS = 10
TOP_REFERENCES = 12


def section_of(number: Column) -> Column:
    """Which part of the instrument a clause number belongs to."""
    leading = F.regexp_extract(number, r"^(\d{1,2})\.", 1)
    out = F.when(leading != "", F.concat(F.lit("Section "), leading)).when(
        number.startswith("Requirement") | number.startswith("B"), "Requirements")
    for prefix in ("Appendix", "Table", "Diagram"):
        out = out.when(number.startswith(prefix), prefix)
    return out.when(number.startswith("Section"), number).otherwise("Other")


def edition_shape(clauses: DataFrame) -> DataFrame:
    """Clauses, words, mean words and long clauses per version."""
    words = word_total(F.col("content"))
    return clauses.groupBy("version_id").agg(
        F.count("*").alias("clauses"), F.sum(words).alias("words"),
        F.round(F.sum(words).cast("double") / F.count("*"), 1).alias("mean_clause_words"),
        F.count_if(words > fixed.LONG_CLAUSE_WORDS).alias("clauses_over_180_words"))


def consecutive(versions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One comparison per pair of neighbouring editions, named by the older one."""
    following = F.lead("id").over(Window.partitionBy("document_id").orderBy("uploaded_at", "id"))
    pairs = versions.select(F.col("id").alias("comparison_id"), "document_id",
                            F.col("id").alias("version_v1"), following.alias("version_v2"))
    return pairs.filter(F.col("version_v2").isNotNull())


def transitions(rows: DataFrame) -> DataFrame:
    """Summary of each comparison with its net growth."""
    return report.summarise(rows).withColumn(
        "change_rate_percent", F.round("change_rate", 1)).withColumn(
        "net_words", F.col("words_added") - F.col("words_removed")).drop("change_rate")


def changed_sections(rows: DataFrame, limit: int = TOP_SECTIONS) -> DataFrame:
    """Sections with the most changed clauses, per comparison."""
    counts = rows.filter(F.col("change_type") != fixed.UNCHANGED).groupBy(
        "comparison_id", section_of(report.row_number_of()).alias("section")).agg(
        F.count("*").alias("n"))
    return metrics.top(counts, limit, "comparison_id", name="section")


def volume_one(amendments: DataFrame) -> DataFrame:
    return register.of_volume(amendments, 1).withColumn("section", section_of(F.col("reference")))


def register_attention(amendments: DataFrame) -> DataFrame:
    """Amendments and sections touched per register."""
    return volume_one(amendments).groupBy("booklet").agg(
        F.count("*").alias("amendments"), F.countDistinct("section").alias("sections_touched"))


def register_sections(amendments: DataFrame, limit: int = TOP_PER_REGISTER) -> DataFrame:
    """Most amended sections of each register."""
    counts = volume_one(amendments).groupBy("booklet", "section").agg(F.count("*").alias("n"))
    return metrics.top(counts, limit, "booklet", name="section")


def section_totals(amendments: DataFrame, limit: int | None = TOP_TOTALS) -> DataFrame:
    counts = volume_one(amendments).groupBy("section").agg(F.count("*").alias("amendments"))
    return counts if limit is None else counts.orderBy(F.desc("amendments"), "section").limit(limit)


def operation_totals(amendments: DataFrame) -> DataFrame:
    return volume_one(amendments).groupBy("operation").agg(F.count("*").alias("amendments"))


def repeated_references(amendments: DataFrame, limit: int | None = TOP_REFERENCES) -> DataFrame:
    """References amended in more than one register, most frequent first; None for all."""
    counts = volume_one(amendments).groupBy("reference").agg(
        F.countDistinct("booklet").alias("rounds")).filter("rounds > 1")
    return counts if limit is None else counts.orderBy(F.desc("rounds"), "reference").limit(limit)


def jurisdiction_sizes(documents: DataFrame, versions: DataFrame,
                       clauses: DataFrame) -> DataFrame:
    """Editions, clauses and words per country, the unassigned one left out."""
    per_version = clauses.groupBy(F.col("version_id").alias("id")).agg(
        F.count("*").alias("clauses"), F.sum(word_total(F.col("content"))).alias("words"))
    code = F.coalesce(F.nullif(F.col("country_code"), F.lit("")), F.lit(fixed.DEFAULT_COUNTRY))
    owners = documents.select(F.col("id").alias("document_id"), code.alias("country_code")).filter(
        F.col("country_code") != fixed.DEFAULT_COUNTRY)
    return (
        versions.join(per_version, "id", "left").join(owners, "document_id")
        .groupBy("country_code")
        .agg(F.count("*").alias("editions"),
             F.coalesce(F.sum("clauses"), F.lit(0)).alias("clauses"),
             F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        .withColumn("country_name", country_name(F.col("country_code")))
        .orderBy(F.desc("words"), "country_code"))
