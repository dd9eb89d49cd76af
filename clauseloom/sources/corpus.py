"""Corpus scans: texts, block tables, the registry and its coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clauseloom import fixed
from clauseloom.functions.text import strip
from clauseloom.sources import registry

REGISTRY_SCHEMA = (
    "key string, title string, jurisdiction string, publisher string, edition string, "
    "url string, filename string, access string, kind string, parent string")
PLAN_SCHEMA = "key string, document_name string, version_label string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, text): one row per UTF-8 file, keyed by the file name without its ending."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("key"),
        F.col("value").alias("text"))


def page_text(blocks: DataFrame, document: str = "doc_id") -> DataFrame:
    """Reading-order text of a table of positioned blocks.

    Blocks within ten points count as one line band and are read left to right.
    A page is gathered from its own blocks only, a document from its pages.
    """
    band = F.bround(F.col("y0") / 10) * 10
    kept = blocks.filter("block_type = 0").withColumn("_text", strip(F.col("text"))).filter(
        F.col("_text") != "")
    pages = kept.groupBy(document, "page").agg(F.array_sort(F.collect_list(F.struct(
        band.alias("band"), F.col("x0"), F.col("block_no"), F.col("_text").alias("t"))))
        .alias("_blocks")).select(document, "page", F.array_join(
            F.transform("_blocks", lambda b: b["t"]), "\n").alias("_page"))
    return pages.groupBy(document).agg(F.array_sort(F.collect_list(
        F.struct("page", "_page"))).alias("_pages")).select(
        document, F.array_join(F.transform("_pages", lambda p: p["_page"]), "\n\n").alias("text"))


def registry_table(spark: SparkSession) -> DataFrame:
    """The registered instruments."""
    return spark.createDataFrame(registry.ENTRIES, REGISTRY_SCHEMA)


def load_plan(spark: SparkSession) -> DataFrame:
    """Which document and edition each registered key is loaded as."""
    return spark.createDataFrame(registry.LOAD_PLAN, PLAN_SCHEMA)


def open_entries(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("access") == "open")


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(filename, size_bytes) of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"))


def coverage(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Registry with ``present`` and ``size_bytes``; an empty file counts as absent."""
    held = files.filter(F.col("size_bytes") > 0).groupBy("filename").agg(
        F.max("size_bytes").alias("size_bytes"))
    return (entries.join(held, "filename", "left")
            .withColumn("present", F.col("size_bytes").isNotNull())
            .withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)).cast("long")))


def _share(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def coverage_summary(covered: DataFrame, *by: str) -> DataFrame:
    """Collection progress, overall or per group."""
    public, present = F.col("access") == "open", F.col("present")
    licensed = F.col("access") == "licensed"
    measures = [
        F.count("*").alias("total"), _share(present, "collected"),
        _share(public, "downloadable"), _share(public & present, "downloadable_collected"),
        _share(licensed, "licensed"), _share(licensed & present, "licensed_collected"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")]
    return covered.groupBy(*by).agg(*measures)


def pending_loads(entries: DataFrame, plan: DataFrame, loaded: DataFrame, replace: bool = False,
                  only: tuple[str, ...] = ()) -> DataFrame:
    """Registered entries that have a load plan and are not stored yet."""
    wanted = entries.join(plan, "key")
    if only:
        wanted = wanted.filter(F.col("jurisdiction").isin([code.upper() for code in only]))
    if replace:
        return wanted
    return wanted.join(loaded, ["document_name", "version_label"], "left_anti")


def jurisdictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.JURISDICTIONS,
        "code string, name string, sigil string, authority string, instrument string, "
        "parser_profile string")
