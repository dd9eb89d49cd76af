"""The library: documents, versions and clauses, read and changed as whole tables.

``LibraryStore`` keeps each table as an append-only set of batches, so storing an
edition costs what the edition holds and a repeated batch overwrites itself; the
current state is worked out on read.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clauseloom import fixed
from clauseloom.operators.positions import numbered

DOCUMENTS = ("id long, name string, description string, country_code string, doc_type string, "
             "publisher string, created_at timestamp")
VERSIONS = ("id long, document_id long, version_label string, source_file string, "
            "parser_profile string, parser_confidence double, page_count int, "
            "uploaded_at timestamp")
CLAUSES = ("id long, version_id long, clause_number string, title string, content string, "
           "content_hash string, section string, level int, ordinal int")


# -- lookups -----------------------------------------------------------------

def country_name(code: Column) -> Column:
    """Name of a jurisdiction; none is "Unassigned", an unknown code stands for itself."""
    names = F.create_map(*[F.lit(x) for j in fixed.JURISDICTIONS for x in (j[0], j[1])])
    filled = F.nullif(code, F.lit(""))
    return F.when(filled.isNull(), fixed.UNASSIGNED).otherwise(
        F.coalesce(F.try_element_at(names, filled), filled))


def _country() -> Column:
    return F.coalesce(F.nullif(F.col("country_code"), F.lit("")), F.lit(fixed.DEFAULT_COUNTRY))


# -- reads -------------------------------------------------------------------

def _clause_counts(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy(F.col("version_id").alias("id")).agg(
        F.count("*").alias("clause_count"))


def list_documents(documents: DataFrame, versions: DataFrame,
                   country: str | None = None) -> DataFrame:
    """Documents by name with their number of versions."""
    counts = versions.groupBy(F.col("document_id").alias("id")).agg(
        F.count("*").alias("version_count"))
    if country:
        documents = documents.filter(F.col("country_code") == country)
    return (
        documents.join(counts, "id", "left")
        .select("id", "name", "description", _country().alias("country_code"),
                country_name(F.col("country_code")).alias("country_name"), "doc_type", "publisher",
                F.coalesce("version_count", F.lit(0)).cast("long").alias("version_count"),
                "created_at")
        .orderBy("name"))


def list_versions(documents: DataFrame, versions: DataFrame, clauses: DataFrame,
                  country: str | None = None) -> DataFrame:
    """Every version with its document's fields and its number of clauses."""
    if country:
        documents = documents.filter(F.col("country_code") == country)
    owners = documents.select(
        F.col("id").alias("document_id"), F.col("name").alias("document_name"),
        F.col("country_code").alias("_stored_code"), "doc_type")
    return (
        versions.join(owners, "document_id").join(_clause_counts(clauses), "id", "left")
        .withColumn("country_code", F.col("_stored_code"))
        .select("id", "document_id", "document_name", _country().alias("country_code"),
                country_name(F.col("_stored_code")).alias("country_name"), "doc_type",
                "version_label", "source_file", "parser_profile", "parser_confidence",
                "page_count", F.coalesce("clause_count", F.lit(0)).cast("long")
                .alias("clause_count"), "uploaded_at", "_stored_code")
        .orderBy("_stored_code", "document_name", F.desc("uploaded_at")).drop("_stored_code"))


def versions_of(listed: DataFrame, document_id: int) -> DataFrame:
    return listed.filter(F.col("document_id") == document_id).orderBy(F.desc("uploaded_at"))


def version(listed: DataFrame, version_id: int) -> DataFrame:
    return listed.filter(F.col("id") == version_id)


def clauses_of(clauses: DataFrame, version_id: int) -> DataFrame:
    """Clauses of a version in document order, defaults filled in."""
    return (clauses.filter(F.col("version_id") == version_id)
            .orderBy(F.coalesce("ordinal", F.lit(0)), "id")
            .select("id", "clause_number", "title", "content", "section",
                    default_level().alias("level"), default_ordinal().alias("ordinal")))


def default_level() -> Column:
    """Missing or zero levels read as 2."""
    return F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(2))


def default_ordinal() -> Column:
    return F.coalesce("ordinal", F.lit(0))


def library_stats(documents: DataFrame, versions: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row: table counts and documents per country."""
    held = documents.groupBy("country_code").agg(F.count("*").alias("n")).select(
        F.lit("by_country").alias("what"), "country_code", "n")
    counts = held
    for frame, name in ((documents, "documents"), (versions, "versions"), (clauses, "clauses")):
        counts = counts.unionByName(frame.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("what"), F.lit(None).cast("string").alias("country_code"), "n"))
    # one row per country and table is all that is gathered
    countries = F.collect_list(F.when(
        F.col("what") == "by_country",
        F.struct(F.coalesce("country_code", F.lit(fixed.UNASSIGNED)).alias("code"), "n")))
    return counts.agg(
        *[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name)
          for name in ("documents", "versions", "clauses")],
        F.map_from_entries(F.array_sort(countries)).alias("by_country"))


def find_version(listed: DataFrame, name_part: str, label: str) -> DataFrame:
    """First version, in listing order, whose document name holds the part."""
    return (listed.filter(F.contains("document_name", F.lit(name_part))
                          & (F.col("version_label") == label))
            .orderBy("country_code", "document_name", F.desc("uploaded_at")).limit(1))


def default_pair(listed: DataFrame) -> DataFrame:
    """Oldest and newest edition of the largest document that has at least two."""
    return (
        listed.groupBy("document_id", "document_name")
        .agg(F.count("*").alias("editions"), F.sum("clause_count").alias("clauses"),
             F.min_by("id", F.struct("uploaded_at", "id")).alias("baseline"),
             F.max_by("id", F.struct("uploaded_at", "id")).alias("revision"))
        .filter("editions >= 2")
        .orderBy(F.desc("clauses"), "document_name", "document_id").limit(1))


# -- changes as table functions ----------------------------------------------

def document_id(name: Column) -> Column:
    return F.xxhash64(name)


def version_id(document: Column, label: Column) -> Column:
    return F.xxhash64(document, label)


def upsert_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by unique name; non-empty incoming values win, empty ones change nothing."""
    new = incoming.select(*[F.col(c).alias(f"_{c}") for c in incoming.columns])
    joined = stored.join(new, F.col("name") == F.col("_name"), "full_outer")

    def newest(field: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"_{field}"), F.lit("")), F.col(field))

    return joined.select(
        F.coalesce("id", "_id").alias("id"), F.coalesce("name", "_name").alias("name"),
        newest("description").alias("description"),
        F.coalesce(newest("country_code"), F.lit(fixed.DEFAULT_COUNTRY)).alias("country_code"),
        newest("doc_type").alias("doc_type"), newest("publisher").alias("publisher"),
        F.coalesce("created_at", "_created_at").alias("created_at"))


def hashed(clauses: DataFrame) -> DataFrame:
    """Fill in content_hash."""
    return clauses.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))


def replace_versions(versions: DataFrame, clauses: DataFrame, new_versions: DataFrame,
                     new_clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store editions; one with the same document and label is replaced with its clauses."""
    key = ["document_id", "version_label"]
    replaced = versions.join(new_versions.select(*key), key, "left_semi").select(
        F.col("id").alias("version_id"))
    kept_versions = versions.join(new_versions.select(*key), key, "left_anti")
    kept_clauses = clauses.join(replaced, "version_id", "left_anti")
    return (kept_versions.unionByName(new_versions),
            kept_clauses.unionByName(hashed(new_clauses)))


def delete_versions(versions: DataFrame, clauses: DataFrame,
                    gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove versions by ``id`` together with their clauses."""
    return (versions.join(gone.select("id"), "id", "left_anti"),
            clauses.join(gone.select(F.col("id").alias("version_id")), "version_id", "left_anti"))


def delete_documents(documents: DataFrame, versions: DataFrame, clauses: DataFrame,
                     gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove documents by ``id`` and everything under them."""
    ids = gone.select("id")
    below = versions.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return (documents.join(ids, "id", "left_anti"),
            *delete_versions(versions, clauses, below))


def backfill_ordinals(clauses: DataFrame) -> DataFrame:
    """Versions of several clauses whose ordinals are all zero get them from the id order."""
    stale = clauses.groupBy("version_id").agg(
        F.max("ordinal").alias("_last"), F.count("*").alias("_rows")).filter(
        "_last = 0 AND _rows > 1").select("version_id")
    kind = dict(clauses.dtypes)["ordinal"]
    filled = numbered(clauses.join(stale, "version_id", "left_semi"), ["version_id"], ["id"], "_place")
    filled = filled.withColumn("ordinal", F.col("_place").cast(kind)).select(*clauses.columns)
    return clauses.join(stale, "version_id", "left_anti").select(*clauses.columns).unionByName(filled)


# -- the store ---------------------------------------------------------------

class LibraryStore:
    """Append-only batches under one folder; the last batch of a key counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def append(self, table: str, rows: DataFrame, batch: int) -> None:
        """Write one batch; writing the same batch again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}", compression="zstd")

    def batch(self, table: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/batch={batch}")

    def _log(self, table: str, schema: str) -> DataFrame:
        extra = ", deleted boolean, batch long"
        try:
            return self.spark.read.schema(schema + extra).parquet(f"{self.root}/{table}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema + extra)
            raise

    def _last(self, table: str, schema: str, *key: str) -> DataFrame:
        """Latest row per key, deletions included."""
        log = self._log(table, schema)
        fields = [c for c in log.columns if c not in (*key, "batch")]
        return log.groupBy(*key).agg(F.max_by(F.struct(*fields, "batch"), "batch").alias("_r")) \
            .select(*key, "_r.*")

    def documents(self) -> DataFrame:
        """Current documents: per field the last non-empty value since the last deletion."""
        log = self._log("documents", DOCUMENTS)
        removed = log.filter("deleted").groupBy("name").agg(F.max("batch").alias("_removed"))
        live = log.join(removed, "name", "left").filter(
            F.coalesce(F.col("batch") > F.col("_removed"), F.lit(True)))

        def last(field: str) -> Column:
            value = F.nullif(F.col(field), F.lit(""))
            return F.max_by(value, F.when(value.isNotNull(), F.col("batch"))).alias(field)

        return live.groupBy("name").agg(
            F.min_by("id", "batch").alias("id"), last("description"),
            F.coalesce(last("country_code"), F.lit(fixed.DEFAULT_COUNTRY)).alias("country_code"),
            last("doc_type"), last("publisher"), F.min("created_at").alias("created_at"))

    def versions(self) -> DataFrame:
        latest = self._last("versions", VERSIONS, "document_id", "version_label")
        return latest.filter(~F.coalesce("deleted", F.lit(False)))

    def clauses(self) -> DataFrame:
        """Clauses of the batch each current version was written in."""
        current = self.versions().select(F.col("id").alias("version_id"), "batch")
        return self._log("clauses", CLAUSES).drop("deleted").join(
            current, ["version_id", "batch"], "left_semi").drop("batch")

    def store(self, documents: DataFrame, versions: DataFrame, clauses: DataFrame,
              batch: int | None = None) -> None:
        """Clauses first and versions last, so an edition shows up only when it is whole.

        Without a number the batch is the newest.  A number below the last one, unless it
        is written again, would hide its rows behind newer ones and is refused.
        """
        if batch is None:
            batch = self.claim()
        elif batch < self.last_batch() and f"batch={batch}" not in self._files("documents")[1] \
                and str(batch) not in self._files("_numbers")[1]:
            raise ValueError(f"batch {batch} is older than what the store holds; take claim()")
        self.append("documents", documents, batch)
        self.append("clauses", hashed(clauses), batch)
        self.append("versions", versions, batch)

    def delete_versions(self, gone: DataFrame, batch: int) -> None:
        rows = self.versions().drop("batch").join(gone.select("id"), "id", "left_semi")
        self.append("versions", rows.withColumn("deleted", F.lit(True)), batch)

    def delete_documents(self, gone: DataFrame, batch: int) -> None:
        doomed = self.documents().join(gone.select("id"), "id", "left_semi")
        below = self.versions().join(
            gone.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        self.delete_versions(below, batch)
        self.append("documents", doomed.withColumn("deleted", F.lit(True)), batch)

    def _files(self, folder: str) -> tuple[Any, list[str]]:
        """The file system of the store, and the names in one of its folders."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        return files, [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def last_batch(self) -> int:
        """The greatest batch number of any table, 0 in an empty store; names alone are read."""
        names = [n for table in ("documents", "versions", "clauses") for n in self._files(table)[1]]
        return max((int(n[6:]) for n in names if n.startswith("batch=")), default=0)

    def claim(self) -> int:
        """A batch number above all others, for this caller alone.

        Streams and single batches take their numbers here, so a later one is always
        newer.  A number is claimed by creating its file, which succeeds once.
        """
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        while True:
            files, names = self._files("_numbers")
            number = max([self.last_batch(), *(int(n) for n in names if n.isdigit())]) + 1
            if files.createNewFile(path(f"{self.root}/_numbers/{number}")):
                return number

    def compacted(self, root: str) -> LibraryStore:
        """A new store under ``root`` that holds the current state alone, as one batch.

        The batch keeps the last number used, so later batches go on from there; the old
        folder is left as it is.
        """
        fresh = LibraryStore(self.spark, root)
        fresh.store(self.documents(), self.versions().drop("batch", "deleted"), self.clauses(),
                    self.last_batch())
        return fresh


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "quoteAll", False).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def write_study(result: DataFrame, path: str) -> None:
    """Study results as JSON lines."""
    result.write.mode("overwrite").json(path)
