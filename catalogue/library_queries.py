"""Sources, the library's reads and changes, and search."""

from pyspark.sql import functions as F

from catalogue.base import documents, query, scratch, sql_strip
from catalogue.fixtures import (
    SQL_COUNTRY_NAME, SQL_LIBRARY, library_clauses, library_documents, library_versions,
)
from clauseloom.operators import search_index
from clauseloom.operators.search import search
from clauseloom.plans import ingest
from clauseloom.session import cut
from clauseloom.sources import corpus, library
from clauseloom.streaming.ingest import read_submissions, start_ingest

# -- sources -----------------------------------------------------------------

_REGISTRY = """
listed AS (SELECT unnest(['adb-2019-v1', 'adb-amd-2020', 'ni-tbe-2012', 'bs-9999', 'sc-thb-2022-d']) AS key,
  unnest(['EW', 'EW', 'NI', 'BSI', 'SC']) AS jurisdiction, unnest(['open', 'open', 'open', 'licensed', 'open']) AS access)
"""


def _entries(spark, folder):
    """One registered entry per document, in the registry's own proportions."""
    registered = corpus.registry_table(spark).select("key", "jurisdiction", "access").filter(
        F.col("key").isin("adb-2019-v1", "adb-amd-2020", "ni-tbe-2012", "bs-9999", "sc-thb-2022-d"))
    order = F.array_position(F.array(*[F.lit(k) for k in (
        "adb-2019-v1", "adb-amd-2020", "ni-tbe-2012", "bs-9999", "sc-thb-2022-d")]), F.col("key"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars")
    return docs.withColumn("_slot", F.col("doc_id") % 5 + 1).join(
        registered.withColumn("_slot", order), "_slot").select(
        F.concat_ws("/", "key", "doc_id").alias("key"), "jurisdiction", "access",
        F.concat(F.lit("f"), F.col("doc_id"), F.lit(".pdf")).alias("filename"),
        "doc_id", "n_chars")


def _covered(spark, folder):
    entries = _entries(spark, folder)
    files = entries.filter(F.col("doc_id") % 3 > 0).select(
        "filename", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars"))
        .alias("size_bytes"))
    return corpus.coverage(entries, files)


SQL_COVERED = f"""
{_REGISTRY},
slots AS (SELECT *, row_number() OVER () AS slot FROM (SELECT unnest([1, 2, 3, 4, 5]) AS n,
    unnest(['EW', 'EW', 'NI', 'BSI', 'SC']) AS jurisdiction, unnest(['open', 'open', 'open', 'licensed', 'open']) AS access)),
covered AS (SELECT doc_id, jurisdiction, access, 'f' || doc_id || '.pdf' AS filename,
    doc_id % 3 > 0 AND doc_id % 7 > 0 AND n_chars > 0 AS present,
    CASE WHEN doc_id % 3 > 0 AND doc_id % 7 > 0 THEN n_chars ELSE 0 END AS size_bytes
  FROM documents JOIN slots ON n = doc_id % 5 + 1)
"""


@query("corpus_coverage", f"WITH {SQL_COVERED} SELECT filename, access, present, size_bytes FROM covered")
def corpus_coverage(spark, folder):
    return _covered(spark, folder).select("filename", "access", "present", "size_bytes")


@query("coverage_summary", f"""WITH {SQL_COVERED}
SELECT jurisdiction, count(*) AS total, count(*) FILTER (WHERE present) AS collected,
  count(*) FILTER (WHERE access = 'open') AS downloadable,
  count(*) FILTER (WHERE access = 'open' AND present) AS downloadable_collected,
  count(*) FILTER (WHERE access = 'licensed') AS licensed,
  count(*) FILTER (WHERE access = 'licensed' AND present) AS licensed_collected,
  CAST(sum(size_bytes) AS BIGINT) AS bytes FROM covered GROUP BY jurisdiction""")
def coverage_summary(spark, folder):
    return corpus.coverage_summary(_covered(spark, folder), "jurisdiction")


@query("open_entries", f"WITH {SQL_COVERED} SELECT filename, jurisdiction FROM covered WHERE access = 'open'")
def open_entries(spark, folder):
    return corpus.open_entries(_entries(spark, folder)).select("filename", "jurisdiction")


@query("pending_loads", f"""WITH {SQL_COVERED}
SELECT filename, 'Instrument ' || (doc_id // 150) AS document_name, 'Edition ' || doc_id AS version_label
FROM covered WHERE doc_id % 4 > 0 AND jurisdiction IN ('EW', 'NI') AND doc_id % 6 > 0""")
def pending_loads(spark, folder):
    """Entries with a load plan that are not stored yet, for two jurisdictions."""
    entries = _entries(spark, folder)
    d = F.col("doc_id")
    plan = entries.filter(d % 4 > 0).select(
        "key", F.concat(F.lit("Instrument "), F.floor(d / 150)).alias("document_name"),
        F.concat(F.lit("Edition "), d).alias("version_label"))
    loaded = entries.filter(d % 6 == 0).select(
        F.concat(F.lit("Instrument "), F.floor(d / 150)).alias("document_name"),
        F.concat(F.lit("Edition "), d).alias("version_label"))
    return corpus.pending_loads(entries, plan, loaded, only=("ew", "NI")).select(
        "filename", "document_name", "version_label")


@query("page_text", f"""
WITH raw AS (SELECT doc_id, i, {sql_strip('line')} AS line, (i // 8) AS page, (i % 8) // 2 AS band, (i * 7) % 2 AS col
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
pages AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY band, 1 - col, i) AS t FROM raw
  WHERE line <> '' AND i % 9 > 0 GROUP BY ALL)
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY doc_id""")
def page_text(spark, folder):
    """Lines as positioned blocks of eight to a page in two columns, read back in order."""
    i = F.col("i")
    blocks = documents(spark, folder, "doc_id", "text").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select(
        "doc_id", F.floor(i / 8).cast("int").alias("page"),
        F.when(i * 7 % 2 == 1, 40.0).otherwise(300.0).alias("x0"),
        # the two blocks of a band lie up to four points apart
        (F.floor(i % 8 / 2) * 20 + 100 + F.when(i % 2 == 1, 4).otherwise(0)).cast("double")
        .alias("y0"), "text", i.alias("block_no"),
        F.when(i % 9 == 0, 1).otherwise(0).alias("block_type"))
    return corpus.page_text(blocks)


@query("read_texts", "SELECT source AS key, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY source")
def read_texts(spark, folder):
    """Texts written out as files of at most fifty documents, scanned back whole."""
    path = scratch(spark, "texts")
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit("\x1f"))
    documents(spark, folder, "doc_id", "text", "source").select(
        F.concat_ws("\x1e", "source", flat).alias("value")).write.option(
        "maxRecordsPerFile", 50).text(path)
    back = corpus.read_texts(spark, path).select("key", F.explode(F.split(
        F.rtrim(F.col("text"), F.lit("\n")), "\n")).alias("line"))
    fields = F.split("line", "\x1e")
    return back.groupBy(F.get(fields, F.lit(0)).alias("key")).agg(
        F.count("*").alias("documents"),
        F.sum(F.length(F.get(fields, F.lit(1)))).alias("characters"))


# -- reads -------------------------------------------------------------------

def _library(spark, folder):
    return (library_documents(spark, folder), library_versions(spark, folder),
            library_clauses(spark, folder))


SQL_LISTED = f"""
{SQL_LIBRARY},
counts AS (SELECT version_id, count(*) AS clause_count FROM clauses GROUP BY 1),
listed AS (SELECT v.id, v.document_id, i.name AS document_name, coalesce(i.country_code, 'INT') AS country_code,
    {SQL_COUNTRY_NAME} AS country_name, i.doc_type, v.version_label, v.source_file, v.parser_profile,
    v.parser_confidence, v.page_count, coalesce(c.clause_count, 0) AS clause_count, v.uploaded_day,
    i.country_code AS stored_code
  FROM versions v JOIN instruments i ON i.id = v.document_id LEFT JOIN counts c ON c.version_id = v.id)
"""


@query("list_documents", f"""WITH {SQL_LIBRARY},
counts AS (SELECT document_id, count(*) AS version_count FROM versions GROUP BY 1)
SELECT i.id, i.name, i.description, coalesce(country_code, 'INT') AS country_code,
  {SQL_COUNTRY_NAME} AS country_name, doc_type, publisher, coalesce(version_count, 0) AS version_count
FROM instruments i LEFT JOIN counts ON document_id = i.id""")
def list_documents(spark, folder):
    docs, versions, _ = _library(spark, folder)
    return library.list_documents(docs, versions).drop("created_at")


@query("list_versions", f"""WITH {SQL_LISTED}
SELECT id, document_id, document_name, country_code, country_name, doc_type, version_label, source_file,
  parser_profile, parser_confidence, page_count, clause_count FROM listed""")
def list_versions(spark, folder):
    return library.list_versions(*_library(spark, folder)).drop("uploaded_at")


@query("list_documents_in_country", f"""WITH {SQL_LIBRARY},
counts AS (SELECT document_id, count(*) AS version_count FROM versions GROUP BY 1)
SELECT i.id, i.name, country_code, {SQL_COUNTRY_NAME} AS country_name, coalesce(version_count, 0) AS version_count
FROM instruments i LEFT JOIN counts ON document_id = i.id WHERE country_code = 'EW'""")
def list_documents_in_country(spark, folder):
    docs, versions, _ = _library(spark, folder)
    return library.list_documents(docs, versions, country="EW").select(
        "id", "name", "country_code", "country_name", "version_count")


@query("list_versions_in_country", f"""WITH {SQL_LISTED}
SELECT id, document_name, country_code, country_name, version_label, clause_count FROM listed WHERE stored_code = 'EW'""")
def list_versions_in_country(spark, folder):
    return library.list_versions(*_library(spark, folder), country="EW").select(
        "id", "document_name", "country_code", "country_name", "version_label", "clause_count")


@query("versions_of_document", f"""WITH {SQL_LISTED}
SELECT id, version_label, clause_count FROM listed WHERE document_id = 1""")
def versions_of_document(spark, folder):
    listed = library.list_versions(*_library(spark, folder))
    return library.versions_of(listed, 1).select("id", "version_label", "clause_count")


@query("one_version", f"WITH {SQL_LISTED} SELECT id, document_name, country_name FROM listed WHERE id = 2")
def one_version(spark, folder):
    listed = library.list_versions(*_library(spark, folder))
    return library.version(listed, 2).select("id", "document_name", "country_name")


@query("clauses_of_version", f"""WITH {SQL_LIBRARY}
SELECT id, clause_number, title, content, section, coalesce(nullif(level, 0), 2) AS level, ordinal
FROM clauses WHERE version_id = 3""")
def clauses_of_version(spark, folder):
    return library.clauses_of(library_clauses(spark, folder), 3)


@query("library_stats", f"""WITH {SQL_LIBRARY},
per AS (SELECT coalesce(country_code, 'Unassigned') AS country_code, count(*) AS n FROM instruments GROUP BY 1)
SELECT (SELECT count(*) FROM instruments) AS documents, (SELECT count(*) FROM versions) AS versions,
  (SELECT count(*) FROM clauses) AS clauses, unnest(list(country_code)) AS country_code, unnest(list(n)) AS held FROM per""")
def library_stats(spark, folder):
    docs, versions, clauses = _library(spark, folder)
    stats = library.library_stats(docs, versions, clauses)
    return stats.select("documents", "versions", "clauses",
                        F.explode("by_country").alias("country_code", "held"))


@query("find_version", f"""WITH {SQL_LISTED}
SELECT id, document_name FROM listed WHERE contains(document_name, 'ment 1') AND version_label = 'Edition 2'
ORDER BY country_code, document_name, uploaded_day DESC LIMIT 1""")
def find_version(spark, folder):
    listed = library.list_versions(*_library(spark, folder))
    return library.find_version(listed, "ment 1", "Edition 2").select("id", "document_name")


@query("default_pair", f"""WITH {SQL_LISTED}
SELECT document_id, document_name, count(*) AS editions, CAST(sum(clause_count) AS BIGINT) AS clauses,
  arg_min(id, uploaded_day) AS baseline, arg_max(id, uploaded_day) AS revision FROM listed
GROUP BY ALL HAVING count(*) >= 2 ORDER BY clauses DESC, document_name, document_id LIMIT 1""")
def default_pair(spark, folder):
    return library.default_pair(library.list_versions(*_library(spark, folder)))


@query("jurisdiction_names", f"""WITH {SQL_LIBRARY}
SELECT id, {SQL_COUNTRY_NAME} AS country_name, coalesce(map {{'EW': 'approved_document', 'SC': 'technical_handbook',
  'NI': 'technical_booklet', 'IE': 'technical_guidance', 'BSI': 'british_standard', 'INT': 'generic'}}[country_code],
  'generic') AS parser_profile FROM instruments""")
def jurisdiction_names(spark, folder):
    from clauseloom.operators.parse import profile_of_country

    code = F.col("country_code")
    return library_documents(spark, folder).select(
        "id", library.country_name(code).alias("country_name"),
        profile_of_country(code).alias("parser_profile"))


# -- changes -----------------------------------------------------------------

@query("upsert_documents", f"""WITH {SQL_LIBRARY},
incoming AS (SELECT name, CASE WHEN id % 3 = 0 THEN 'Renewed' WHEN id % 3 = 1 THEN '' END AS description,
    CASE WHEN id % 2 = 0 THEN 'SC' ELSE '' END AS country_code, CAST(NULL AS VARCHAR) AS doc_type, 'Press' AS publisher
  FROM instruments UNION ALL SELECT 'New ' || id, NULL, NULL, 'Note', NULL FROM instruments)
SELECT coalesce(s.name, n.name) AS name, coalesce(nullif(n.description, ''), s.description) AS description,
  coalesce(nullif(n.country_code, ''), s.country_code, 'INT') AS country_code,
  coalesce(nullif(n.doc_type, ''), s.doc_type) AS doc_type, coalesce(nullif(n.publisher, ''), s.publisher) AS publisher
FROM instruments s FULL OUTER JOIN incoming n ON s.name = n.name""")
def upsert_documents(spark, folder):
    stored = library_documents(spark, folder)
    i, none = F.col("id"), F.lit(None).cast("string")
    renewed = stored.select(
        "id", "name", F.when(i % 3 == 0, "Renewed").when(i % 3 == 1, "").alias("description"),
        F.when(i % 2 == 0, "SC").otherwise("").alias("country_code"), none.alias("doc_type"),
        F.lit("Press").alias("publisher"), "created_at")
    added = stored.select(
        (i + 1000000).alias("id"), F.concat(F.lit("New "), i).alias("name"),
        none.alias("description"), none.alias("country_code"), F.lit("Note").alias("doc_type"),
        none.alias("publisher"), "created_at")
    return library.upsert_documents(stored, renewed.unionByName(added)).drop("id", "created_at")


def _resubmitted(spark, folder):
    """Every fourth version stored again with half its clauses, and some new ones."""
    versions, clauses = library_versions(spark, folder), library_clauses(spark, folder)
    again = versions.filter("id % 4 = 0").withColumn("id", F.col("id") + 1000000)
    fresh = versions.filter("id % 5 = 0").withColumn("id", F.col("id") + 2000000).withColumn(
        "version_label", F.lit("Edition 9"))
    texts = clauses.filter("version_id % 4 = 0 AND ordinal % 2 = 0").withColumn(
        "version_id", F.col("version_id") + 1000000)
    return library.replace_versions(versions, library.hashed(clauses),
                                    again.unionByName(fresh), texts)


@query("replace_versions", f"""WITH {SQL_LIBRARY}
SELECT version_id, clause_number, ordinal, sha256(content) AS content_hash FROM clauses WHERE version_id % 4 > 0
UNION ALL SELECT version_id + 1000000, clause_number, ordinal, sha256(content) FROM clauses
WHERE version_id % 4 = 0 AND ordinal % 2 = 0""")
def replace_versions(spark, folder):
    _, clauses = _resubmitted(spark, folder)
    return clauses.select("version_id", "clause_number", "ordinal", "content_hash")


@query("replaced_version_list", f"""WITH {SQL_LIBRARY}
SELECT id, document_id, version_label FROM versions WHERE id % 4 > 0
UNION ALL SELECT id + 1000000, document_id, version_label FROM versions WHERE id % 4 = 0
UNION ALL SELECT id + 2000000, document_id, 'Edition 9' FROM versions WHERE id % 5 = 0""")
def replaced_version_list(spark, folder):
    versions, _ = _resubmitted(spark, folder)
    return versions.select("id", "document_id", "version_label")


@query("delete_versions", f"WITH {SQL_LIBRARY} SELECT id, version_id FROM clauses WHERE version_id % 3 > 0")
def delete_versions(spark, folder):
    _, versions, clauses = _library(spark, folder)
    return library.delete_versions(versions, clauses, versions.filter("id % 3 = 0"))[1].select(
        "id", "version_id")


@query("delete_documents", f"WITH {SQL_LIBRARY} SELECT id, version_id FROM clauses WHERE (version_id // 3) % 2 > 0")
def delete_documents(spark, folder):
    docs, versions, clauses = _library(spark, folder)
    gone = docs.filter("id % 2 = 0")
    return library.delete_documents(docs, versions, clauses, gone)[2].select("id", "version_id")


@query("backfill_ordinals", f"""WITH {SQL_LIBRARY}
SELECT id, CAST(CASE WHEN version_id % 2 = 0 THEN row_number() OVER (PARTITION BY version_id ORDER BY id) - 1
  ELSE ordinal END AS INTEGER) AS ordinal FROM clauses""")
def backfill_ordinals(spark, folder):
    """Every second version has lost its ordinals."""
    clauses = library_clauses(spark, folder).withColumn("ordinal", F.when(
        F.col("version_id") % 2 == 0, 0).otherwise(F.col("ordinal")))
    return library.backfill_ordinals(clauses).select("id", "ordinal")


@query("library_store", f"""WITH {SQL_LIBRARY}
SELECT version_id, count(*) AS clauses, CAST(sum(length(content)) AS BIGINT) AS characters FROM clauses
WHERE version_id % 4 > 0 AND version_id % 7 <> 6 GROUP BY 1
UNION ALL SELECT version_id + 1000000, count(*), CAST(sum(length(content)) AS BIGINT) FROM clauses
WHERE version_id % 4 = 0 AND version_id % 7 <> 6 AND ordinal % 2 = 0 GROUP BY 1""")
def library_store(spark, folder):
    """Two batches and a deletion through the append-only store, then its current clauses."""
    docs, versions, clauses = _library(spark, folder)
    store = library.LibraryStore(spark, scratch(spark, "library"))
    store.store(docs, versions, clauses, 1)
    again = versions.filter("id % 4 = 0").withColumn("id", F.col("id") + 1000000)
    store.store(docs, again, clauses.filter("version_id % 4 = 0 AND ordinal % 2 = 0").withColumn(
        "version_id", F.col("version_id") + 1000000), 2)
    gone = versions.filter("id % 7 = 6").select(F.when(
        F.col("id") % 4 == 0, F.col("id") + 1000000).otherwise(F.col("id")).alias("id"))
    store.delete_versions(gone, 3)
    return store.clauses().groupBy("version_id").agg(
        F.count("*").alias("clauses"), F.sum(F.length("content")).alias("characters"))


def _submissions(spark, folder, delivery, only="true"):
    """Every document as an edition, closed by a paragraph that tells its delivery."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(
        f"\n9.{delivery} This paragraph came with delivery {delivery} of the same edition of the guide, at its end."))
    return documents(spark, folder, "doc_id", "text").filter(only).select(
        F.concat(F.lit("Guide "), "doc_id").alias("document_name"), F.lit("v1").alias("version_label"),
        F.lit("EW").alias("country_code"), text.alias("text"),
        F.lit(None).cast("string").alias("description"), F.lit("Publisher").alias("publisher"),
        F.lit("texts").alias("source_file"), F.lit(delivery).alias("page_count"),
        F.timestamp_seconds(F.lit(delivery)).alias("uploaded_at"))


@query("stream_ingest", """
SELECT 'Guide ' || doc_id AS name, CASE WHEN doc_id % 10 = 0 THEN 3 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS delivery,
  true AS as_batch FROM documents""")
def stream_ingest(spark, folder):
    """Three deliveries through the stream, the last by a stream begun anew, held against one batch."""
    deliveries = [_submissions(spark, folder, 1), _submissions(spark, folder, 2, "doc_id % 5 = 0"),
                  _submissions(spark, folder, 3, "doc_id % 10 = 0")]
    store = library.LibraryStore(spark, scratch(spark, "library"))
    boxes, marks = [scratch(spark, "inbox") for _ in range(2)], [scratch(spark, "stream") for _ in range(2)]
    for delivery, at in zip(deliveries, (0, 0, 1)):
        delivery.write.mode("append").parquet(boxes[at])
        start_ingest(read_submissions(spark, boxes[at]), store.root, marks[at]).awaitTermination()
    batch = library.LibraryStore(spark, scratch(spark, "library"))
    everything = deliveries[0].unionByName(deliveries[1]).unionByName(deliveries[2])
    # the parsed rows feed three tables: written once, not parsed for each
    parsed = cut(ingest.parse_submissions(everything))
    batch.store(*ingest.library_rows(ingest.split_rejects(parsed)[0]), 1)

    def editions(held, prefix):
        digest = F.sum(F.xxhash64("ordinal", "clause_number", "title", "content", "section", "level").cast("decimal(38,0)"))
        clauses = held.clauses().groupBy("version_id").agg(F.count("*").alias("n"), digest.alias("h"))
        versions = held.versions().select(F.col("id").alias("version_id"), "document_id", "page_count")
        return clauses.join(versions, "version_id").join(
            held.documents().select(F.col("id").alias("document_id"), "name"), "document_id").select(
            "name", F.col("page_count").alias("delivery"), F.struct("page_count", "n", "h").alias(prefix))

    return editions(store, "a").join(editions(batch, "b").drop("delivery"), "name", "full").select(
        "name", "delivery", F.col("a").eqNullSafe(F.col("b")).alias("as_batch"))


@query("ingest_report", """
SELECT 'Guide ' || doc_id AS document_name, 'EW' AS country_code, false AS country_detected,
  true AS has_clauses FROM documents""")
def ingest_report(spark, folder):
    """What an ingest answers for every document."""
    parsed, _ = ingest.split_rejects(ingest.parse_submissions(_submissions(spark, folder, 1)))
    return ingest.ingest_report(parsed).select(
        "document_name", "country_code", "country_detected", (F.col("clause_count") > 0).alias("has_clauses"))


# -- search ------------------------------------------------------------------

def _sql_search(pattern: str, extra: str, needle: str) -> str:
    return f"""WITH {SQL_LIBRARY},
hits AS (SELECT c.*, v.version_label, v.document_id, i.name AS document_name, i.country_code AS stored_code,
    instr(lower(c.content), '{needle.lower()}') - 1 AS hit, {SQL_COUNTRY_NAME} AS country_name
  FROM clauses c JOIN versions v ON c.version_id = v.id JOIN instruments i ON i.id = v.document_id
  WHERE (content ILIKE '{pattern}' OR title ILIKE '{pattern}' OR section ILIKE '{pattern}'
    OR clause_number ILIKE '{pattern}') {extra}),
SELECT id, clause_number, section, coalesce(nullif(level, 0), 2) AS level, ordinal, version_id, version_label,
  document_name, coalesce(stored_code, 'INT') AS country_code, country_name,
  CASE WHEN hit < 0 THEN {sql_strip('substr(content, 1, 160)')} ELSE
    CASE WHEN hit > 80 THEN '…' ELSE '' END ||
    {sql_strip(f'substr(content, CAST(greatest(0, hit - 80) + 1 AS BIGINT), CAST(least(length(content), hit + {len(needle)} + 80) - greatest(0, hit - 80) AS BIGINT))')} ||
    CASE WHEN hit + {len(needle)} + 80 < length(content) THEN '…' ELSE '' END END AS excerpt FROM hits"""


_SHOWN = ["id", "clause_number", "section", "level", "ordinal", "version_id", "version_label",
          "document_name", "country_code", "country_name", "excerpt"]


@query("search_library", _sql_search("%tion the%", "", "tion the"))
def search_library(spark, folder):
    return search(" tion the ", *_library(spark, folder)).select(*_SHOWN)


@query("search_in_country", _sql_search("%th_re%", "AND stored_code = 'EW'", "th_re"))
def search_in_country(spark, folder):
    """A wildcard term within one country."""
    return search("th_re", *_library(spark, folder), country="EW").select(*_SHOWN)


@query("search_in_versions", _sql_search("%table%", "AND c.version_id IN (1, 2, 5, 8)", "table"))
def search_in_versions(spark, folder):
    return search("TABLE", *_library(spark, folder), version_ids=[1, 2, 5, 8]).select(*_SHOWN)


def _indexed(spark, folder, term, **options):
    """Postings written and read back, then the search."""
    held, path = _library(spark, folder), scratch(spark, "postings")
    search_index.write_postings(held[2], path)
    return search_index.indexed_search(term, spark.read.parquet(path), *held, **options).select(*_SHOWN)


@query("search_indexed", _sql_search("%tion the%", "", "tion the"))
def search_indexed(spark, folder):
    return _indexed(spark, folder, " tion the ")


@query("search_indexed_wildcard", _sql_search("%ing_th%the%", "AND stored_code = 'EW'", "ing_th%the"))
def search_indexed_wildcard(spark, folder):
    """The pieces between wildcards are looked up; the pattern decides."""
    return _indexed(spark, folder, "ING_th%the", country="EW")


@query("search_indexed_short", _sql_search("%th_re%", "", "th_re"))
def search_indexed_short(spark, folder):
    """No three fixed characters in a row: all clauses are looked at."""
    return _indexed(spark, folder, "th_re")
