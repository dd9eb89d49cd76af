"""Inputs derived from the given tables, once in Spark and once as SQL.

Versions hold fifty documents each, comparisons fifty pairs, so the work grows in
step with the tables.  ``SQL_*`` strings are lists of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogue.base import documents, sql_redline_counts, sql_token_count, table
from clauseloom.functions.vectors import unit
from clauseloom.session import cut

VERSION_SIZE = 50
EDITIONS = 3
COUNTRIES = ["EW", "SC", "FR", "IE", None, "NI", "BSI", "INT"]
DAY = 86400
EPOCH = 1704067200

# -- numbering ---------------------------------------------------------------


def clause_number(o: Column) -> Column:
    """A number for position ``o`` of fifty; plain numbers repeat after 24."""
    decade, last = F.floor(o / 10), o % 10
    return (F.when(last == 9, F.concat(F.lit("Table "), F.char(65 + decade), (o % 4 + 1)))
            .when(last == 8, F.concat(F.lit("Section "), decade + 1))
            .when(last == 7, F.concat(F.lit("B"), decade + 1))
            .otherwise(F.concat(o % 6 + 1, F.lit("."), o % 8 + 1)))


def sql_clause_number(o: str) -> str:
    return f"""CASE WHEN {o} % 10 = 9 THEN 'Table ' || chr(CAST(65 + {o} // 10 AS INTEGER)) || ({o} % 4 + 1)
      WHEN {o} % 10 = 8 THEN 'Section ' || ({o} // 10 + 1)
      WHEN {o} % 10 = 7 THEN 'B' || ({o} // 10 + 1)
      ELSE ({o} % 6 + 1) || '.' || ({o} % 8 + 1) END"""


# -- library -----------------------------------------------------------------


def _version() -> Column:
    return F.floor(F.col("doc_id") / VERSION_SIZE)


def library_clauses(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("doc_id") % VERSION_SIZE
    return documents(spark, folder, "doc_id", "text").select(
        F.col("doc_id").alias("id"), _version().alias("version_id"),
        clause_number(o).alias("clause_number"),
        F.when(o % 3 == 0, F.substring("text", 1, 12)).alias("title"),
        F.col("text").alias("content"),
        F.when(o % 7 > 0, F.concat(F.lit("Section "), F.floor(o / 10) + 1)).alias("section"),
        F.when(F.col("doc_id") % 9 > 0, F.lit(2)).alias("level"), o.cast("int").alias("ordinal"))


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        _version().alias("id")).distinct()


def library_versions(spark: SparkSession, folder: str) -> DataFrame:
    return _ids(spark, folder).select(
        "id", F.floor(F.col("id") / EDITIONS).alias("document_id"),
        F.concat(F.lit("Edition "), F.col("id") % EDITIONS + 1).alias("version_label"),
        F.concat(F.lit("v"), F.col("id"), F.lit(".pdf")).alias("source_file"),
        F.lit("generic").alias("parser_profile"), F.lit(0.5).alias("parser_confidence"),
        (F.col("id") % 40).cast("int").alias("page_count"),
        F.timestamp_seconds(EPOCH + F.col("id") * DAY).alias("uploaded_at"))


def library_documents(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.array(*[F.lit(c).cast("string") for c in COUNTRIES])
    return _ids(spark, folder).select(F.floor(F.col("id") / EDITIONS).alias("id")).distinct().select(
        "id", F.concat(F.lit("Instrument "), F.col("id")).alias("name"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("Guidance "), F.col("id"))).alias("description"),
        F.get(codes, (F.col("id") % len(COUNTRIES)).cast("int")).alias("country_code"),
        F.lit("Guide").alias("doc_type"), F.lit("Office").alias("publisher"),
        F.timestamp_seconds(EPOCH + F.col("id") * DAY).alias("created_at"))


_CODE_LIST = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in COUNTRIES) + "]"

SQL_LIBRARY = f"""
clauses AS (SELECT doc_id AS id, doc_id // {VERSION_SIZE} AS version_id,
    {sql_clause_number(f'(doc_id % {VERSION_SIZE})')} AS clause_number,
    CASE WHEN (doc_id % 50) % 3 = 0 THEN substr(text, 1, 12) END AS title, text AS content,
    CASE WHEN (doc_id % 50) % 7 > 0 THEN 'Section ' || ((doc_id % 50) // 10 + 1) END AS section,
    CASE WHEN doc_id % 9 > 0 THEN 2 END AS level, CAST(doc_id % 50 AS INTEGER) AS ordinal
  FROM documents),
versions AS (SELECT DISTINCT doc_id // 50 AS id, doc_id // 150 AS document_id,
    'Edition ' || ((doc_id // 50) % 3 + 1) AS version_label,
    'v' || (doc_id // 50) || '.pdf' AS source_file, 'generic' AS parser_profile,
    CAST(0.5 AS DOUBLE) AS parser_confidence, CAST((doc_id // 50) % 40 AS INTEGER) AS page_count,
    doc_id // 50 AS uploaded_day FROM documents),
instruments AS (SELECT DISTINCT doc_id // 150 AS id, 'Instrument ' || (doc_id // 150) AS name,
    CASE WHEN (doc_id // 150) % 2 = 0 THEN 'Guidance ' || (doc_id // 150) END AS description,
    {_CODE_LIST}[(doc_id // 150) % {len(COUNTRIES)} + 1] AS country_code, 'Guide' AS doc_type,
    'Office' AS publisher FROM documents)
"""

SQL_COUNTRY_NAME = """CASE WHEN country_code IS NULL THEN 'Unassigned' ELSE coalesce(
  map {'EW': 'England & Wales', 'SC': 'Scotland', 'NI': 'Northern Ireland',
       'IE': 'Republic of Ireland', 'BSI': 'British Standards',
       'INT': 'Other / International'}[country_code], country_code) END"""

# -- two editions of the same fifty documents --------------------------------

APPENDED = " Extra words are appended here, at the end."
LONG_TAIL = "\n" + " ".join(["These words were not there before."] * 8)


def _edited(text: Column, kind: Column) -> Column:
    shortened = F.regexp_replace(text, r"\n[^\n]*\z", "")
    return (F.when(kind.isin(1, 7), shortened)
            .when(kind == 2, F.concat(text, F.lit(APPENDED)))
            .when(kind == 6, F.concat(text, F.lit(LONG_TAIL))).otherwise(text))


def edition_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Both editions: some clauses shortened or extended, some removed, added, renumbered."""
    d, o = F.col("doc_id"), F.col("doc_id") % VERSION_SIZE
    kind = d % 10
    number = clause_number(o)
    base = documents(spark, folder, "doc_id", "text").select(
        _version().alias("comparison_id"), F.explode(F.array(
            F.struct(F.lit(1).alias("side"), number.alias("clause_number"),
                     F.col("text").alias("content"), (d % 5 != 4).alias("present")),
            F.struct(F.lit(2).alias("side"), F.when(kind == 7, F.concat(F.lit("9."), number)).otherwise(number)
                     .alias("clause_number"), _edited(F.col("text"), kind).alias("content"), (d % 5 != 3).alias("present"))
        )).alias("s"), o.cast("int").alias("ordinal"), d.alias("id"))
    return base.filter("s.present").select(
        "comparison_id", "s.side", "s.clause_number", "s.content", "ordinal", "id",
        F.when(F.col("ordinal") % 3 == 0, F.lit("Scope")).alias("title"),
        F.concat(F.lit("Section "), F.floor(F.col("ordinal") / 10) + 1).alias("section"),
        (F.col("comparison_id") * 2 + F.col("s.side")).alias("version_id"))


def positioned_sides(spark: SparkSession, folder: str) -> DataFrame:
    from clauseloom.operators.align import with_position

    # the numbering has written them: the alignment reads narrow columns, the rows both texts
    return with_position(edition_sides(spark, folder))


SQL_SIDES = f"""
drafts AS (SELECT doc_id, doc_id // 50 AS comparison_id, CAST(doc_id % 50 AS INTEGER) AS ordinal,
    text, {sql_clause_number('(doc_id % 50)')} AS number, doc_id % 10 AS kind FROM documents),
sides AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY comparison_id, side ORDER BY ordinal, id) - 1 AS idx,
    count(*) OVER (PARTITION BY comparison_id, side) AS version_size,
    CASE WHEN ordinal % 3 = 0 THEN 'Scope' END AS title,
    'Section ' || (ordinal // 10 + 1) AS section
  FROM (
    SELECT comparison_id, 1 AS side, number AS clause_number, text AS content, ordinal,
      doc_id AS id FROM drafts WHERE doc_id % 5 <> 4
    UNION ALL
    SELECT comparison_id, 2, CASE WHEN kind = 7 THEN '9.' || number ELSE number END,
      CASE WHEN kind IN (1, 7) THEN regexp_replace(text, '\\n[^\\n]*\\z', '')
        WHEN kind = 2 THEN text || '{APPENDED}' WHEN kind = 6 THEN text || '{LONG_TAIL}'
        ELSE text END, ordinal, doc_id FROM drafts WHERE doc_id % 5 <> 3))
"""

SQL_IDENTIFIER_PAIRS = """
ranked AS (SELECT comparison_id, side, clause_number, idx, row_number() OVER (
    PARTITION BY comparison_id, side, clause_number ORDER BY idx) AS k FROM sides),
pairs AS MATERIALIZED (SELECT coalesce(a.comparison_id, b.comparison_id) AS comparison_id,
    a.idx AS index_v1, b.idx AS index_v2
  FROM (SELECT * FROM ranked WHERE side = 1) a FULL OUTER JOIN
       (SELECT * FROM ranked WHERE side = 2) b
  ON a.comparison_id = b.comparison_id AND a.clause_number = b.clause_number AND a.k = b.k)
"""

SQL_ORDERED = """
sized AS (SELECT *, count(index_v1) OVER (PARTITION BY comparison_id) AS n1,
    count(index_v2) OVER (PARTITION BY comparison_id) AS n2 FROM pairs),
ordered AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY
    coalesce(CAST(index_v1 AS DOUBLE), index_v2 * CASE WHEN n2 > 1 THEN
      CAST(n1 - 1 AS DOUBLE) / greatest(1, n2 - 1) ELSE 1.0 END),
    index_v1 IS NULL, index_v2) - 1 AS row_index FROM sized)
"""

# Rows of the identifier comparison: one text is always a beginning of the other.
SQL_ROWS = f"""
joined AS (SELECT o.comparison_id, o.row_index, o.index_v1, o.index_v2,
    a.clause_number AS n1, b.clause_number AS n2, a.content AS c1, b.content AS c2,
    a.section AS s1, b.section AS s2, a.title AS t1, b.title AS t2
  FROM ordered o
  LEFT JOIN (SELECT * FROM sides WHERE side = 1) a
    ON a.comparison_id = o.comparison_id AND a.idx = o.index_v1
  LEFT JOIN (SELECT * FROM sides WHERE side = 2) b
    ON b.comparison_id = o.comparison_id AND b.idx = o.index_v2),
counted AS (SELECT *, {sql_token_count("coalesce(c1, '')")} AS w1,
    {sql_token_count("coalesce(c2, '')")} AS w2 FROM joined),
{sql_redline_counts("counted", "c1", "c2", "words").strip()},
"""

# -- numbered documents ------------------------------------------------------


def numbered_text(text: Column, doc_id: Column) -> Column:
    """Lines given section, table and paragraph numbers and list markers by position."""
    shift = F.when(doc_id % 3 == 0, 2).otherwise(0)

    def numbered(line: Column, i: Column) -> Column:
        p = i - shift
        # the grammars read two digits, so the count begins anew behind 99
        k, r = F.floor(p / 12) % 99 + 1, p % 12
        return (F.when(p < 0, line)
                .when(r == 0, F.concat(F.lit("Section "), k, F.lit(" "), line))
                .when(r == 5, F.concat(F.lit("Table "), k, F.lit(" "), line))
                .when(r.isin(1, 3, 7, 9), F.concat(k, F.lit("."), r, F.lit(" "), line))
                .when(r == 10, F.concat(F.lit("(a) "), line))
                .otherwise(line))

    return F.array_join(F.transform(F.split(text, "\n"), numbered), "\n")


def numbered_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", numbered_text(F.col("text"), F.col("doc_id")).alias("text"))


SQL_NUMBERED_LINES = """
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
placed AS (SELECT doc_id, i, line, i - CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS p
  FROM raw_lines),
numbered AS MATERIALIZED (SELECT doc_id, i AS pos, CASE
    WHEN p < 0 THEN line
    WHEN p % 12 = 0 THEN 'Section ' || (p // 12 % 99 + 1) || ' ' || line
    WHEN p % 12 = 5 THEN 'Table ' || (p // 12 % 99 + 1) || ' ' || line
    WHEN p % 12 IN (1, 3, 7, 9) THEN (p // 12 % 99 + 1) || '.' || (p % 12) || ' ' || line
    WHEN p % 12 = 10 THEN '(a) ' || line ELSE line END AS line FROM placed)
"""

# -- vectors -----------------------------------------------------------------

VECTOR_GROUP = 50


def vector_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty vectors to a comparison against mixtures of each with its successor.

    A mixture lies close to two of the originals, so the matching has to choose.
    """
    v = F.col("vec_id")
    own = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    following = own.select(F.when(v % VECTOR_GROUP == 0, v + VECTOR_GROUP - 1).otherwise(v - 1)
                           .alias("vec_id"), F.col("vector").alias("next"))
    mixed = F.zip_with("vector", F.coalesce("next", "vector"),
                       lambda a, b: a * F.lit(0.8) + b * F.lit(0.6))
    texts = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("content"))
    both = own.join(following, "vec_id", "left").join(texts, "vec_id", "left").select(
        F.floor(v / VECTOR_GROUP).alias("comparison_id"),
        (v % VECTOR_GROUP).cast("int").alias("idx"),
        F.coalesce("content", F.lit("")).alias("content"), F.explode(F.array(
            F.struct(F.lit(1).alias("side"), F.col("vector").alias("vector")),
            F.struct(F.lit(2).alias("side"), unit(mixed).alias("vector")))).alias("s"))
    # read several times by the alignment
    return cut(both.select("comparison_id", "s.side", "idx", "content", "s.vector",
                           F.lit(VECTOR_GROUP).alias("version_size")))


SQL_VECTORS = f"""
own AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
mixed AS (SELECT a.vec_id, a.vector, list_transform(list_zip(a.vector, coalesce(b.vector, a.vector)),
    lambda p: p[1] * CAST(0.8 AS DOUBLE) + p[2] * CAST(0.6 AS DOUBLE)) AS m
  FROM own a LEFT JOIN own b ON b.vec_id = CASE WHEN a.vec_id % {VECTOR_GROUP} = {VECTOR_GROUP} - 1
    THEN a.vec_id - {VECTOR_GROUP} + 1 ELSE a.vec_id + 1 END),
vectors AS MATERIALIZED (SELECT vec_id // {VECTOR_GROUP} AS comparison_id, side,
    CAST(vec_id % {VECTOR_GROUP} AS INTEGER) AS idx, v AS vector, coalesce(text, '') AS content
  FROM (SELECT vec_id, 1 AS side, vector AS v FROM mixed UNION ALL
    SELECT vec_id, 2, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) FROM mixed)
  LEFT JOIN documents ON doc_id = vec_id),
cosines AS (SELECT a.comparison_id, a.idx AS index_v1, b.idx AS index_v2,
    round(list_inner_product(a.vector, b.vector), 9) AS cosine
  FROM vectors a JOIN vectors b ON a.comparison_id = b.comparison_id AND a.side = 1 AND b.side = 2),
nearest AS MATERIALIZED (SELECT comparison_id, index_v1, index_v2, cosine FROM (SELECT *, row_number() OVER (
    PARTITION BY comparison_id, index_v1 ORDER BY cosine DESC, index_v2) AS rank FROM cosines)
  WHERE rank <= 12)
"""
