"""Alignment, redline, classification and reports."""

from pyspark.sql import functions as F

from catalogue.base import (
    documents, query, scratch, sql_escape, sql_jaccard, sql_redline_counts, sql_token_count,
    sql_token_set, table,
)
from catalogue.fixtures import (
    SQL_IDENTIFIER_PAIRS, SQL_LIBRARY, SQL_ORDERED, SQL_ROWS, SQL_SIDES, SQL_VECTORS,
    edition_sides, library_clauses, library_versions, positioned_sides, vector_sides,
)
from clauseloom import fixed
from clauseloom.functions import markup
from clauseloom.functions import text as tx
from clauseloom.operators import align, redline, report, shortlist
from clauseloom.operators.embed import letter_profile
from clauseloom.plans import compare
from clauseloom.plans.evolution import consecutive
from clauseloom.sources.library import write_csv

# -- alignment ---------------------------------------------------------------

SQL_OVERLAP = """
overlap AS (SELECT comparison_id, CASE WHEN least(a, b) = 0 THEN 0.0 ELSE
    CAST(both_sides AS DOUBLE) / least(a, b) END AS identifier_overlap
  FROM (SELECT comparison_id, count(*) FILTER (WHERE l) AS a, count(*) FILTER (WHERE r) AS b,
      count(*) FILTER (WHERE l AND r) AS both_sides
    FROM (SELECT comparison_id, clause_number, bool_or(side = 1) AS l, bool_or(side = 2) AS r
      FROM sides GROUP BY ALL) GROUP BY comparison_id))
"""


@query("identifier_overlap", f"""WITH {SQL_SIDES}, {SQL_OVERLAP}
SELECT comparison_id, round(identifier_overlap, 9) AS identifier_overlap FROM overlap""")
def identifier_overlap(spark, folder):
    return align.identifier_overlap(edition_sides(spark, folder)).withColumn(
        "identifier_overlap", F.round("identifier_overlap", 9))


def _comparisons(spark, folder):
    ids = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.floor(F.col("doc_id") / 50).alias("comparison_id")).distinct()
    c = F.col("comparison_id")
    return ids.select("comparison_id", F.lit("EW").alias("country_v1"),
                      F.when(c % 3 == 2, "SC").otherwise("EW").alias("country_v2"),
                      F.when(c % 5 == 4, "semantic").otherwise("auto").alias("strategy"))


@query("choose_strategy", f"""WITH {SQL_SIDES}, {SQL_OVERLAP}
SELECT comparison_id, CASE WHEN comparison_id % 5 = 4 THEN 'semantic'
  WHEN comparison_id % 3 <> 2 AND identifier_overlap >= 0.35 THEN 'identifier' ELSE 'semantic' END AS method
FROM overlap""")
def choose_strategy(spark, folder):
    return compare.with_strategy(_comparisons(spark, folder), edition_sides(spark, folder)).select(
        "comparison_id", "method")


@query("comparison_sides", f"""WITH {SQL_LIBRARY},
later AS (SELECT id AS comparison_id, id AS version_v1, lead(id) OVER (PARTITION BY document_id
    ORDER BY uploaded_day, id) AS version_v2 FROM versions),
wanted AS (SELECT comparison_id, 1 AS side, version_v1 AS version_id FROM later WHERE version_v2 IS NOT NULL
  UNION ALL SELECT comparison_id, 2, version_v2 FROM later WHERE version_v2 IS NOT NULL)
SELECT comparison_id, side, id, CAST(row_number() OVER (PARTITION BY comparison_id, side
  ORDER BY ordinal, id) - 1 AS INTEGER) AS idx FROM wanted JOIN clauses USING (version_id)""")
def comparison_sides(spark, folder):
    """Neighbouring editions of every document, with clause positions."""
    pairs = consecutive(library_versions(spark, folder))
    return align.comparison_sides(pairs, library_clauses(spark, folder)).select(
        "comparison_id", "side", "id", "idx")


@query("comparison_rejects", f"""WITH {SQL_LIBRARY},
asked AS (SELECT id AS comparison_id, id AS version_v1, CASE WHEN id % 4 = 0 THEN id
    WHEN id % 4 = 1 THEN id + 1000000 ELSE id + 1 - 2 * (id % 2) END AS version_v2 FROM versions),
known AS (SELECT DISTINCT version_id FROM clauses)
SELECT comparison_id, CASE WHEN version_v1 = version_v2 THEN 'same version'
  WHEN version_v2 NOT IN (SELECT version_id FROM known) THEN 'no stored clauses' END AS reason
FROM asked WHERE version_v1 = version_v2 OR version_v2 NOT IN (SELECT version_id FROM known)""")
def comparison_rejects(spark, folder):
    v = F.col("id")
    asked = library_versions(spark, folder).select(
        v.alias("comparison_id"), v.alias("version_v1"),
        F.when(v % 4 == 0, v).when(v % 4 == 1, v + 1000000).otherwise(v + 1 - 2 * (v % 2))
        .alias("version_v2"))
    _, rejected = compare.split_rejects(asked, library_clauses(spark, folder))
    return rejected.select("comparison_id", "reason")


@query("align_by_identifier", f"""WITH {SQL_SIDES}, {SQL_IDENTIFIER_PAIRS}
SELECT comparison_id, CAST(index_v1 AS INTEGER) AS index_v1, CAST(index_v2 AS INTEGER) AS index_v2 FROM pairs""")
def align_by_identifier(spark, folder):
    return align.align_by_identifier(positioned_sides(spark, folder)).select(
        "comparison_id", "index_v1", "index_v2")


@query("reading_order", f"""WITH {SQL_SIDES}, {SQL_IDENTIFIER_PAIRS}, {SQL_ORDERED}
SELECT comparison_id, row_index, CAST(index_v1 AS INTEGER) AS index_v1, CAST(index_v2 AS INTEGER) AS index_v2 FROM ordered""")
def reading_order(spark, folder):
    return align.reading_order(align.align_by_identifier(positioned_sides(spark, folder))).select(
        "comparison_id", "row_index", "index_v1", "index_v2")


@query("nearest_clauses", f"""WITH {SQL_VECTORS}
SELECT comparison_id, index_v1, index_v2, cosine FROM nearest""")
def nearest_clauses(spark, folder):
    """Exact top twelve, cut into blocks of twenty so that several block pairs meet."""
    return align.nearest(vector_sides(spark, folder), block=20)


SQL_PIVOTS = """
lettered AS (SELECT doc_id, list_transform(range(0, 26), lambda i: CAST(length(t)
    - length(replace(t, chr(97 + CAST(i AS INTEGER)), '')) AS DOUBLE)) AS c
  FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
lengths AS (SELECT doc_id, c, sqrt(list_inner_product(c, c)) AS norm FROM lettered),
texts AS MATERIALIZED (SELECT doc_id % 2 AS side, CAST(doc_id // 2 AS INTEGER) AS idx,
    CASE WHEN norm = 0 THEN c ELSE list_transform(c, lambda x: x / norm) END AS vector FROM lengths),
lefts AS MATERIALIZED (SELECT * FROM texts WHERE side = 0),
rights AS MATERIALIZED (SELECT * FROM texts WHERE side = 1),
size AS (SELECT count(*) AS n, greatest(1, floor(sqrt(count(*) / CAST(32 AS DOUBLE)))) AS step FROM rights),
pivots AS MATERIALIZED (SELECT idx AS home, vector FROM rights, size WHERE idx % step = 0),
left_homes AS MATERIALIZED (SELECT idx, home FROM (SELECT a.idx, p.home, row_number() OVER (PARTITION BY a.idx
    ORDER BY round(list_inner_product(a.vector, p.vector), 9) DESC, p.home) AS r FROM lefts a, pivots p) WHERE r <= 32),
right_homes AS MATERIALIZED (SELECT idx, home FROM (SELECT a.idx, p.home, row_number() OVER (PARTITION BY a.idx
    ORDER BY round(list_inner_product(a.vector, p.vector), 9) DESC, p.home) AS r FROM rights a, pivots p) WHERE r = 1),
cosines AS MATERIALIZED (SELECT a.idx AS index_v1, b.idx AS index_v2,
    round(list_inner_product(a.vector, b.vector), 9) AS cosine FROM lefts a, rights b),
met AS MATERIALIZED (SELECT c.* FROM cosines c JOIN left_homes l ON l.idx = c.index_v1
  JOIN right_homes r ON r.idx = c.index_v2 AND r.home = l.home),
few AS (SELECT l.idx FROM lefts l LEFT JOIN met m ON m.index_v1 = l.idx, size GROUP BY l.idx, n
  HAVING count(m.index_v1) < least(12, n)),
taken AS (SELECT * FROM met WHERE index_v1 NOT IN (SELECT idx FROM few)
  UNION ALL SELECT * FROM cosines WHERE index_v1 IN (SELECT idx FROM few)),
by_pivots AS (SELECT index_v1, index_v2, cosine FROM (SELECT *, row_number() OVER (
    PARTITION BY index_v1 ORDER BY cosine DESC, index_v2) AS r FROM taken) WHERE r <= 12)
"""


def text_sides(spark, folder):
    """One large comparison: the texts of even ids against those of odd ids."""
    d = F.col("doc_id")
    return documents(spark, folder, "doc_id", "text").select(
        F.lit(0).cast("long").alias("comparison_id"), (d % 2 + 1).cast("int").alias("side"),
        F.floor(d / 2).cast("int").alias("idx"), letter_profile(F.coalesce("text", F.lit(""))).alias("vector"))


@query("nearest_by_pivots", f"""WITH {SQL_PIVOTS}
SELECT CAST(0 AS BIGINT) AS comparison_id, index_v1, index_v2, cosine FROM by_pivots""")
def nearest_by_pivots(spark, folder):
    """The approximate shortlist over whole documents, by the same pivots in SQL."""
    return shortlist.nearest_by_pivots(text_sides(spark, folder))


SQL_CANDIDATES = f"""
{SQL_VECTORS},
sized_vectors AS (SELECT *, 50 AS version_size, {sql_token_set('content')} AS terms FROM vectors),
scored AS MATERIALIZED (SELECT n.comparison_id, n.index_v1, n.index_v2, n.cosine,
    {sql_jaccard('a.terms', 'b.terms')} AS lexical,
    1.0 - abs(CAST(n.index_v1 AS DOUBLE) / 49 - CAST(n.index_v2 AS DOUBLE) / 49) AS "positional"
  FROM nearest n JOIN sized_vectors a ON a.comparison_id = n.comparison_id AND a.side = 1 AND a.idx = n.index_v1
  JOIN sized_vectors b ON b.comparison_id = n.comparison_id AND b.side = 2 AND b.idx = n.index_v2),
candidates AS MATERIALIZED (SELECT *, CAST(0.72 AS DOUBLE) * cosine + CAST(0.18 AS DOUBLE) * lexical
    + CAST(0.10 AS DOUBLE) * "positional" AS score FROM scored
  WHERE CAST(0.72 AS DOUBLE) * cosine + CAST(0.18 AS DOUBLE) * lexical + CAST(0.10 AS DOUBLE) * "positional" >= 0.42)
"""


@query("score_candidates", f"""WITH {SQL_CANDIDATES}
SELECT comparison_id, index_v1, index_v2, cosine, round(lexical, 9) AS lexical,
  round("positional", 9) AS "positional", round(score, 9) AS score FROM candidates""")
def score_candidates(spark, folder):
    found = align.candidates(vector_sides(spark, folder))
    return found.select("comparison_id", "index_v1", "index_v2", "cosine",
                        *[F.round(c, 9).alias(c) for c in ("lexical", "positional", "score")])


SQL_GREEDY = f"""
{SQL_CANDIDATES},
queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY comparison_id
    ORDER BY score DESC, index_v1, index_v2) AS r FROM candidates),
steps AS (
  SELECT comparison_id, CAST(0 AS BIGINT) AS r, CAST([] AS INTEGER[]) AS used1, CAST([] AS INTEGER[]) AS used2,
    CAST(NULL AS INTEGER) AS index_v1, CAST(NULL AS INTEGER) AS index_v2, false AS taken,
    CAST(0 AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS cosine
  FROM (SELECT DISTINCT comparison_id FROM candidates)
  UNION ALL
  SELECT s.comparison_id, q.r,
    CASE WHEN list_contains(s.used1, q.index_v1) OR list_contains(s.used2, q.index_v2) THEN s.used1
      ELSE list_append(s.used1, q.index_v1) END,
    CASE WHEN list_contains(s.used1, q.index_v1) OR list_contains(s.used2, q.index_v2) THEN s.used2
      ELSE list_append(s.used2, q.index_v2) END,
    q.index_v1, q.index_v2,
    NOT (list_contains(s.used1, q.index_v1) OR list_contains(s.used2, q.index_v2)), q.score, q.cosine
  FROM steps s JOIN queue q ON q.comparison_id = s.comparison_id AND q.r = s.r + 1),
matched AS MATERIALIZED (SELECT comparison_id, index_v1, index_v2, round(score, 4) AS match_score,
    round(cosine, 4) AS embedding_score FROM steps WHERE taken)
"""

SQL_SEMANTIC_PAIRS = f"""
{SQL_GREEDY},
semantic_pairs AS MATERIALIZED (SELECT * FROM matched
  UNION ALL SELECT comparison_id, idx, NULL, NULL, NULL FROM vectors v WHERE side = 1 AND NOT EXISTS (
    SELECT 1 FROM matched m WHERE m.comparison_id = v.comparison_id AND m.index_v1 = v.idx)
  UNION ALL SELECT comparison_id, NULL, idx, NULL, NULL FROM vectors v WHERE side = 2 AND NOT EXISTS (
    SELECT 1 FROM matched m WHERE m.comparison_id = v.comparison_id AND m.index_v2 = v.idx))
"""


@query("match_one_to_one", f"""WITH RECURSIVE {SQL_GREEDY}
SELECT comparison_id, index_v1, index_v2 FROM matched""")
def match_one_to_one(spark, folder):
    """Best-first matching of bounded comparisons, one shuffle."""
    return align.one_to_one(align.candidates(vector_sides(spark, folder))).select(
        "comparison_id", "index_v1", "index_v2")


@query("match_in_rounds", f"""WITH RECURSIVE {SQL_GREEDY}
SELECT comparison_id, index_v1, index_v2 FROM matched""")
def match_in_rounds(spark, folder):
    """The same matching as distributed rounds, as used for oversized comparisons."""
    return align.one_to_one(align.candidates(vector_sides(spark, folder)), group_limit=0).select(
        "comparison_id", "index_v1", "index_v2")


@query("align_semantic", f"""WITH RECURSIVE {SQL_SEMANTIC_PAIRS}
SELECT comparison_id, index_v1, index_v2, match_score, embedding_score FROM semantic_pairs""")
def align_semantic(spark, folder):
    return align.align_semantic(vector_sides(spark, folder)).drop("method")


# -- redline -----------------------------------------------------------------

@query("redline_edits", f"""
WITH t AS (SELECT doc_id, {sql_token_count("coalesce(text, '')")} AS words_v1,
    CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '[a-z]+'))) AS BIGINT) AS n FROM documents),
gone AS (SELECT *, CAST(len(list_filter(range(n), lambda i: i % 11 = 5)) AS BIGINT) AS dropped,
    CAST(len(list_filter(range(n), lambda i: i % 11 <> 5 AND i % 7 = 3)) AS BIGINT) AS swapped FROM t)
SELECT doc_id, words_v1, true AS words_v2_agree, true AS left_rebuilds, true AS right_rebuilds,
  dropped + swapped AS inner_removed, swapped AS inner_added, n - dropped - swapped AS inner_kept FROM gone""")
def redline_edits(spark, folder):
    """Real edits inside the text: words replaced, sentences dropped and swapped.

    Whatever a matcher pairs, both sides must add up and rebuild their texts.  The inner
    counts are of the text's different words with every seventh replaced and every
    eleventh dropped, where each matcher must agree.
    """
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    edited = (F.when(d % 4 == 0, F.replace(F.replace(text, F.lit("and"), F.lit("or")), F.lit("the"), F.lit("this")))
              .when(d % 4 == 1, F.coalesce(tx.without_last_sentence(text), text))
              .when(d % 4 == 2, F.coalesce(tx.ends_swapped(text), text)).otherwise(text))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1)))
    swapped = F.filter(F.transform("words", lambda w, i: F.when(i % 11 == 5, F.lit(None)).when(
        i % 7 == 3, F.concat(F.lit("q"), i.cast("string"), F.lit("q"))).otherwise(w)), lambda w: w.isNotNull())
    pairs = documents(spark, folder, "doc_id", "text").select(
        "doc_id", text.alias("text"), edited.alias("edited"), words.alias("words")).withColumns({
            "inner_v1": F.array_join("words", " "), "inner_v2": F.array_join(swapped, " ")}).drop("words")
    marked = redline.with_redline(pairs, "text", "edited", by=["doc_id"])
    marked = redline.with_redline(marked, "inner_v1", "inner_v2", out="inner", by=["doc_id"])
    bare = lambda html: F.regexp_replace(html, "</?(?:del|ins)[^>]*>", "")
    r = lambda part: F.col(f"redline.words_{part}")
    return marked.select(
        "doc_id", (r("removed") + r("unchanged")).alias("words_v1"),
        (r("added") + r("unchanged") == tx.token_count(F.col("edited"))).alias("words_v2_agree"),
        (bare(F.col("redline.html_v1")) == markup.escape(F.col("text"))).alias("left_rebuilds"),
        (bare(F.col("redline.html_v2")) == markup.escape(F.col("edited"))).alias("right_rebuilds"),
        F.col("inner.words_removed").alias("inner_removed"), F.col("inner.words_added").alias("inner_added"),
        F.col("inner.words_unchanged").alias("inner_kept"))


SQL_MARKED = f"""
sided AS (SELECT comparison_id, id, max(CASE WHEN side = 1 THEN content END) AS a,
    max(CASE WHEN side = 2 THEN content END) AS b FROM sides GROUP BY ALL),
tallied AS (SELECT *, {sql_token_count("coalesce(a, '')")} AS w1, {sql_token_count("coalesce(b, '')")} AS w2,
    a IS NOT NULL AND b IS NOT NULL AS both_sides FROM sided),
{sql_redline_counts("tallied", "a", "b", "redlined").strip()}
"""


def _edition_pairs(spark, folder):
    """Both texts of a clause by its document, not by its number."""
    return edition_sides(spark, folder).groupBy("comparison_id", "id").agg(
        F.max(F.when(F.col("side") == 1, F.col("content"))).alias("content_v1"),
        F.max(F.when(F.col("side") == 2, F.col("content"))).alias("content_v2"))


@query("redline_words", f"""WITH {SQL_SIDES}, {SQL_MARKED}
SELECT id, words_removed, words_added, words_unchanged, CASE WHEN w1 + w2 = 0 THEN 0.0 ELSE
  round(CAST(words_removed + words_added AS DOUBLE) / (words_removed + words_added + words_unchanged), 4) END
  AS word_change_ratio FROM redlined""")
def redline_words(spark, folder):
    marked = redline.with_redline(_edition_pairs(spark, folder))
    return marked.select("id", redline.public_redline().alias("r")).select(
        "id", "r.words_removed", "r.words_added", "r.words_unchanged", "r.word_change_ratio")


@query("redline_one_sided", f"""WITH {SQL_SIDES}, {SQL_MARKED}
SELECT id, CASE WHEN a IS NULL THEN '' WHEN b IS NULL THEN '<del class="rl-del">' || {sql_escape('a')} || '</del>'
    ELSE {sql_escape('a')} END AS html_v1,
  CASE WHEN b IS NULL THEN '' WHEN a IS NULL THEN '<ins class="rl-ins">' || {sql_escape('b')} || '</ins>'
    ELSE {sql_escape('b')} END AS html_v2
FROM redlined WHERE NOT both_sides OR a = b""")
def redline_one_sided(spark, folder):
    """Missing and equal sides, rendered without leaving the JVM."""
    pairs = _edition_pairs(spark, folder).filter(
        "content_v1 IS NULL OR content_v2 IS NULL OR content_v1 = content_v2")
    return redline.with_redline(pairs).select("id", "redline.html_v1", "redline.html_v2")


@query("redline_escape", f"""
SELECT page_id, '<ins class="rl-ins">' || {sql_escape('html')} || '</ins>' AS html FROM pages""")
def redline_escape(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", markup.inserted(F.col("html")).alias("html"))


@query("sanitise_markup", """
SELECT page_id, replace(replace(regexp_replace(replace(replace(html, '<p>', '@1'), '</p>', '@2'), '<[^>]*>?', '', 'g'),
  '@1', '<ins class="rl-ins">'), '@2', '</ins>') AS html FROM pages""")
def sanitise_markup(spark, folder):
    """Pages whose paragraphs are turned into insertions, all other tags removed."""
    html = F.replace(F.replace(F.col("html"), F.lit("<p>"), F.lit(fixed.INS_OPEN)),
                     F.lit("</p>"), F.lit(fixed.INS_CLOSE))
    return table(spark, folder, "pages").select(
        "page_id", markup.sanitise(html).alias("html"))


@query("highlight_hits", f"""
SELECT doc_id, '<del class="rl-del">' || regexp_replace({sql_escape('text')}, '(?i)the', '<mark class="hit">\\0</mark>', 'g')
  || '</del>' AS html FROM documents""")
def highlight_hits(spark, folder):
    marked = markup.deleted(F.col("text"))
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", markup.highlight(marked, "THE").alias("html"))


# -- classification ----------------------------------------------------------

SQL_TYPE = """CASE WHEN ratio >= 0.35 OR touched >= 200 THEN 'Significant Change'
  WHEN similarity >= 0.95 AND (ratio > 0.05 OR touched > 20) THEN 'Minor Edit'
  WHEN similarity >= 0.95 THEN 'Unchanged' WHEN similarity >= 0.80 THEN 'Minor Edit'
  ELSE 'Significant Change' END"""


@query("classify_rows", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, CAST(1.0 AS DOUBLE) - CAST(l_discount AS DOUBLE) * 3 AS similarity,
  CAST(CAST(l_quantity AS BIGINT) * CASE WHEN l_partkey % 10 = 0 THEN 5 ELSE 1 END AS BIGINT) AS touched,
  CAST(l_suppkey % 90 * 10 AS BIGINT) AS kept FROM lineitem),
r AS (SELECT *, CASE WHEN touched + kept = 0 THEN 0.0 ELSE CAST(touched AS DOUBLE) / (touched + kept) END AS ratio FROM v)
SELECT l_orderkey, l_linenumber, {SQL_TYPE} AS change_type,
  CASE WHEN similarity >= 0.95 THEN 'Unchanged' WHEN similarity >= 0.80 THEN 'Minor Edit'
    ELSE 'Significant Change' END AS by_similarity FROM r""")
def classify_rows(spark, folder):
    """The classification over a grid of similarities, ratios and word counts."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.lit(1.0) - F.col("l_discount").cast("double") * 3).alias("similarity"),
        (F.col("l_quantity").cast("long") * F.when(F.col("l_partkey") % 10 == 0, 5).otherwise(1))
        .alias("touched"), (F.col("l_suppkey") % 90 * 10).cast("long").alias("kept"))
    none = F.lit(0).cast("long")
    ratio = redline.change_ratio(F.col("touched"), none, F.col("kept"))
    return items.select("l_orderkey", "l_linenumber", report.classify(
        F.col("similarity"), ratio, F.col("touched")).alias("change_type"),
        report.classify_similarity(F.col("similarity")).alias("by_similarity"))


# -- reports -----------------------------------------------------------------

SQL_REPORT = f"""
{SQL_SIDES}, {SQL_IDENTIFIER_PAIRS}, {SQL_ORDERED}, {SQL_ROWS}
measured AS (SELECT *, words_removed + words_added AS touched,
    CASE WHEN words_removed + words_added + words_unchanged = 0 THEN 0.0 ELSE
      CAST(words_removed + words_added AS DOUBLE) / (words_removed + words_added + words_unchanged) END AS ratio,
    {sql_token_set("coalesce(c1, '')")} AS set1, {sql_token_set("coalesce(c2, '')")} AS set2 FROM words),
alike AS (SELECT *, CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN {sql_jaccard('set1', 'set2')} END AS similarity
  FROM measured),
rows AS MATERIALIZED (SELECT *, CASE WHEN c2 IS NULL THEN 'Removed' WHEN c1 IS NULL THEN 'Added'
    ELSE {SQL_TYPE} END AS change_type,
    CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL AND n1 <> n2 THEN n1 || ' → ' || n2 ELSE coalesce(n1, n2, '—') END AS label
  FROM alike)
"""


def aligned_report(spark, folder):
    """Report rows of all editions, numbers paired, vocabulary as similarity."""
    return compare.identifier_rows(positioned_sides(spark, folder))


@query("compare_rows", f"""WITH {SQL_REPORT}
SELECT comparison_id, row_index, label, change_type, round(similarity, 4) AS similarity_score,
  words_removed, words_added, words_unchanged, round(ratio, 4) AS word_change_ratio FROM rows""")
def compare_rows(spark, folder):
    return aligned_report(spark, folder).select(
        "comparison_id", "row_index", "label", "change_type", "similarity_score",
        "redline.words_removed", "redline.words_added", "redline.words_unchanged",
        "redline.word_change_ratio")


SQL_SUMMARY = f"""
{SQL_REPORT},
summary AS (SELECT comparison_id, count(*) AS total_clauses,
    count(*) FILTER (WHERE change_type = 'Unchanged') AS unchanged,
    count(*) FILTER (WHERE change_type = 'Minor Edit') AS minor_edits,
    count(*) FILTER (WHERE change_type = 'Significant Change') AS significant_changes,
    count(*) FILTER (WHERE change_type = 'Added') AS added,
    count(*) FILTER (WHERE change_type = 'Removed') AS removed,
    CAST(sum(words_added) AS BIGINT) AS words_added, CAST(sum(words_removed) AS BIGINT) AS words_removed,
    count(*) FILTER (WHERE change_type <> 'Unchanged') AS changed,
    round(CAST(count(*) FILTER (WHERE change_type <> 'Unchanged') AS DOUBLE) / count(*) * 100, 2) AS change_rate
  FROM rows GROUP BY comparison_id)
"""


@query("compare_summary", f"WITH {SQL_SUMMARY} SELECT * FROM summary")
def compare_summary(spark, folder):
    """Flagship: two editions aligned, redlined, classified and summed up."""
    return report.summarise(aligned_report(spark, folder))


@query("report_tallies", f"""WITH {SQL_SUMMARY},
placed AS (SELECT *, 'EW' AS c1, CASE WHEN comparison_id % 3 = 2 THEN 'SC' ELSE 'EW' END AS c2 FROM summary),
long AS (
  SELECT comparison_id, 0 AS position, 'aligned' AS tally, 'Aligned' AS label, unchanged + minor_edits + significant_changes AS value FROM placed WHERE c1 <> c2
  UNION ALL SELECT comparison_id, 1, 'close', 'Close wording', minor_edits FROM placed WHERE c1 <> c2
  UNION ALL SELECT comparison_id, 2, 'diverging', 'Diverging', significant_changes FROM placed WHERE c1 <> c2
  UNION ALL SELECT comparison_id, 3, 'only2', 'Only in ' || c2, added FROM placed WHERE c1 <> c2
  UNION ALL SELECT comparison_id, 4, 'only1', 'Only in ' || c1, removed FROM placed WHERE c1 <> c2
  UNION ALL SELECT comparison_id, 0, 'total', 'Clauses', total_clauses FROM placed WHERE c1 = c2
  UNION ALL SELECT comparison_id, 1, 'unchanged', 'Unchanged', unchanged FROM placed WHERE c1 = c2
  UNION ALL SELECT comparison_id, 2, 'minor', 'Minor edit', minor_edits FROM placed WHERE c1 = c2
  UNION ALL SELECT comparison_id, 3, 'significant', 'Significant', significant_changes FROM placed WHERE c1 = c2
  UNION ALL SELECT comparison_id, 4, 'added', 'Added', added FROM placed WHERE c1 = c2
  UNION ALL SELECT comparison_id, 5, 'removed', 'Removed', removed FROM placed WHERE c1 = c2)
SELECT comparison_id, position, tally, label, value FROM long""")
def report_tallies(spark, folder):
    countries = _comparisons(spark, folder).select("comparison_id", "country_v1", "country_v2")
    return report.tallies(compare_summary(spark, folder).join(countries, "comparison_id"))


@query("report_chips", f"""WITH {SQL_REPORT}
SELECT comparison_id, row_index, CASE WHEN comparison_id % 3 <> 2 THEN change_type
  WHEN change_type = 'Added' THEN 'only in SC' WHEN change_type = 'Removed' THEN 'only in EW'
  WHEN change_type IN ('Unchanged', 'Minor Edit') THEN 'close wording' ELSE 'diverging' END AS chip,
  CASE change_type WHEN 'Significant Change' THEN 0 WHEN 'Added' THEN 1 WHEN 'Removed' THEN 2
    WHEN 'Minor Edit' THEN 3 ELSE 4 END AS severity FROM rows""")
def report_chips(spark, folder):
    rows = aligned_report(spark, folder).join(_comparisons(spark, folder), "comparison_id")
    return rows.select("comparison_id", "row_index", report.chip(
        F.col("change_type"), F.col("country_v1"), F.col("country_v2")).alias("chip"),
        report.severity(F.col("change_type")).alias("severity"))


@query("change_spine", f"""WITH {SQL_REPORT},
stretched AS (SELECT comparison_id, row_index // greatest(1, CAST(ceil(count(*) OVER (PARTITION BY comparison_id) / 7.0) AS BIGINT)) AS stretch,
    row_index, change_type, CASE change_type WHEN 'Significant Change' THEN 0 WHEN 'Added' THEN 1
      WHEN 'Removed' THEN 2 WHEN 'Minor Edit' THEN 3 ELSE 4 END AS severity FROM rows)
SELECT comparison_id, min(row_index) AS start, count(*) AS clauses, arg_min(change_type, severity) AS change_type
FROM stretched GROUP BY comparison_id, stretch""")
def change_spine(spark, folder):
    """The change map, cut to seven segments so that rows share one."""
    return report.change_spine(aligned_report(spark, folder), segments=7)


@query("filter_report", f"""WITH {SQL_REPORT}
SELECT comparison_id, row_index, label FROM rows WHERE change_type NOT IN ('Unchanged', 'Added') AND (
  contains(lower(coalesce(c1, '')), 'scope') OR contains(lower(coalesce(c2, '')), 'scope')
  OR contains(lower(coalesce(t1, '')), 'scope') OR contains(lower(coalesce(t2, '')), 'scope')
  OR contains(lower(coalesce(s1, '')), 'scope') OR contains(lower(coalesce(s2, '')), 'scope')
  OR contains(lower(label), 'scope'))""")
def filter_report(spark, folder):
    return report.filter_rows(aligned_report(spark, folder), " Scope ",
                              ("Unchanged", "Added")).select("comparison_id", "row_index", "label")


SQL_EXPORT = f"""WITH {SQL_REPORT}
SELECT change_type AS "Change Type", coalesce(n1, '') AS "Old Clause",
  CASE WHEN c1 IS NULL THEN '' ELSE coalesce(s1, '') END AS "Old Section",
  coalesce(c1, '(not present)') AS "Old Text", coalesce(n2, '') AS "New Clause",
  CASE WHEN c2 IS NULL THEN '' ELSE coalesce(s2, '') END AS "New Section",
  coalesce(c2, '(not present)') AS "New Text",
  CASE WHEN similarity IS NULL THEN 'N/A' ELSE format('{{:.4f}}', round(similarity, 4)) END AS "Similarity",
  'N/A' AS "Match Confidence", words_added AS "Words Added", words_removed AS "Words Removed" FROM rows"""


@query("export_report", SQL_EXPORT)
def export_report(spark, folder):
    return report.export_rows(aligned_report(spark, folder), "Old", "New")


@query("export_csv", SQL_EXPORT)
def export_csv(spark, folder):
    """The same rows written as CSV and read back."""
    rows, path = export_report(spark, folder), scratch(spark, "export")
    write_csv(rows, path)
    return spark.read.schema(rows.schema).options(
        header=True, multiLine=True, escape='"', nullValue="\x00").csv(path)


# -- semantic comparison -----------------------------------------------------

@query("compare_by_meaning", f"""WITH RECURSIVE {SQL_SEMANTIC_PAIRS},
pairs AS (SELECT * FROM semantic_pairs), {SQL_ORDERED}
SELECT comparison_id, row_index, CAST(index_v1 AS INTEGER) AS index_v1, CAST(index_v2 AS INTEGER) AS index_v2,
  match_score, embedding_score AS similarity_score FROM ordered""")
def compare_by_meaning(spark, folder):
    """Semantic alignment in reading order, similarity reused from the alignment."""
    pairs = align.reading_order(align.align_semantic(vector_sides(spark, folder)))
    return pairs.select("comparison_id", "row_index", "index_v1", "index_v2", "match_score",
                        F.col("embedding_score").alias("similarity_score"))


@query("compare_mixed")
def compare_mixed(spark, folder):
    """Every comparison by the method chosen for it, with the letter encoder."""
    from clauseloom.operators.embed import letter_profile

    sides = edition_sides(spark, folder)
    asked = _comparisons(spark, folder).withColumn(
        "version_v1", F.col("comparison_id") * 2 + 1).withColumn(
        "version_v2", F.col("comparison_id") * 2 + 2)
    rows = compare.compare(asked, sides.drop("comparison_id", "side"), letter_profile)
    return rows.groupBy("comparison_id", "match_method", "change_type").agg(
        F.count("*").alias("clauses"))


@query("compare_frame_encoder", f"""WITH {SQL_REPORT}, t AS (SELECT comparison_id, row_index, label,
    words_removed, words_added, words_unchanged, c1 IS NOT NULL AND c2 IS NOT NULL AS paired FROM rows)
SELECT comparison_id, row_index, label, words_removed, words_added, words_unchanged, paired,
  true AS same_similarity, true AS same_type FROM t""")
def compare_frame_encoder(spark, folder):
    """Numbers aligned, similarity by an encoder of chunk rows, held against the same encoder in the row."""
    from clauseloom.operators.embed import letter_profile

    sides = positioned_sides(spark, folder)
    keys = ["comparison_id", "row_index"]
    rows = compare.identifier_rows(
        sides, lambda chunks: chunks.withColumn("vector", letter_profile(F.col("chunk"))), in_row=False)
    plain = compare.identifier_rows(sides, letter_profile).select(
        *keys, F.col("similarity_score").alias("s"), F.col("change_type").alias("t"))
    return rows.join(plain, keys).select(
        *keys, "label", "redline.words_removed", "redline.words_added", "redline.words_unchanged",
        F.col("similarity_score").isNotNull().alias("paired"),
        F.col("similarity_score").eqNullSafe(F.col("s")).alias("same_similarity"),
        (F.col("change_type") == F.col("t")).alias("same_type"))
