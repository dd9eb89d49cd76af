"""Amendment registers, metrics and studies."""

from pyspark.sql import functions as F

from catalogue.base import (
    ORACLES, documents, query, scratch, sql_count_of, sql_describe, sql_f1, sql_letter_vectors, sql_strip, sql_token_count, sql_word_count, table,
)
from catalogue.compare_queries import (
    SQL_REPORT, SQL_SEMANTIC_PAIRS, SQL_SUMMARY, aligned_report,
)
from catalogue.fixtures import (
    SQL_COUNTRY_NAME, SQL_LIBRARY, SQL_SIDES, library_clauses,
    library_documents, library_versions, vector_sides,
)
from clauseloom import fixed
from clauseloom.operators import align, embed, metrics, register
from clauseloom.session import cut, fan_out
from clauseloom.plans import (
    annotation, cross_country, evolution, localisation, perturbation, recovery,
)
from clauseloom.sources.library import write_study

# -- registers ---------------------------------------------------------------


def booklets(spark, folder):
    """One booklet per document: two lists, an instruction each, prose around them."""
    d = F.col("doc_id")
    a, b = (d % 6 + 1).cast("string"), (d % 8 + 1).cast("string")
    letter = F.char(65 + d % 5)
    first = (F.when(d % 5 == 0, F.concat(F.lit("Replace paragraph "), a, F.lit("."), b, F.lit(" with the\nfollowing.")))
             .when(d % 5 == 1, F.concat(F.lit("Substitute the whole of Section "), a, F.lit(" with the following.")))
             .when(d % 5 == 2, F.concat(F.lit("Delete paragraphs B1 to B"), a, F.lit(".")))
             .when(d % 5 == 3, F.concat(F.lit("In Appendix "), letter, F.lit(", insert the following.")))
             .otherwise(F.concat(F.lit("Amend Tables "), letter, F.lit("2 and "), letter, b, F.lit("."))))
    second = F.concat(F.lit("After paragraph "), b, F.lit("."), a, F.lit(", add the following."))
    line = F.regexp_replace("text", r"[\n.:]+", " ")
    text = F.concat(
        F.lit("Changes\nVolume 1 – Dwellings\nList of amendments\nThe headings\nPage "), d % 90 + 1,
        F.lit("\n"), first, F.lit("\n"), line, F.lit("\nVolume 2 – Buildings other\nList of amendments\nPage 7 to 9\n"),
        second, F.lit("\nSee paragraph 4.4 for details."))
    # long and short texts in turn to all tasks, however the files are cut
    return fan_out(documents(spark, folder, "doc_id", "text")).select(
        d.alias("booklet"), text.alias("text"))


_L = "chr(CAST(65 + doc_id % 5 AS INTEGER))"
SQL_BOOKLETS = f"""
inputs AS (SELECT doc_id, doc_id % 6 + 1 AS a, doc_id % 8 + 1 AS b, {_L} AS letter,
    regexp_replace(text, '[\\n.:]+', ' ', 'g') AS prose FROM documents),
booklets AS (SELECT doc_id AS booklet, 'Changes' || chr(10) || 'Volume 1 – Dwellings' || chr(10) || 'List of amendments' || chr(10)
    || 'The headings' || chr(10) || 'Page ' || (doc_id % 90 + 1) || chr(10)
    || CASE doc_id % 5 WHEN 0 THEN 'Replace paragraph ' || a || '.' || b || ' with the' || chr(10) || 'following.'
      WHEN 1 THEN 'Substitute the whole of Section ' || a || ' with the following.'
      WHEN 2 THEN 'Delete paragraphs B1 to B' || a || '.'
      WHEN 3 THEN 'In Appendix ' || letter || ', insert the following.'
      ELSE 'Amend Tables ' || letter || '2 and ' || letter || b || '.' END
    || chr(10) || prose || chr(10) || 'Volume 2 – Buildings other' || chr(10) || 'List of amendments' || chr(10)
    || 'Page 7 to 9' || chr(10) || 'After paragraph ' || b || '.' || a || ', add the following.' || chr(10)
    || 'See paragraph 4.4 for details.' AS text FROM inputs),
pieces AS (SELECT booklet, unnest(regexp_split_to_array(text, '(?i)List of amendments')) AS piece,
    generate_subscripts(regexp_split_to_array(text, '(?i)List of amendments'), 1) - 1 AS region FROM booklets),
regions AS (SELECT booklet, region, piece, last_value(nullif(regexp_extract(heading, '(?i)Volume\\s*([12])\\s*[–—-]\\s*(?:Dwellings|Buildings)', 1), '') IGNORE NULLS)
    OVER (PARTITION BY booklet ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS volume
  FROM (SELECT *, lag(piece) OVER (PARTITION BY booklet ORDER BY region) AS heading FROM pieces)),
flowed AS (SELECT booklet, region, CAST(volume AS INTEGER) AS volume,
    regexp_replace(regexp_replace(regexp_replace(piece, '\\s*\\n\\s*', ' ', 'g'), '\\s{{2,}}', ' ', 'g'),
      '(?i)\\bPages?\\s+\\d{{1,4}}(?:\\s*(?:to|-|–)\\s*\\d{{1,4}})?\\s*', chr(10), 'g') AS t FROM regions WHERE region > 0),
broken AS (SELECT *, string_split(regexp_replace(t, '([.:])\\s+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS parts FROM flowed),
sentences AS (SELECT booklet, region - 1 AS region, volume, {sql_strip('part')} AS sentence FROM (
    SELECT *, unnest(parts) AS part FROM broken) WHERE {sql_strip('part')} <> ''),
verbs AS (SELECT *, lower(coalesce(
    nullif(regexp_extract(sentence, '(?i)^\\s*(replace|delete|insert|add|amend|substitute)\\b', 1), ''),
    nullif(regexp_extract(sentence, '(?i)^\\s*(?:after|before)\\s+.*?,\\s*(insert|add)\\b', 1), ''),
    nullif(regexp_extract(sentence, '(?i)\\b(?:paragraphs?|tables?|diagrams?)\\s+(?-i:[A-Z]?\\d{{1,3}}|[A-Z])(?:\\.\\d{{1,3}})*\\s*,\\s*(replace|delete|insert|add|amend|substitute)\\b', 1), ''),
    nullif(regexp_extract(sentence, '(?i)^\\s*(?:in|at)\\s+.*?,\\s*(replace|delete|insert|add|amend)\\b', 1), ''))) AS verb
  FROM sentences),
instructions AS MATERIALIZED (SELECT booklet, region, volume, sentence, CASE verb WHEN 'substitute' THEN 'replace'
    WHEN 'add' THEN 'insert' ELSE verb END AS operation FROM verbs WHERE verb IS NOT NULL)
"""


@query("register_regions", f"""WITH {SQL_BOOKLETS}
SELECT booklet, CAST(region - 1 AS INTEGER) AS region, CAST(volume AS INTEGER) AS volume, piece AS text FROM regions WHERE region > 0""")
def register_regions(spark, folder):
    return booklets(spark, folder).select("booklet", F.posexplode(register.regions(
        F.col("text"))).alias("region", "r")).select("booklet", "region", "r.*")


@query("register_instructions", f"""WITH {SQL_BOOKLETS}
SELECT booklet, CAST(region AS INTEGER) AS region, volume, sentence, operation FROM instructions""")
def register_instructions(spark, folder):
    """Rebuilt sentences that are amendment instructions, with their operation."""
    found = booklets(spark, folder).select("booklet", F.posexplode(register.regions(
        F.col("text"))).alias("region", "r")).select("booklet", "region", "r.volume", F.explode(
        register.reflowed_sentences(F.col("r.text"))).alias("sentence"))
    return found.withColumn("operation", register.operation(F.col("sentence"))).filter(
        "operation IS NOT NULL")


# References are taken out of the instructions with RE2 patterns of their own.
SQL_AMENDMENTS = f"""
{SQL_BOOKLETS},
named AS (SELECT *, lower(regexp_extract(sentence, '(?i)\\b(paragraphs?|tables?|appendix|sections?)\\s+(?-i:[A-Z]\\d|[A-Z]\\b|\\d)', 1)) AS noun,
    regexp_extract(sentence, '(?i)\\b(?:paragraphs?|tables?|appendix|sections?)\\s+((?-i:[A-Z])\\d{{0,3}}|\\d{{1,3}}(?:\\.\\d{{1,3}})*)', 1) AS body,
    regexp_extract(sentence, ' (to|and) (?-i:[A-Z])\\d', 1) AS how,
    regexp_extract(sentence, ' (?:to|and) ((?-i:[A-Z])\\d+)', 1) AS other FROM instructions),
bodies AS (SELECT *, CASE WHEN how = 'to' THEN list_transform(range(CAST(regexp_extract(body, '\\d+') AS BIGINT),
      CAST(regexp_extract(other, '\\d+') AS BIGINT) + 1), lambda n: regexp_extract(body, '^[A-Z]*') || n)
    WHEN how = 'and' THEN [body, other] ELSE [body] END AS all_bodies FROM named),
exploded AS (SELECT booklet, volume, operation, sentence, rtrim(noun, 's') AS noun, unnest(all_bodies) AS body FROM bodies),
amendments AS MATERIALIZED (SELECT DISTINCT booklet, volume, operation, sentence AS instruction,
    CASE WHEN noun IN ('table', 'appendix', 'section') THEN upper(noun[1]) || substr(noun, 2) || ' ' || body ELSE body END AS reference,
    CASE WHEN noun IN ('table', 'appendix', 'section') THEN [upper(noun[1]) || substr(noun, 2) || ' ' || body, body]
      ELSE [body, 'Requirement ' || body, 'Section ' || body] END AS aliases FROM exploded)
"""


@query("register_amendments", f"""WITH {SQL_AMENDMENTS}
SELECT booklet, volume, reference, operation, instruction, array_to_string(aliases, '|') AS aliases FROM amendments""")
def register_amendments(spark, folder):
    return register.parse_booklets(booklets(spark, folder)).select(
        "booklet", "volume", "reference", "operation", "instruction",
        F.array_join("aliases", "|").alias("aliases"))


@query("register_spellings", f"""WITH {SQL_AMENDMENTS}
SELECT DISTINCT unnest(aliases) AS spelling FROM amendments WHERE volume = 2 OR volume IS NULL""")
def register_spellings(spark, folder):
    found = register.parse_booklets(booklets(spark, folder))
    return register.spellings(register.of_volume(found, 2))


# A comparison is scored against the registers of its own fifty documents, and
# against the even ones among them.
SQL_SCOPED = f"""
{SQL_AMENDMENTS},
scoped AS (SELECT booklet // 50 AS comparison_id, 'all' AS register, * FROM amendments
  UNION ALL SELECT booklet // 50, 'even', * FROM amendments WHERE booklet % 2 = 0),
numbers AS MATERIALIZED (SELECT comparison_id, coalesce(n1, n2) AS number,
    max(CASE WHEN change_type <> 'Unchanged' THEN round(ratio, 4) END) AS peak FROM rows GROUP BY ALL),
reached AS MATERIALIZED (SELECT DISTINCT s.comparison_id, s.register, s.booklet, s.volume, s.reference, s.operation, n.number, n.peak
  FROM scoped s JOIN numbers n ON n.comparison_id = s.comparison_id AND (
    list_contains(list_transform(s.aliases, lambda x: lower(x)), lower(trim(n.number)))
    OR (regexp_matches(s.reference, '^Section \\d+$') AND starts_with(n.number, substr(s.reference, 9) || '.')
      AND regexp_matches(n.number, '^\\d{{1,3}}\\.\\d'))
    OR (regexp_matches(s.reference, '^Appendix [A-Z]$') AND regexp_matches(n.number,
      '(?i)^(Table\\s+|Diagram\\s+|Figure\\s+)?' || substr(s.reference, 10) || '\\d')))),
gold AS MATERIALIZED (SELECT DISTINCT comparison_id, register, number, peak FROM reached),
cases AS (SELECT comparison_id, unnest(['all', 'even']) AS register FROM (SELECT DISTINCT comparison_id FROM rows))
"""


def _scoped(spark, folder):
    """(report rows, amendments with set_id, scope): two register sets per comparison."""
    found = register.parse_booklets(booklets(spark, folder))
    own = F.floor(F.col("booklet") / 50)
    sets = found.select("*", F.explode(F.when(F.col("booklet") % 2 == 0, F.array(
        F.lit("all"), F.lit("even"))).otherwise(F.array(F.lit("all")))).alias("register"))
    sets = sets.withColumn("set_id", F.concat_ws(":", own, "register")).drop("register")
    ids = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.floor(F.col("doc_id") / 50).alias("comparison_id")).distinct()
    scope = ids.select("comparison_id", F.explode(F.array(F.lit("all"), F.lit("even"))).alias("r")) \
        .select("comparison_id", F.concat_ws(":", "comparison_id", "r").alias("set_id"))
    rows = cut(localisation.scored_rows(aligned_report(spark, folder)))
    return rows, sets, scope


def _localised(spark, folder):
    rows, amendments, scope = _scoped(spark, folder)
    numbers = localisation.flagged_numbers(rows)
    reached = localisation.covered(amendments, scope, numbers)
    return rows, amendments, scope, numbers, reached


def _register(frame):
    return frame.withColumn("register", F.element_at(F.split("set_id", ":"), 2)).drop("set_id")


_PREFIX = f"WITH {SQL_REPORT}, {SQL_SCOPED}"


@query("register_covers", f"{_PREFIX} SELECT comparison_id, register, booklet, reference, operation, number FROM reached")
def register_covers(spark, folder):
    *_, reached = _localised(spark, folder)
    return _register(reached).select("comparison_id", "register", "booklet", "reference",
                                     "operation", "number")


_P, _R, _F = sql_f1("tp", "fp", "fn")
SQL_SWEEP = f"""
{SQL_REPORT}, {SQL_SCOPED},
steps AS (SELECT unnest([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS min_ratio),
grid AS (SELECT c.comparison_id, c.register, s.min_ratio, n.peak >= s.min_ratio AS flag, g.number IS NOT NULL AS listed
  FROM cases c CROSS JOIN steps s JOIN numbers n ON n.comparison_id = c.comparison_id
  LEFT JOIN gold g ON g.comparison_id = c.comparison_id AND g.register = c.register AND g.number = n.number),
tallied AS (SELECT comparison_id, register, min_ratio, count(*) FILTER (WHERE flag) AS flagged,
    count(*) FILTER (WHERE flag AND listed) AS tp, count(*) FILTER (WHERE flag AND NOT listed) AS fp,
    count(*) FILTER (WHERE flag IS NOT TRUE AND listed) AS fn, count(*) FILTER (WHERE flag IS NOT TRUE AND NOT listed) AS tn
  FROM grid GROUP BY ALL),
swept AS (SELECT comparison_id, register, min_ratio, flagged, tp AS true_positives, fp AS false_positives,
    fn AS false_negatives, tn AS true_negatives, {_P} AS precision, {_R} AS recall, {_F} AS f1 FROM tallied)
"""


@query("localisation_sweep", f"WITH {SQL_SWEEP} SELECT * FROM swept")
def localisation_sweep(spark, folder):
    """Localisation scores per register set and minimum change ratio."""
    _, _, scope, numbers, reached = _localised(spark, folder)
    return _register(localisation.sweep(numbers, localisation.gold(reached), scope))


@query("operating_point", f"""WITH {SQL_SWEEP}
SELECT comparison_id, register, min_ratio, flagged, recall FROM (SELECT *, row_number() OVER (
  PARTITION BY comparison_id, register ORDER BY CASE WHEN recall >= 1 THEN 0 ELSE 1 END,
    CASE WHEN recall >= 1 THEN flagged ELSE -recall END, min_ratio) AS r FROM swept) WHERE r = 1""")
def operating_point(spark, folder):
    _, _, scope, numbers, reached = _localised(spark, folder)
    swept = localisation.sweep(numbers, localisation.gold(reached), scope)
    return _register(localisation.operating_point(swept)).select(
        "comparison_id", "register", "min_ratio", "flagged", "recall")


@query("amendment_recall", f"""{_PREFIX},
status AS (SELECT comparison_id, register, booklet, volume, reference, operation, bool_or(peak IS NOT NULL) AS found
  FROM reached GROUP BY ALL)
SELECT comparison_id, register, count(*) AS scored, count(*) FILTER (WHERE found) AS found,
  round(CAST(count(*) FILTER (WHERE found) AS DOUBLE) / count(*), 4) AS amendment_recall FROM status GROUP BY ALL""")
def amendment_recall(spark, folder):
    *_, reached = _localised(spark, folder)
    return _register(localisation.amendment_recall(localisation.amendment_status(reached)))


@query("uncovered_references", f"""{_PREFIX}
SELECT DISTINCT comparison_id, register, reference FROM scoped s WHERE NOT EXISTS (SELECT 1 FROM reached r
  WHERE r.comparison_id = s.comparison_id AND r.register = s.register AND r.reference = s.reference)""")
def uncovered_references(spark, folder):
    _, amendments, scope, _, reached = _localised(spark, folder)
    return _register(localisation.uncovered_references(amendments, scope, reached))


@query("missed_numbers", f"{_PREFIX} SELECT comparison_id, register, number FROM gold WHERE peak IS NULL")
def missed_numbers(spark, folder):
    *_, reached = _localised(spark, folder)
    return _register(localisation.missed_numbers(localisation.gold(reached)))


@query("silent_misses", f"""{_PREFIX}
SELECT r.comparison_id, g.register, r.row_index, g.number, round(similarity, 4) AS similarity_score,
  round(ratio, 4) AS ratio, words_added, words_removed
FROM rows r JOIN gold g ON g.comparison_id = r.comparison_id AND g.number = coalesce(r.n1, r.n2)
WHERE change_type = 'Unchanged' AND c1 IS NOT NULL AND c2 IS NOT NULL AND c1 <> c2""")
def silent_misses(spark, folder):
    rows, *_, reached = _localised(spark, folder)
    return _register(localisation.silent_misses(rows, localisation.gold(reached)))


@query("unlisted_differences", f"""{_PREFIX},
flags AS (SELECT c.register, r.comparison_id, change_type IN ('Minor Edit', 'Significant Change') AS is_edit, round(ratio, 4) AS ratio
  FROM rows r JOIN cases c USING (comparison_id) WHERE change_type <> 'Unchanged' AND NOT EXISTS (
    SELECT 1 FROM gold g WHERE g.comparison_id = r.comparison_id AND g.register = c.register AND g.number = coalesce(r.n1, r.n2)))
SELECT comparison_id, register, count(*) AS unlisted, count(*) FILTER (WHERE is_edit) AS edited,
  count(*) FILTER (WHERE NOT is_edit) AS one_sided, count(*) FILTER (WHERE is_edit AND ratio < 0.02) AS edited_under_2_percent,
  count(*) FILTER (WHERE is_edit AND ratio >= 0.2) AS edited_over_20_percent,
  round(avg(ratio) FILTER (WHERE is_edit) + 1e-12, 4) AS mean, round(min(ratio) FILTER (WHERE is_edit), 4) AS min,
  round(quantile_cont(ratio, 0.25) FILTER (WHERE is_edit) + 1e-12, 4) AS p25, round(quantile_cont(ratio, 0.5) FILTER (WHERE is_edit) + 1e-12, 4) AS median,
  round(quantile_cont(ratio, 0.75) FILTER (WHERE is_edit) + 1e-12, 4) AS p75, round(max(ratio) FILTER (WHERE is_edit), 4) AS max
FROM flags GROUP BY ALL""")
def unlisted_differences(spark, folder):
    rows, _, scope, _, reached = _localised(spark, folder)
    return _register(localisation.unlisted(rows, localisation.gold(reached), scope))


# -- metrics -----------------------------------------------------------------

LABELS = ["0", "1", "2"]


def _two_labellings(spark, folder):
    """Quality labels against a rule on length, per source."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars", "source")
    return labels.join(docs, "doc_id").select(
        "source", "doc_id", F.col("quality").cast("string").alias("truth"),
        F.when(F.col("n_chars") > 4000, "2").when(F.col("n_chars") > 900, "1").otherwise("0")
        .alias("prediction"))


SQL_LABELLED = """
labelled AS MATERIALIZED (SELECT source, doc_id, CAST(quality AS VARCHAR) AS truth, CASE WHEN n_chars > 4000 THEN '2' WHEN n_chars > 900
    THEN '1' ELSE '0' END AS prediction FROM labels JOIN documents USING (doc_id)),
grid AS (SELECT source, label FROM (SELECT DISTINCT source FROM labelled) CROSS JOIN (SELECT unnest(['0', '1', '2']) AS label)),
per_label AS MATERIALIZED (SELECT g.source, g.label, count(*) FILTER (WHERE truth = label AND prediction = label) AS tp,
    count(*) FILTER (WHERE truth <> label AND prediction = label) AS fp,
    count(*) FILTER (WHERE truth = label AND prediction <> label) AS fn,
    count(*) FILTER (WHERE truth <> label AND prediction <> label) AS tn, count(*) AS total
  FROM grid g JOIN labelled l ON l.source = g.source GROUP BY ALL)
"""


@query("score_sets", f"""WITH {SQL_LABELLED},
t AS (SELECT source, count(*) FILTER (WHERE truth = '1' AND prediction = '1') AS tp, count(*) FILTER (WHERE truth <> '1' AND prediction = '1') AS fp,
  count(*) FILTER (WHERE truth = '1' AND prediction <> '1') AS fn, count(*) FILTER (WHERE truth <> '1' AND prediction <> '1') AS tn
  FROM labelled GROUP BY source)
SELECT source, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
  {_P} AS precision, {_R} AS recall, {_F} AS f1 FROM t""")
def score_sets(spark, folder):
    rows = _two_labellings(spark, folder)
    return metrics.score_sets(rows.filter("prediction = '1'"), rows.filter("truth = '1'"),
                              ["source", "doc_id"], rows, ("source",))


@query("confusion_matrix", f"WITH {SQL_LABELLED} SELECT source, truth, prediction, count(*) AS n FROM labelled GROUP BY ALL")
def confusion_matrix(spark, folder):
    return metrics.confusion(_two_labellings(spark, folder), "source")


@query("per_label_scores", f"""WITH {SQL_LABELLED}
SELECT source, label, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
  tp + fn AS support, {_P} AS precision, {_R} AS recall, {_F} AS f1 FROM per_label""")
def per_label_scores(spark, folder):
    matrix = metrics.confusion(_two_labellings(spark, folder), "source")
    return metrics.with_scores(metrics.per_label(matrix, LABELS, "source")).drop("_total")


_RAW = "(CASE WHEN 2 * tp + fp + fn = 0 OR tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END)"


@query("matrix_scores", f"""WITH {SQL_LABELLED},
sums AS (SELECT source, max(total) AS total, sum(tp) AS hits, avg({_RAW}) FILTER (WHERE tp + fn > 0) AS macro,
    sum({_RAW} * (tp + fn)) / sum(tp + fn) AS weighted,
    sum((tp + fn) / CAST(total AS DOUBLE) * ((tp + fp) / CAST(total AS DOUBLE))) AS chance FROM per_label GROUP BY source)
SELECT source, total AS rows, round(CAST(hits AS DOUBLE) / total, 4) AS accuracy, round(macro, 4) AS macro_f1,
  round(weighted, 4) AS weighted_f1, round(CASE WHEN chance >= 1 THEN 1.0 ELSE
    (CAST(hits AS DOUBLE) / total - chance) / (1 - chance) END, 4) AS kappa FROM sums""")
def matrix_scores(spark, folder):
    """Accuracy, macro and weighted F1 and Cohen's kappa per source."""
    matrix = metrics.confusion(_two_labellings(spark, folder), "source")
    return metrics.matrix_scores(matrix, LABELS, "source")


@query("describe_scores", f"""
WITH v AS (SELECT l_returnflag, CAST(l_discount AS DOUBLE) * CAST(l_tax AS DOUBLE) AS x FROM lineitem),
s AS (SELECT l_returnflag, round(x, 4) AS score FROM v)
{sql_describe('s', 'score', 'l_returnflag')}""")
def describe_scores(spark, folder):
    scores = table(spark, folder, "lineitem").select("l_returnflag", F.round(
        F.col("l_discount").cast("double") * F.col("l_tax").cast("double"), 4).alias("score"))
    return metrics.describe(scores, "score", "l_returnflag")


# -- recovery ----------------------------------------------------------------

def _recovered(spark, folder):
    sides = vector_sides(spark, folder)
    truth = sides.filter("side = 1").select(
        "comparison_id", F.col("idx").alias("index_v1"),
        F.when(F.col("idx") % 10 != 3, F.col("idx")).alias("index_v2"))
    return truth, align.align_semantic(sides)


SQL_JUDGED = f"""
{SQL_SEMANTIC_PAIRS},
truth AS (SELECT comparison_id, idx AS index_v1, idx AS index_v2 FROM vectors WHERE side = 1 AND idx % 10 <> 3),
found AS (SELECT * FROM semantic_pairs WHERE index_v1 IS NOT NULL AND index_v2 IS NOT NULL),
judged AS MATERIALIZED (SELECT coalesce(t.comparison_id, f.comparison_id) AS comparison_id, coalesce(t.index_v1, f.index_v1) AS index_v1,
    t.index_v1 IS NOT NULL AS actual, f.index_v1 IS NOT NULL AS predicted, f.match_score
  FROM truth t FULL OUTER JOIN found f ON f.comparison_id = t.comparison_id AND f.index_v1 = t.index_v1 AND f.index_v2 = t.index_v2)
"""


@query("alignment_recovery", f"""WITH RECURSIVE {SQL_JUDGED},
t AS (SELECT comparison_id, count(*) FILTER (WHERE actual AND predicted) AS tp, count(*) FILTER (WHERE NOT actual) AS fp,
    count(*) FILTER (WHERE NOT predicted) AS fn FROM judged GROUP BY 1),
lefts AS (SELECT comparison_id, index_v1, bool_or(actual) AS known, bool_or(predicted) AS paired, bool_or(actual AND predicted) AS hit
  FROM judged GROUP BY ALL),
o AS (SELECT comparison_id, count(*) FILTER (WHERE paired AND NOT hit) AS disagreed, count(*) FILTER (WHERE NOT paired) AS missed
  FROM lefts WHERE known GROUP BY 1)
SELECT t.comparison_id, tp AS recovered, tp + fn AS identifier_pairs, tp + fp AS semantic_pairs, disagreed, missed,
  {_P} AS precision, {_R} AS recall, {_F} AS f1 FROM t JOIN o USING (comparison_id)""")
def alignment_recovery(spark, folder):
    return recovery.recovery(*_recovered(spark, folder)).select(
        "comparison_id", "recovered", "identifier_pairs", "semantic_pairs", "disagreed", "missed",
        "precision", "recall", "f1")


@query("recovery_scores", f"""WITH RECURSIVE {SQL_JUDGED},
paired AS (SELECT comparison_id, actual AS correct, match_score FROM judged WHERE predicted)
{sql_describe('paired', 'match_score', 'comparison_id, correct')}""")
def recovery_scores(spark, folder):
    return recovery.score_distributions(*_recovered(spark, folder))


# -- perturbation ------------------------------------------------------------

def _measured_clauses(spark, folder):
    """Library clauses with measurements worked into their text."""
    d = F.col("id")
    content = F.regexp_replace("content", r"\. ", F.concat_ws(
        "", F.lit(" at least "), d % 900, F.lit(" mm or "), d % 7, F.lit(".5 m. "))).alias("content")
    return library_clauses(spark, folder).select("id", "version_id", content)


_BUMPED = "CASE WHEN x = 0 THEN 1.0 ELSE x * 1.25 END"
SQL_MEASURED = """
measured AS MATERIALIZED (SELECT doc_id AS id, doc_id // 50 AS version_id, replace(text, '. ', ' at least ' || (doc_id % 900) || ' mm or ' || (doc_id % 7)
    || '.5 m. ') AS content FROM documents)
"""
# DuckDB rounds halves away from zero, the edit rounds them to even: x.5 * 1.25 has no ties,
# whole numbers do and are put right below.
_MM = """CASE WHEN id % 900 = 0 THEN '1.0' WHEN (id % 900) * 1.25 >= 10 THEN CAST(CAST(CASE
  WHEN ((id % 900) * 5) % 4 = 2 AND (((id % 900) * 5) // 4) % 2 = 0 THEN ((id % 900) * 5) // 4
  WHEN ((id % 900) * 5) % 4 >= 2 THEN ((id % 900) * 5) // 4 + 1 ELSE ((id % 900) * 5) // 4 END AS BIGINT) AS VARCHAR)
  ELSE map {1: '1.2', 2: '2.5', 3: '3.8', 4: '5.0', 5: '6.2', 6: '7.5', 7: '8.8'}[CAST(id % 900 AS INTEGER)] END"""
_M = "['0.6', '1.9', '3.1', '4.4', '5.6', '6.9', '8.1'][id % 7 + 1]"
_SENT = "string_split(regexp_replace(content, '([.;])\\s+', '\\1' || chr(7), 'g'), chr(7))"


SQL_ALTERED = f"""{SQL_MEASURED},
split AS (SELECT *, {_SENT} AS s FROM measured),
altered AS (
  SELECT id, 'identity' AS perturbation, 'Unchanged' AS expected, content AS original, content AS altered FROM split
  UNION ALL SELECT id, 'numeric_values', NULL, content, replace(replace(content, ' ' || (id % 900) || ' mm', ' ' || {_MM} || ' mm'),
    ' ' || (id % 7) || '.5 m.', ' ' || {_M} || ' m.') FROM split WHERE contains(content, ' mm or ')
  UNION ALL SELECT id, 'sentence_removed', NULL, content, array_to_string(s[1:len(s) - 1], ' ') FROM split WHERE len(s) >= 3
  UNION ALL SELECT id, 'sentence_reordered', 'Unchanged', content,
    array_to_string(list_concat(list_concat([s[len(s)]], s[2:len(s) - 1]), [s[1]]), ' ') FROM split WHERE len(s) >= 3),
edits AS MATERIALIZED (SELECT id, perturbation, expected, altered FROM altered WHERE perturbation = 'identity' OR altered <> original)
"""


@query("perturb_clauses", f"WITH {SQL_ALTERED} SELECT * FROM edits")
def perturb_clauses(spark, folder):
    return perturbation.perturbed(_measured_clauses(spark, folder)).drop("original")


@query("perturbation_sample", f"""WITH {SQL_MEASURED}
SELECT id FROM measured WHERE length(content) >= 200
ORDER BY md5(CAST(id AS VARCHAR) || '-{fixed.SAMPLE_SEED}'), id LIMIT {fixed.PERTURB_SAMPLE}""")
def perturbation_sample(spark, folder):
    return perturbation.sample(_measured_clauses(spark, folder)).select("id")


def _scored(spark, folder):
    pairs = perturbation.perturbed(_measured_clauses(spark, folder), embed.letter_profile)
    return perturbation.measured(pairs, embed.letter_profile)


# The unaltered text of an edit is the one of the identity.
SQL_SCORED = f"""{SQL_ALTERED},
{sql_letter_vectors("edits", "id || '/' || perturbation", "altered").strip()},
alike AS (SELECT e.*, list_inner_product(a.vector, o.vector) AS similarity FROM edits e
  JOIN encoded a ON a.key = id || '/' || perturbation JOIN encoded o ON o.key = id || '/identity'),
scored AS MATERIALIZED (SELECT *, CASE WHEN similarity >= 0.95 THEN 'Unchanged' WHEN similarity >= 0.8 THEN 'Minor Edit'
  ELSE 'Significant Change' END AS prediction FROM alike)
"""


@query("perturbation_outcome", f"""WITH {SQL_SCORED}
SELECT perturbation, prediction, count(*) AS n FROM scored GROUP BY ALL""")
def perturbation_outcome(spark, folder):
    """Classes by similarity alone for every perturbed clause of the library."""
    return perturbation.outcome(_scored(spark, folder))


@query("perturbation_distributions")
def perturbation_distributions(spark, folder):
    drawn = perturbation.long_enough(_measured_clauses(spark, folder))
    pairs = perturbation.perturbed(drawn, embed.letter_profile)
    return perturbation.distributions(perturbation.measured(pairs, embed.letter_profile))


@query("perturbation_summaries", f"""WITH {SQL_SCORED},
counted AS (SELECT perturbation, similarity, {sql_token_count('altered')} AS after,
    {sql_token_count('original')} AS before FROM (SELECT *, max(CASE WHEN perturbation = 'identity' THEN altered END)
      OVER (PARTITION BY id) AS original FROM scored) WHERE length(original) >= {fixed.PERTURB_MIN_CHARS}),
measures AS (SELECT perturbation, 'similarity' AS measure, round(similarity, 4) AS value FROM counted
  UNION ALL SELECT perturbation, 'word_change_ratio', round(CAST(before - after AS DOUBLE) / greatest(before, 1), 4) FROM counted
    WHERE perturbation IN ('identity', 'sentence_removed'))
{sql_describe('measures', 'value', 'perturbation, measure')}""")
def perturbation_summaries(spark, folder):
    """The distributions but for the ratios of edits inside a text, which hang on the matcher."""
    inner = F.col("perturbation").isin("numeric_values", "sentence_reordered") & (F.col("measure") == "word_change_ratio")
    return perturbation_distributions(spark, folder).filter(~inner)


@query("perturbation_matrix", f"""WITH {SQL_SCORED},
used AS (SELECT expected AS truth, prediction FROM scored WHERE expected IS NOT NULL),
names AS (SELECT unnest(['Unchanged', 'Minor Edit', 'Significant Change', 'Added', 'Removed']) AS label),
per AS (SELECT label, count(*) AS total, count(*) FILTER (WHERE truth = label AND prediction = label) AS tp,
    count(*) FILTER (WHERE truth <> label AND prediction = label) AS fp,
    count(*) FILTER (WHERE truth = label AND prediction <> label) AS fn FROM used CROSS JOIN names GROUP BY label),
totals AS (SELECT max(total) AS total, sum(tp) AS hits, avg({_RAW}) FILTER (WHERE tp + fn > 0) AS macro,
    sum({_RAW} * (tp + fn)) / sum(tp + fn) AS weighted,
    sum((tp + fn) / CAST(total AS DOUBLE) * ((tp + fp) / CAST(total AS DOUBLE))) AS chance FROM per)
SELECT total AS rows, round(CAST(hits AS DOUBLE) / total, 4) AS accuracy, round(macro, 4) AS macro_f1,
  round(weighted, 4) AS weighted_f1, round(CASE WHEN chance >= 1 THEN 1.0 ELSE
    (CAST(hits AS DOUBLE) / total - chance) / (1 - chance) END, 4) AS kappa FROM totals""")
def perturbation_matrix(spark, folder):
    matrix = perturbation.expected_matrix(_scored(spark, folder))
    return metrics.matrix_scores(matrix, fixed.CHANGE_TYPES)


@query("numeric_finding", f"""WITH {SQL_SCORED}
SELECT count(*) AS pairs, round(CAST(count(*) FILTER (WHERE prediction = 'Unchanged') AS DOUBLE) / count(*), 4)
  AS classified_unchanged_share FROM scored WHERE perturbation = 'numeric_values'""")
def numeric_finding(spark, folder):
    return perturbation.numeric_finding(_scored(spark, folder))


@query("window_exposure", f"""WITH {SQL_LIBRARY},
c AS (SELECT version_id, {sql_word_count('content')} > 180 AS long FROM clauses)
SELECT version_id, count(*) AS clauses_total, count(*) FILTER (WHERE long) AS clauses_exceeding_window,
  round(CAST(count(*) FILTER (WHERE long) AS DOUBLE) / count(*), 4) AS share_exceeding_window FROM c GROUP BY 1""")
def window_exposure(spark, folder):
    return perturbation.window_exposure(library_clauses(spark, folder), 180, "version_id")


@query("append_curve", f"""WITH {SQL_LIBRARY},
longest AS (SELECT version_id, content AS base FROM clauses
  QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY length(content) DESC, id) = 1),
steps AS (SELECT version_id, base, CAST(unnest({fixed.WINDOW_REPEATS}) AS INTEGER) AS repeats FROM longest),
extended AS MATERIALIZED (SELECT *, base || repeat('{fixed.WINDOW_FILLER}', repeats) AS altered FROM steps),
{sql_letter_vectors("extended", "version_id || '/' || repeats", "altered").strip()},
curve AS (SELECT version_id, repeats, {sql_word_count('altered')} - {sql_word_count('base')} AS words_appended,
    round(list_inner_product(a.vector, o.vector), 6) AS similarity FROM extended
  JOIN encoded a ON a.key = version_id || '/' || repeats JOIN encoded o ON o.key = version_id || '/0'),
fall AS (SELECT version_id, round(max(similarity) FILTER (WHERE repeats = 0) - max(similarity) FILTER (WHERE repeats = 40), 6)
  AS "drop" FROM curve GROUP BY 1)
SELECT c.*, "drop", "drop" < 0.005 AS blind FROM curve c JOIN fall USING (version_id)""")
def append_curve(spark, folder):
    # written once: the fall is taken from the same curve
    curve = cut(perturbation.append_curve(library_clauses(spark, folder), embed.letter_profile,
                                          "version_id"))
    return curve.join(perturbation.append_drop(curve, "version_id"), "version_id")


# -- annotation --------------------------------------------------------------

def _sample(spark, folder):
    return cut(annotation.draw(annotation.to_label(aligned_report(spark, folder)), size=20))


@query("annotation_quota", f"""WITH {SQL_REPORT},
classes AS (SELECT comparison_id, change_type, count(*) AS held FROM rows GROUP BY ALL),
quotas AS (SELECT *, greatest(1, 20 // count(*) OVER (PARTITION BY comparison_id)) AS quota FROM classes)
SELECT comparison_id, least(20, CAST(sum(held) AS BIGINT)) AS drawn, CAST(sum(least(held, quota)) AS BIGINT) AS by_quota,
  true AS quotas_met FROM quotas GROUP BY 1""")
def annotation_quota(spark, folder):
    """Sample sizes, and that every class has its quota."""
    rows = cut(aligned_report(spark, folder).select("comparison_id", "row_index", "change_type"))
    held = rows.groupBy("comparison_id", "change_type").agg(F.count("*").alias("held"))
    drawn = annotation.draw(rows, size=20).groupBy("comparison_id", "change_type").agg(
        F.count("*").alias("n"))
    classes = held.groupBy("comparison_id").agg(F.count("*").alias("classes"))
    both = held.join(drawn, ["comparison_id", "change_type"], "left").na.fill(0, ["n"]).join(
        classes, "comparison_id")
    quota = F.least("held", F.greatest(F.lit(1), F.floor(F.lit(20) / F.col("classes"))))
    return both.groupBy("comparison_id").agg(
        F.sum("n").alias("drawn"), F.sum(quota).alias("by_quota"),
        F.bool_and(F.col("n") >= quota).alias("quotas_met"))


@query("annotation_sheet", f"""WITH {SQL_REPORT},
drawn_rows AS (SELECT *, md5(comparison_id || '-' || row_index || '-{fixed.SAMPLE_SEED}') AS draw FROM rows),
placed_rows AS (SELECT *, row_number() OVER (PARTITION BY comparison_id, change_type ORDER BY draw, row_index) AS place FROM drawn_rows),
row_quotas AS (SELECT comparison_id, greatest(1, 20 // count(DISTINCT change_type)) AS quota FROM rows GROUP BY 1),
chosen_rows AS (SELECT r.* FROM placed_rows r JOIN row_quotas USING (comparison_id)
  QUALIFY row_number() OVER (PARTITION BY comparison_id ORDER BY place > quota, draw, row_index) <= 20)
SELECT comparison_id, row_number() OVER (PARTITION BY comparison_id ORDER BY md5(draw || '-{fixed.SAMPLE_SEED}'), row_index) - 1 AS id,
  coalesce(n1, '') AS clause_v1, coalesce(n2, '') AS clause_v2, coalesce(nullif(s2, ''), nullif(s1, ''), '') AS section,
  replace(coalesce(c1, ''), chr(13), ' ') AS text_v1, replace(coalesce(c2, ''), chr(13), ' ') AS text_v2, '' AS annotator_change_type, '' AS annotator_alignment_ok,
  '' AS annotator_notes, change_type AS system_change_type, round(similarity, 4) AS system_similarity,
  CAST(NULL AS DOUBLE) AS system_match_score, 'identifier' AS system_alignment_method, round(ratio, 4) AS word_change_ratio
FROM chosen_rows""")
def annotation_sheet(spark, folder):
    drawn = _sample(spark, folder)
    return annotation.sheet(drawn).join(annotation.answer_key(drawn), ["comparison_id", "id"])


@query("score_annotations", f"""WITH {SQL_REPORT},
sheet AS (SELECT comparison_id, row_index, change_type AS prediction, CASE WHEN row_index % 6 = 0 THEN NULL
    WHEN row_index % 5 = 0 THEN 'Minor Edit' ELSE change_type END AS truth, row_index % 4 AS flag FROM rows),
used AS (SELECT * FROM sheet WHERE truth IS NOT NULL),
names AS (SELECT unnest(['Unchanged', 'Minor Edit', 'Significant Change', 'Added', 'Removed']) AS label),
per AS (SELECT comparison_id, label, count(*) AS total, count(*) FILTER (WHERE truth = label AND prediction = label) AS tp,
    count(*) FILTER (WHERE truth <> label AND prediction = label) AS fp, count(*) FILTER (WHERE truth = label AND prediction <> label) AS fn
  FROM used CROSS JOIN names GROUP BY ALL),
scores AS (SELECT comparison_id, CAST(sum(tp) AS DOUBLE) / max(total) AS agree, avg({_RAW}) FILTER (WHERE tp + fn > 0) AS macro,
    sum({_RAW} * (tp + fn)) / sum(tp + fn) AS weighted,
    sum((tp + fn) / CAST(total AS DOUBLE) * ((tp + fp) / CAST(total AS DOUBLE))) AS chance FROM per GROUP BY 1),
counts AS (SELECT comparison_id, count(*) FILTER (WHERE truth IS NOT NULL) AS annotated_rows,
    count(*) FILTER (WHERE truth IS NULL) AS skipped_rows,
    count(*) FILTER (WHERE truth IS NOT NULL AND flag IN (1, 2)) AS alignment_correct,
    count(*) FILTER (WHERE truth IS NOT NULL AND flag = 3) AS alignment_wrong,
    count(*) FILTER (WHERE truth IS NOT NULL AND flag = 0) AS alignment_unlabelled FROM sheet GROUP BY 1)
SELECT c.*, CASE WHEN alignment_correct + alignment_wrong > 0 THEN
    round(CAST(alignment_correct AS DOUBLE) / (alignment_correct + alignment_wrong), 4) END AS alignment_accuracy,
  round(agree, 4) AS accuracy, round(macro, 4) AS macro_f1, round(weighted, 4) AS weighted_f1,
  round(CASE WHEN chance >= 1 THEN 1.0 ELSE (agree - chance) / (1 - chance) END, 4) AS kappa
FROM counts c LEFT JOIN scores USING (comparison_id)""")
def score_annotations(spark, folder):
    """Scoring of sheets filled in by rule: some blank, some disagreeing, odd spellings."""
    return annotation.agreement(_filled_sheets(spark, folder))


def _filled_sheets(spark, folder):
    rows = cut(aligned_report(spark, folder).withColumn("id", F.col("row_index")))
    r = F.col("id")
    given = (F.when(r % 6 == 0, "").when(r % 5 == 0, " MINOR edit ")
             .otherwise(F.upper("change_type")))
    flags = F.get(F.array(F.lit(""), F.lit("Yes"), F.lit("1"), F.lit("no ")), (r % 4).cast("int"))
    filled = annotation.sheet(rows).join(rows.select("comparison_id", "id", given.alias("_given")),
                                       ["comparison_id", "id"])
    filled = filled.withColumn("annotator_change_type", F.col("_given")).withColumn(
        "annotator_alignment_ok", flags).drop("_given")
    return annotation.labelled(filled, annotation.answer_key(rows))


@query("annotation_disagreements", f"""WITH {SQL_REPORT}
SELECT comparison_id, row_index AS id, coalesce(n1, '') AS clause_v1, coalesce(n2, '') AS clause_v2, 'Minor Edit' AS annotator,
  change_type AS system, round(similarity, 4) AS similarity, '' AS notes
FROM rows WHERE row_index % 6 > 0 AND row_index % 5 = 0 AND change_type <> 'Minor Edit'""")
def annotation_disagreements(spark, folder):
    return annotation.disagreements(_filled_sheets(spark, folder))


# -- evolution ---------------------------------------------------------------

def _section(number: str) -> str:
    return f"""CASE WHEN regexp_matches({number}, '^\\d{{1,2}}\\.') THEN 'Section ' || regexp_extract({number}, '^(\\d{{1,2}})\\.', 1)
    WHEN starts_with({number}, 'Requirement') OR starts_with({number}, 'B') THEN 'Requirements'
    WHEN starts_with({number}, 'Appendix') THEN 'Appendix' WHEN starts_with({number}, 'Table') THEN 'Table'
    WHEN starts_with({number}, 'Diagram') THEN 'Diagram' WHEN starts_with({number}, 'Section') THEN {number} ELSE 'Other' END"""


@query("edition_shape", f"""WITH {SQL_LIBRARY},
c AS (SELECT version_id, {sql_word_count('content')} AS words FROM clauses)
SELECT version_id, count(*) AS clauses, CAST(sum(words) AS BIGINT) AS words,
  round(CAST(sum(words) AS DOUBLE) / count(*), 1) AS mean_clause_words,
  count(*) FILTER (WHERE words > 180) AS clauses_over_180_words FROM c GROUP BY 1""")
def edition_shape(spark, folder):
    return evolution.edition_shape(library_clauses(spark, folder))


@query("consecutive_editions", f"""WITH {SQL_LIBRARY}
SELECT * FROM (SELECT id AS comparison_id, document_id, id AS version_v1,
  lead(id) OVER (PARTITION BY document_id ORDER BY uploaded_day, id) AS version_v2 FROM versions) WHERE version_v2 IS NOT NULL""")
def consecutive_editions(spark, folder):
    return evolution.consecutive(library_versions(spark, folder))


@query("edition_transitions", f"""WITH {SQL_SUMMARY}
SELECT comparison_id, total_clauses, unchanged, minor_edits, significant_changes, added, removed, words_added,
  words_removed, changed, round(change_rate, 1) AS change_rate_percent, words_added - words_removed AS net_words FROM summary""")
def edition_transitions(spark, folder):
    return evolution.transitions(aligned_report(spark, folder))


@query("changed_sections", f"""WITH {SQL_REPORT},
s AS (SELECT comparison_id, {_section('coalesce(n1, n2)')} AS section, count(*) AS n FROM rows WHERE change_type <> 'Unchanged' GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY comparison_id ORDER BY n DESC, section) AS INTEGER) AS rank FROM s) WHERE rank <= 8""")
def changed_sections(spark, folder):
    return evolution.changed_sections(aligned_report(spark, folder))


@query("section_of_number", f"""WITH {SQL_LIBRARY} SELECT id, {_section('clause_number')} AS section FROM clauses""")
def section_of_number(spark, folder):
    return library_clauses(spark, folder).select(
        "id", evolution.section_of(F.col("clause_number")).alias("section"))


SQL_VOLUME_ONE = f"""
{SQL_AMENDMENTS},
volume_one AS MATERIALIZED (SELECT *, booklet // 50 AS register, {_section('reference')} AS section FROM amendments WHERE volume = 1 OR volume IS NULL)
"""


def _registers(spark, folder):
    """Amendments with the fifty booklets of a register put together."""
    found = register.parse_booklets(booklets(spark, folder))
    return found.withColumn("booklet", F.floor(F.col("booklet") / 50))


@query("register_attention", f"""WITH {SQL_VOLUME_ONE}
SELECT register AS booklet, count(*) AS amendments, count(DISTINCT section) AS sections_touched FROM volume_one GROUP BY 1""")
def register_attention(spark, folder):
    return evolution.register_attention(_registers(spark, folder))


@query("register_sections", f"""WITH {SQL_VOLUME_ONE},
c AS (SELECT register AS booklet, section, count(*) AS n FROM volume_one GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY booklet ORDER BY n DESC, section) AS INTEGER) AS rank FROM c) WHERE rank <= 4""")
def register_sections(spark, folder):
    return evolution.register_sections(_registers(spark, folder))


@query("register_section_totals", f"""WITH {SQL_VOLUME_ONE}
SELECT section, count(*) AS amendments FROM volume_one GROUP BY 1 ORDER BY amendments DESC, section LIMIT 10""")
def register_section_totals(spark, folder):
    return evolution.section_totals(_registers(spark, folder))


@query("register_operations", f"WITH {SQL_VOLUME_ONE} SELECT operation, count(*) AS amendments FROM volume_one GROUP BY 1")
def register_operations(spark, folder):
    return evolution.operation_totals(_registers(spark, folder))


@query("repeated_references", f"""WITH {SQL_VOLUME_ONE},
c AS (SELECT reference, count(DISTINCT register) AS rounds FROM volume_one GROUP BY 1 HAVING rounds > 1)
SELECT * FROM c""")
def repeated_references(spark, folder):
    return evolution.repeated_references(_registers(spark, folder), limit=None)


@query("jurisdiction_sizes", f"""WITH {SQL_LIBRARY},
s AS (SELECT coalesce(i.country_code, 'INT') AS country_code, count(DISTINCT v.id) AS editions, count(*) AS clauses,
    CAST(sum({sql_word_count('content')}) AS BIGINT) AS words
  FROM clauses c JOIN versions v ON v.id = c.version_id JOIN instruments i ON i.id = v.document_id GROUP BY 1)
SELECT country_code, editions, clauses, words, {SQL_COUNTRY_NAME} AS country_name FROM s WHERE country_code <> 'INT'""")
def jurisdiction_sizes(spark, folder):
    return evolution.jurisdiction_sizes(library_documents(spark, folder),
                                        library_versions(spark, folder),
                                        library_clauses(spark, folder))


# -- across countries --------------------------------------------------------

@query("pair_study", f"""WITH {SQL_SIDES}, pairs AS (SELECT coalesce(a.comparison_id, b.comparison_id) AS comparison_id, a.idx AS i, b.idx AS j
  FROM (SELECT *, row_number() OVER (PARTITION BY comparison_id, clause_number ORDER BY idx) AS k FROM sides WHERE side = 1) a
  FULL OUTER JOIN (SELECT *, row_number() OVER (PARTITION BY comparison_id, clause_number ORDER BY idx) AS k FROM sides WHERE side = 2) b
  ON a.comparison_id = b.comparison_id AND a.clause_number = b.clause_number AND a.k = b.k),
sizes AS (SELECT comparison_id, count(*) FILTER (WHERE side = 1) AS clauses_left, count(*) FILTER (WHERE side = 2) AS clauses_right,
    count(DISTINCT clause_number) FILTER (WHERE side = 1) AS u1, count(DISTINCT clause_number) FILTER (WHERE side = 2) AS u2 FROM sides GROUP BY 1),
shared AS (SELECT a.comparison_id, count(DISTINCT a.clause_number) AS s FROM sides a JOIN sides b
  ON a.comparison_id = b.comparison_id AND a.clause_number = b.clause_number AND a.side = 1 AND b.side = 2 GROUP BY 1),
m AS (SELECT comparison_id, count(*) FILTER (WHERE i IS NOT NULL AND j IS NOT NULL) AS matched,
    count(*) FILTER (WHERE j IS NULL) AS unmatched_left, count(*) FILTER (WHERE i IS NULL) AS unmatched_right FROM pairs GROUP BY 1)
SELECT comparison_id, clauses_left, clauses_right, matched, unmatched_left, unmatched_right,
  round(CAST(s AS DOUBLE) / least(u1, u2), 4) AS identifier_overlap,
  round(CAST(matched AS DOUBLE) / least(clauses_left, clauses_right), 4) AS match_rate
FROM sizes JOIN shared USING (comparison_id) JOIN m USING (comparison_id)""")
def pair_study(spark, folder):
    from catalogue.fixtures import positioned_sides

    sides = positioned_sides(spark, folder)
    return cross_country.pair_study(sides, align.align_by_identifier(sides))


@query("pair_scores", f"""WITH RECURSIVE {SQL_SEMANTIC_PAIRS}
{sql_describe('semantic_pairs', 'match_score', 'comparison_id')}""")
def pair_scores(spark, folder):
    pairs = align.align_semantic(vector_sides(spark, folder))
    return cross_country.score_summary(pairs, "match_score")


@query("numbering_shapes", f"""WITH {SQL_LIBRARY}
SELECT version_id, count(*) AS clauses, count(DISTINCT regexp_replace(clause_number, '\\d+', 'N', 'g')) AS distinct_shapes,
  round(avg(length(clause_number) - length(replace(clause_number, '.', '')) + 1), 2) AS mean_depth FROM clauses GROUP BY 1""")
def numbering_shapes(spark, folder):
    return cross_country.numbering_shapes(library_clauses(spark, folder), "version_id")


@query("top_shapes", f"""WITH {SQL_LIBRARY},
s AS (SELECT version_id, regexp_replace(clause_number, '\\d+', 'N', 'g') AS shape, count(*) AS n FROM clauses GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY version_id ORDER BY n DESC, shape) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def top_shapes(spark, folder):
    return cross_country.top_shapes(library_clauses(spark, folder), "version_id")


# Prose of the tables holds no building terms; some are put in, also across clause ends.
def _termed_clauses(spark, folder):
    o = F.col("ordinal")
    text = F.replace(F.replace(F.col("content"), F.lit(" the "), F.lit(" fire door ")),
                     F.lit(" and "), F.when(F.floor(F.col("version_id") / 3) % 2 == 0, " Sprinkler ").otherwise(" smoke alarm "))
    text = F.when(o % 10 == 4, F.concat(text, F.lit(" means"))).when(o % 10 == 5, "of").when(
        o % 10 == 6, F.concat(F.lit("escape route "), text)).when(
        o % 10 == 8, F.concat(text, F.lit(" travel"))).when(
        o % 10 == 9, F.concat(F.lit("distance "), text)).otherwise(text)
    return library_clauses(spark, folder).select("id", "version_id", "ordinal",
                                                 text.alias("content"))


_TERM_ROWS = ", ".join(f"('{f}', '{t}')" for f, ts in fixed.TERM_FAMILIES.items() for t in ts)
SQL_TERMS = f"""
{SQL_LIBRARY},
termed AS (SELECT version_id, ordinal, CASE ordinal % 10 WHEN 4 THEN t || ' means' WHEN 5 THEN 'of' WHEN 6 THEN 'escape route ' || t
    WHEN 8 THEN t || ' travel' WHEN 9 THEN 'distance ' || t ELSE t END AS content
  FROM (SELECT *, replace(replace(content, ' the ', ' fire door '), ' and ', CASE WHEN (version_id // 3) % 2 = 0 THEN ' Sprinkler '
    ELSE ' smoke alarm ' END) AS t FROM clauses)),
joined AS MATERIALIZED (SELECT version_id, lower(string_agg(content, ' ' ORDER BY ordinal)) AS text FROM termed GROUP BY 1),
terms AS (SELECT * FROM (VALUES {_TERM_ROWS}) AS v(family, term)),
rates AS MATERIALIZED (SELECT version_id, family, term, {sql_word_count('text')} AS words, {sql_count_of('text', 'term')} AS uses,
    round({sql_count_of('text', 'term')} * 10000.0::DOUBLE / greatest(1, {sql_word_count('text')}), 2) AS rate FROM joined CROSS JOIN terms)
"""


@query("term_rates", f"WITH {SQL_TERMS} SELECT version_id, family, term, words, uses, rate FROM rates")
def term_rates(spark, folder):
    return cross_country.term_rates(_termed_clauses(spark, folder), "version_id")


@query("specific_terms", f"""WITH {SQL_TERMS},
pooled AS (SELECT coalesce(country_code, 'INT') AS place, family, term, round(sum(uses) * 10000.0::DOUBLE / greatest(1, sum(words)), 2) AS rate
  FROM rates JOIN versions v ON v.id = version_id JOIN instruments i ON i.id = v.document_id GROUP BY ALL),
g AS (SELECT family, term, list_sort(list(place) FILTER (WHERE rate > 0)) AS used, list_sort(list(place) FILTER (WHERE rate = 0)) AS absent
  FROM pooled GROUP BY ALL)
SELECT family, term, array_to_string(used, ',') AS used_by, array_to_string(absent, ',') AS absent_from FROM g
WHERE len(used) > 0 AND len(absent) > 0""")
def specific_terms(spark, folder):
    """Terms used in some countries only; smoke alarms and sprinklers alternate by country."""
    rates = cross_country.term_rates(_termed_clauses(spark, folder), "version_id")
    places = library_versions(spark, folder).select(
        F.col("id").alias("version_id"), F.col("document_id").alias("id")).join(
        library_documents(spark, folder).select("id", F.coalesce(
            "country_code", F.lit(fixed.DEFAULT_COUNTRY)).alias("place")), "id").drop("id")
    pooled = cross_country.pooled_rates(rates.join(places, "version_id"), "place")
    found = cross_country.specific_terms(pooled, "place")
    return found.select("family", "term", F.array_join("used_by", ",").alias("used_by"),
                        F.array_join("absent_from", ",").alias("absent_from"))


@query("study_json", ORACLES["jurisdiction_sizes"])
def study_json(spark, folder):
    """A study's result written as JSON lines and read back."""
    result, path = jurisdiction_sizes(spark, folder), scratch(spark, "study")
    write_study(result, path)
    return spark.read.schema(result.schema).json(path)
