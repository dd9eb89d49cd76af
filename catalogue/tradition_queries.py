"""Every numbering tradition, its noise lines included; pairs by meaning; the unified view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogue.base import documents, query, sql_escape, sql_strip
from catalogue.compare_queries import SQL_MARKED, SQL_SEMANTIC_PAIRS, SQL_SIDES, _edition_pairs
from catalogue.fixtures import vector_sides
from catalogue.parse_queries import SQL_MERGED
from clauseloom import fixed, grammar
from clauseloom.operators import align, parse, redline
from clauseloom.plans import cross_country

# -- documents in each tradition ---------------------------------------------

#: What stands before the lines of a tradition in turn; # is a number, @ a letter.  The
#: first always opens a clause; noise is one of the rest where the publisher has any.
LEADS = {
    "approved_document": ["Requirement B# ", "#.2 ", "", "Appendix @: ", "Fire safety Volume # ", "Diagram #.4 ",
                          "B# ", "Section 1#. ", "", "Approved Document B, Volume 2 "],
    "technical_handbook": ["Standard 2.# ", "#.1# ", "", "Annex #.A ", "Scottish Government ", "Figure @# ",
                           "# Fire ", "#.1.2 ", "", "Non-domestic Technical Handbook "],
    "technical_booklet": ["Part @: ", "#.3 ", "", "E1# ", "Technical Booklet @ ", "Table # ", "Section # ", "", "E# ", "(b) "],
    "technical_guidance": ["Appendix @ ", "Paragraph #.1 ", "", "B# ", "Technical Guidance Document B ",
                           "Diagram # ", "#.2 ", "", "paragraph #.3 ", "#.1.1.1 "],
    "british_standard": ["Annex @ ", "@.# ", "", "Clause #.2 ", "BS 9999:201# ", "Table @.# ", "# ", "", "© The BSI ", "@.#.1 "],
    "generic": ["Article # ", "#.2 ", "", "1#. ", "Part 2.# ", "FIGURE #.1 ", "section # ", "", "2) ", "clause 1#.1 "],
}
_NAMES = list(LEADS)
_PERIOD = len(LEADS["generic"])


def tradition_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, numbered in the traditions in turn; noise before some lines, and alone."""
    leads = F.array(*[F.array(*[F.lit(lead) for lead in LEADS[name]]) for name in _NAMES])
    number = F.get(F.array(*[F.lit(name) for name in _NAMES]), (F.col("doc_id") % len(_NAMES)).cast("int"))

    def led(line: Column, i: Column) -> Column:
        lead = F.get(F.get(leads, (F.col("doc_id") % len(_NAMES)).cast("int")), (i % _PERIOD).cast("int"))
        turn = F.floor(i / _PERIOD)
        return F.concat(F.replace(F.replace(lead, F.lit("#"), (turn % 5 + 1).cast("string")),
                                  F.lit("@"), F.char(65 + turn % 26)), line)

    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", number.alias("profile"),
        F.array_join(F.transform(F.split("text", "\n"), led), "\n").alias("text"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _reads(pattern: str) -> str:
    """In RE2, which has no look-ahead: the next character is read with the match."""
    return _quoted(pattern.replace("(?=", "(?:"))


def _drops(pattern: str) -> str:
    """The match alone, without what a look-ahead asks for."""
    return _quoted(pattern.split("(?=")[0])


_RULES = list(dict.fromkeys(rule for name in _NAMES for rule in grammar.PROFILES[name]["rules"]))


def _per_rule(value) -> str:
    return "CASE rule " + " ".join(f"WHEN {n} THEN {value(*rule)}" for n, rule in enumerate(_RULES)) + " END"


_LEAD_LISTS = "[" + ", ".join("[" + ", ".join(map(_quoted, LEADS[name])) + "]" for name in _NAMES) + "]"
_NAME_LIST = "[" + ", ".join(map(_quoted, _NAMES)) + "]"
_IS_NOISE = "CASE profile " + " ".join(
    f"WHEN '{name}' THEN " + " OR ".join(f"regexp_matches(line, {_quoted(p)})" for p in grammar.PROFILES[name]["noise"])
    for name in _NAMES if grammar.PROFILES[name]["noise"]) + " ELSE false END"
_RULE_OF = "CASE profile " + " ".join(
    f"WHEN '{name}' THEN CASE " + " ".join(
        f"WHEN regexp_matches(line, {_reads(rule[0])}) THEN {_RULES.index(rule)}" for rule in grammar.PROFILES[name]["rules"])
    + " END" for name in _NAMES) + " END"

SQL_TRADITIONS = f"""
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
numbered AS MATERIALIZED (SELECT doc_id, {_NAME_LIST}[doc_id % {len(_NAMES)} + 1] AS profile, i AS pos,
    replace(replace({_LEAD_LISTS}[doc_id % {len(_NAMES)} + 1][i % {_PERIOD} + 1], '#', CAST(i // {_PERIOD} % 5 + 1 AS VARCHAR)),
      '@', chr(CAST(65 + i // {_PERIOD} % 26 AS INTEGER))) || line AS line FROM raw_lines),
content_lines AS MATERIALIZED (SELECT *, {_IS_NOISE} AS noise
  FROM (SELECT doc_id, profile, pos, {sql_strip('line')} AS line FROM numbered) WHERE line <> ''),
matched AS MATERIALIZED (SELECT *, {_RULE_OF} AS rule FROM content_lines WHERE NOT noise),
read_lines AS (SELECT *,
    {_per_rule(lambda p, l, h, prefix: f"{_quoted(prefix)} || regexp_extract(line, {_reads(p)}, 1)" if prefix
               else f"rtrim({sql_strip(f'regexp_extract(line, {_reads(p)}, 1)')}, '.')")} AS number,
    {_per_rule(lambda p, *_: sql_strip(f"regexp_replace(line, {_drops(p)}, '')"))} AS rest,
    {_per_rule(lambda p, level, heading, _: str(heading).lower())} AS heading,
    {_per_rule(lambda p, level, *_: str(level))} AS rule_level FROM matched),
markers AS MATERIALIZED (SELECT *, heading AND length(rest) <= {fixed.HEADING_MAX_CHARS} AS opens,
    CASE WHEN heading AND length(rest) > {fixed.HEADING_MAX_CHARS} THEN 2 ELSE rule_level END AS level FROM read_lines)
"""


@query("noise_lines", f"""WITH {SQL_TRADITIONS}
SELECT doc_id, profile, count(*) AS content_lines, count(*) FILTER (WHERE noise) AS noise_lines FROM content_lines GROUP BY ALL""")
def noise_lines(spark, folder):
    """Lines that are a publisher's running headers, in every tradition."""
    docs = tradition_documents(spark, folder)
    lines = docs.select("doc_id", "profile", F.explode(parse.content_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id", "profile").agg(
        F.count("*").alias("content_lines"),
        F.count_if(parse.is_noise(F.col("line"), F.col("profile"))).alias("noise_lines"))


@query("markers_by_tradition", f"""WITH {SQL_TRADITIONS}
SELECT doc_id, profile, number, level, opens, rest, count(*) AS n FROM markers WHERE rule IS NOT NULL GROUP BY ALL""")
def markers_by_tradition(spark, folder):
    """First matching rule of every line in all grammars, noise lines left out."""
    profile = F.col("profile")
    lines = F.filter(parse.content_lines(F.col("text")), lambda l: ~parse.is_noise(l, profile))
    marked = tradition_documents(spark, folder).select("doc_id", "profile", F.explode(F.transform(
        lines, lambda l: parse.line_marker(l, profile))).alias("m"))
    return marked.filter("m IS NOT NULL").select("doc_id", "profile", "m.*").groupBy(
        "doc_id", "profile", "number", "level", "opens", "rest").agg(F.count("*").alias("n"))


@query("parse_by_tradition", f"""WITH {SQL_TRADITIONS}, {SQL_MERGED}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY clause_no) - 1 AS INTEGER) AS ordinal,
  clause_number, title, content, section, level FROM shown""")
def parse_by_tradition(spark, folder):
    """The whole parse in every tradition, to numbered clauses in order."""
    return parse.parse_documents(tradition_documents(spark, folder), "doc_id")


# -- pairs by meaning --------------------------------------------------------

@query("pair_study_by_meaning", f"""WITH RECURSIVE {SQL_SEMANTIC_PAIRS},
named AS (SELECT *, (idx * side + comparison_id) % 17 AS clause_number FROM vectors),
sizes AS (SELECT comparison_id, count(*) FILTER (WHERE side = 1) AS clauses_left, count(*) FILTER (WHERE side = 2) AS clauses_right,
    count(DISTINCT clause_number) FILTER (WHERE side = 1) AS u1, count(DISTINCT clause_number) FILTER (WHERE side = 2) AS u2
  FROM named GROUP BY 1),
shared AS (SELECT a.comparison_id, count(DISTINCT a.clause_number) AS s FROM named a JOIN named b
  ON a.comparison_id = b.comparison_id AND a.clause_number = b.clause_number AND a.side = 1 AND b.side = 2 GROUP BY 1),
m AS (SELECT comparison_id, count(*) FILTER (WHERE index_v1 IS NOT NULL AND index_v2 IS NOT NULL) AS matched,
    count(*) FILTER (WHERE index_v2 IS NULL) AS unmatched_left, count(*) FILTER (WHERE index_v1 IS NULL) AS unmatched_right
  FROM semantic_pairs GROUP BY 1)
SELECT comparison_id, clauses_left, clauses_right, matched, unmatched_left, unmatched_right,
  round(CAST(coalesce(s, 0) AS DOUBLE) / least(u1, u2), 4) AS identifier_overlap,
  round(CAST(matched AS DOUBLE) / least(clauses_left, clauses_right), 4) AS match_rate
FROM sizes LEFT JOIN shared USING (comparison_id) JOIN m USING (comparison_id)""")
def pair_study_by_meaning(spark, folder):
    """The study of country pairs as it is meant: aligned by meaning, whatever the numbers share."""
    sides = vector_sides(spark, folder).withColumn(
        "clause_number", ((F.col("idx") * F.col("side") + F.col("comparison_id")) % 17).cast("string"))
    return cross_country.pair_study(sides, align.align_semantic(sides))


# -- unified view ------------------------------------------------------------

@query("redline_unified", f"""WITH {SQL_SIDES}, {SQL_MARKED}
SELECT id, CASE WHEN a IS NULL THEN '<ins class="rl-ins">' || {sql_escape('b')} || '</ins>'
    WHEN b IS NULL THEN '<del class="rl-del">' || {sql_escape('a')} || '</del>'
    WHEN length(b) > length(a) THEN {sql_escape('a')} || '<ins class="rl-ins">' || {sql_escape('substr(b, length(a) + 1)')} || '</ins>'
    WHEN length(b) < length(a) THEN {sql_escape('b')} || '<del class="rl-del">' || {sql_escape('substr(a, length(b) + 1)')} || '</del>'
    ELSE {sql_escape('a')} END AS html_unified FROM redlined""")
def redline_unified(spark, folder):
    """Both texts in one pane, what goes and what comes marked in place."""
    marked = redline.with_redline(_edition_pairs(spark, folder), by=["comparison_id", "id"])
    return marked.select("id", redline.public_redline(unified=True).alias("r")).select("id", "r.html_unified")
