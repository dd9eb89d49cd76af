"""Profile detection and clause splitting."""

from pyspark.sql import functions as F

from catalogue.base import SPACE, documents, query, sql_count_of, sql_strip, sql_words
from catalogue.fixtures import SQL_NUMBERED_LINES, numbered_documents
from clauseloom import fixed, grammar
from clauseloom.functions import text as tx
from clauseloom.operators import clean, parse

PROFILE = "approved_document"

# -- detection ---------------------------------------------------------------

TITLES = [
    "Approved Document B for use in England, Requirement B1",
    "Technical Handbook, a mandatory standard of the Scottish Ministers",
    "Technical Booklet E, Department of Finance and Personnel",
    "Technical Guidance Document B, Second Schedule, An Roinn",
    "British Standard BS 9999 (normative)",
    "Nothing that names its publisher",
]


def _titled(spark, folder):
    """A title page by doc_id and numbered lines for all but every sixth document."""
    d = F.col("doc_id")
    titles = F.array(*[F.lit(t) for t in TITLES])
    title = F.get(titles, (d % 6).cast("int"))
    docs = numbered_documents(spark, folder)
    plain = documents(spark, folder, "doc_id", F.col("text").alias("plain"))
    return docs.join(plain, "doc_id").select("doc_id", F.concat(
        title, F.lit("\n"), F.when(d % 4 == 0, F.col("plain")).otherwise(F.col("text"))).alias("text"))


_TITLE_LIST = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
_SCORED = [name for name in grammar.PROFILES if name != fixed.GENERIC]


def _signature_sql() -> str:
    return ", ".join(
        " + ".join(sql_count_of("low", f"'{p}'") for p in grammar.PROFILES[name]["signatures"])
        + f" AS sig_{name}" for name in _SCORED)


# Rules in RE2 form: the look-ahead becomes the next character.
RE2_RULES = {
    name: [(r"^(?i:Table|Diagram|Figure)\s+[\dA-Z]+(\.\d+)*\b" if "(?i:" in p and "\\dA-Z" in p
            else p.replace(r"(?=[A-Z(\"'\d])", r"[A-Z(\"''\d]").replace("(?=[A-Z])", "[A-Z]")
            .replace(r"(?=\S)", r"\S")) for p, *_ in profile["rules"]]
    for name, profile in grammar.PROFILES.items()
}


def _opens(line: str, name: str) -> str:
    rules = [r.replace("(?i:Table|Diagram|Figure)", "(?i:(Table|Diagram|Figure))")
             .replace(r"\s+[\dA-Z]+(\.\d+)*\b", r"\s+(?i:[\dA-Z]+)(\.\d+)*\b")
             for r in dict.fromkeys(RE2_RULES[name])]
    return "(" + " OR ".join(f"regexp_matches({line}, '{r}')" for r in rules) + ")"


SQL_SCORES = f"""
{SQL_NUMBERED_LINES},
texts AS MATERIALIZED (SELECT d.doc_id, {_TITLE_LIST}[d.doc_id % 6 + 1] || chr(10) ||
    CASE WHEN d.doc_id % 4 = 0 THEN d.text ELSE n.text END AS text
  FROM documents d JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
    FROM numbered GROUP BY doc_id) n ON n.doc_id = d.doc_id),
heads AS (SELECT doc_id, lower(text) AS low, text AS head FROM texts),
signatures AS (SELECT doc_id, {_signature_sql()} FROM heads),
head_lines AS (SELECT doc_id, {sql_strip('unnest(string_split(head, chr(10)))')} AS line FROM heads),
structures AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE {_opens('line', n)}) AS str_{n}" for n in _SCORED)}
  FROM head_lines WHERE line <> '' GROUP BY doc_id),
scores AS MATERIALIZED ({' UNION ALL '.join(
    f"SELECT doc_id, {rank} AS seq, '{n}' AS profile, CAST(sig_{n} AS BIGINT) AS signature, "
    f"CAST(str_{n} AS BIGINT) AS structure, CAST(sig_{n} * 10 + str_{n} * 0.5 AS DOUBLE) AS score "
    "FROM signatures JOIN structures USING (doc_id)" for rank, n in enumerate(_SCORED))}),
best AS (SELECT doc_id, sum(score) AS total, max(score) AS top,
    arg_max(profile, score * 1000 - seq * 0.01) AS profile FROM scores GROUP BY doc_id),
found AS (SELECT doc_id, CASE WHEN top > 0 THEN profile ELSE 'generic' END AS profile,
    CASE WHEN top > 0 THEN round(top / total, 3) ELSE 0.0 END AS confidence FROM best)
"""


@query("signature_and_structure_scores", f"""WITH {SQL_SCORES}
SELECT doc_id, profile, signature, structure FROM scores""")
def signature_and_structure_scores(spark, folder):
    head = F.col("text")
    lines = parse.content_lines(head)
    parts = F.array(*[F.struct(
        F.lit(name).alias("profile"),
        parse.signature_score(F.lower(head), name).alias("signature"),
        parse.structure_score(lines, name).alias("structure")) for name in _SCORED])
    return _titled(spark, folder).select("doc_id", F.explode(parts).alias("s")).select(
        "doc_id", "s.*")


@query("detect_profile", f"WITH {SQL_SCORES} SELECT doc_id, profile, confidence FROM found")
def detect_profile(spark, folder):
    return _titled(spark, folder).select("doc_id", parse.detected(F.col("text")).alias("p")).select(
        "doc_id", "p.profile", "p.confidence")


_PROFILE_OF = "map {'EW': 'approved_document', 'SC': 'technical_handbook', 'NI': 'technical_booklet', 'IE': 'technical_guidance', 'BSI': 'british_standard', 'INT': 'generic'}"
_COUNTRY_OF = "map {'approved_document': 'EW', 'technical_handbook': 'SC', 'technical_booklet': 'NI', 'technical_guidance': 'IE', 'british_standard': 'BSI'}"


@query("resolve_jurisdiction", f"""WITH {SQL_SCORES},
asked AS (SELECT *, upper(['AUTO', 'ew', 'SC', 'INT', 'FR', ''][(doc_id // 6) % 6 + 1]) AS code FROM found),
stated AS (SELECT *, CASE WHEN code = '' THEN 'AUTO' ELSE code END AS want,
  coalesce({_PROFILE_OF}[code], 'generic') AS own FROM asked)
SELECT doc_id, want = 'AUTO' AS country_detected,
  CASE WHEN want = 'AUTO' THEN profile ELSE own END AS profile,
  CASE WHEN want = 'AUTO' THEN coalesce({_COUNTRY_OF}[profile], 'INT') ELSE want END AS country_code,
  CASE WHEN want = 'AUTO' OR own = profile THEN confidence ELSE 0.0 END AS confidence FROM stated""")
def resolve_jurisdiction(spark, folder):
    codes = F.array(*[F.lit(c) for c in ("AUTO", "ew", "SC", "INT", "FR", "")])
    docs = _titled(spark, folder).withColumn("country_code", F.get(
        codes, (F.floor(F.col("doc_id") / 6) % 6).cast("int")))
    return parse.resolve(docs).select("doc_id", "country_detected", "profile", "country_code",
                                      "confidence")


# -- splitting ---------------------------------------------------------------

LIST_ITEM = r"^(\(?[a-z]\)|\(?[ivx]{1,4}\)|\d{1,2}\))\s+\S"
NOISE = r"(?i)^(Approved Document B,? Volume \d|Fire safety:? Volume)"

SQL_MARKERS = f"""
{SQL_NUMBERED_LINES},
content_lines AS (SELECT doc_id, pos, {sql_strip('line')} AS line FROM numbered),
kept_lines AS (SELECT * FROM content_lines WHERE line <> '' AND NOT regexp_matches(line, '{NOISE}')),
matched AS (SELECT *,
    CASE WHEN regexp_matches(line, '^Section\\s+\\d{{1,2}}\\b') THEN 'section'
      WHEN regexp_matches(line, '^\\d{{1,2}}(\\.\\d{{1,3}}){{1,4}}\\s+[A-Z(\\"''\\d]')
        OR regexp_matches(line, '^\\d{{1,2}}(\\.\\d{{1,3}}){{1,4}}\\s*$') THEN 'number'
      WHEN regexp_matches(line, '(?i)^Table\\s+[\\dA-Z]+(\\.\\d+)*\\b') THEN 'table' END AS rule
  FROM kept_lines),
read_lines AS (SELECT *, CASE rule
    WHEN 'section' THEN 'Section ' || regexp_extract(line, '^Section\\s+(\\d{{1,2}})\\b', 1)
    WHEN 'number' THEN regexp_extract(line, '^(\\d{{1,2}}(\\.\\d{{1,3}}){{1,4}})', 1)
    WHEN 'table' THEN 'Table ' || regexp_extract(line, '(?i)^Table\\s+([\\dA-Z]+(\\.\\d+)*)\\b', 1) END AS number,
    CASE rule WHEN 'section' THEN {sql_strip("regexp_replace(line, '^Section\\s+\\d{1,2}\\b[:.]?\\s*', '')")}
    WHEN 'number' THEN {sql_strip("regexp_replace(line, '^\\d{1,2}(\\.\\d{1,3}){1,4}\\s*', '')")}
    WHEN 'table' THEN {sql_strip("regexp_replace(line, '(?i)^Table\\s+[\\dA-Z]+(\\.\\d+)*\\b', '')")} END AS rest
  FROM matched),
markers AS MATERIALIZED (SELECT *, rule = 'section' AND length(rest) <= 90 AS opens,
    CASE rule WHEN 'section' THEN CASE WHEN length(rest) <= 90 THEN 1 ELSE 2 END
      WHEN 'number' THEN 2 WHEN 'table' THEN 3 END AS level FROM read_lines)
"""


@query("line_markers", f"""WITH {SQL_MARKERS}
SELECT doc_id, number, level, opens, rest, count(*) AS n FROM markers WHERE rule IS NOT NULL
GROUP BY ALL""")
def line_markers(spark, folder):
    """First matching rule of every line; over-long headings are demoted."""
    profile = F.lit(PROFILE)
    lines = F.filter(parse.content_lines(F.col("text")), lambda l: ~parse.is_noise(l, profile))
    marked = numbered_documents(spark, folder).select("doc_id", F.explode(F.transform(
        lines, lambda l: parse.line_marker(l, profile))).alias("m"))
    return marked.filter("m IS NOT NULL").select("doc_id", "m.*").groupBy(
        "doc_id", "number", "level", "opens", "rest").agg(F.count("*").alias("n"))


def sql_reflow(value: str) -> str:
    squeezed = f"regexp_replace({value}, ' +', ' ', 'g')"
    return sql_strip(f"ltrim({sql_strip(f'''regexp_replace({squeezed}, '[{SPACE}]*\\n[{SPACE}]*', chr(10), 'g')''')}, ':-–— ')")


SQL_SEGMENTS = f"""
tracked AS (SELECT *, count(rule) OVER w AS clause_no,
    last_value(CASE WHEN opens THEN {sql_strip("number || ' ' || rest")} END IGNORE NULLS) OVER w AS section
  FROM markers WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
parts AS (SELECT *, CASE WHEN rule IS NULL THEN line ELSE rest END AS part,
    row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY pos) AS nth FROM tracked),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY pos) AS place
  FROM parts WHERE part <> ''),
bodies AS (SELECT doc_id, clause_no, string_agg(CASE WHEN place > 1 AND regexp_matches(part, '{LIST_ITEM}')
    THEN chr(10) || part ELSE part END, ' ' ORDER BY pos) AS body FROM filled GROUP BY ALL),
heads AS (SELECT doc_id, clause_no, number, level, section FROM tracked WHERE rule IS NOT NULL),
segments AS MATERIALIZED (
  SELECT h.doc_id, h.clause_no, h.number AS clause_number, h.level, h.section,
    coalesce({sql_reflow('b.body')}, '') AS content
  FROM heads h LEFT JOIN bodies b USING (doc_id, clause_no)
  UNION ALL
  SELECT doc_id, 0, '0', 1, NULL, {sql_reflow('body')} FROM bodies
  WHERE clause_no = 0 AND length({sql_reflow('body')}) >= 60
    AND doc_id IN (SELECT doc_id FROM heads)
  UNION ALL
  SELECT doc_id, 1, '1', 1, NULL, {sql_strip("string_agg(line, chr(10) ORDER BY pos)")} FROM numbered
  WHERE doc_id NOT IN (SELECT doc_id FROM heads) GROUP BY doc_id)
"""

IS_HEADING = (f"length(head) BETWEEN 3 AND 80 AND NOT regexp_matches(head, '[.,;:]$') "
              f"AND NOT regexp_matches(head, '{LIST_ITEM}') AND len({sql_words('head')}) <= 10 "
              "AND (regexp_matches(head, '^\\p{Lu}') OR (regexp_matches(head, '\\p{Lu}') "
              "AND NOT regexp_matches(head, '[\\p{Ll}\\p{Lt}]')))")

SQL_TITLED = f"""
{SQL_SEGMENTS},
headed AS (SELECT *, {sql_strip("string_split(content, chr(10))[1]")} AS head,
    CASE WHEN position(chr(10) IN content) > 0 THEN substr(content, position(chr(10) IN content) + 1)
      ELSE '' END AS tail FROM segments),
titled AS MATERIALIZED (SELECT doc_id, clause_no, clause_number, level, section,
    CASE WHEN clause_number = '0' AND clause_no = 0 THEN 'Preamble'
      WHEN promoted THEN head END AS title,
    CASE WHEN promoted THEN {sql_strip('tail')} ELSE content END AS content
  FROM (SELECT *, clause_no > 0 AND doc_id IN (SELECT doc_id FROM heads) AND tail <> '' AND {IS_HEADING}
    AS promoted FROM headed))
"""

SQL_MERGED = f"""
{SQL_TITLED},
keeps AS (SELECT *, level <= 1 OR length(content) >= 60
    OR row_number() OVER (PARTITION BY doc_id ORDER BY clause_no) = 1 AS keep FROM titled),
runs AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id
    ORDER BY clause_no ROWS UNBOUNDED PRECEDING) AS run FROM keeps),
folded AS (SELECT doc_id, run, {sql_strip("string_agg(CASE WHEN keep THEN content ELSE " + sql_strip("clause_number || ' ' || content") + " END, chr(10) ORDER BY clause_no)")} AS content
  FROM runs GROUP BY ALL),
merged AS MATERIALIZED (SELECT r.doc_id, r.clause_no, r.clause_number, r.level, r.section, r.title, f.content
  FROM runs r JOIN folded f USING (doc_id, run) WHERE r.keep AND (f.content <> '' OR r.level <= 1)),
shown AS (SELECT * FROM merged WHERE NOT (level <= 1 AND NOT regexp_matches(content, '[.!?]([{SPACE}]|$)')
    AND len({sql_words('content')}) <= 40))
"""


def _array(spark, folder, build):
    """Clauses of the numbered documents after ``build`` of the in-row steps."""
    profile = F.lit(PROFILE)

    def steps(lines):
        return tx.let(F.transform(lines, lambda l: parse.line_marker(l, profile)),
                      lambda marks: build(lines, marks))

    lines = F.filter(parse.content_lines(F.col("text")), lambda l: ~parse.is_noise(l, profile))
    return numbered_documents(spark, folder).select(
        "doc_id", F.explode(tx.let(lines, steps)).alias("c")).select("doc_id", "c.*")


@query("segment_clauses", f"""WITH {SQL_MARKERS}, {SQL_TITLED}
SELECT doc_id, clause_number, level, section, title, content, count(*) AS n FROM titled GROUP BY ALL""")
def segment_clauses(spark, folder):
    """Clauses between markers: sections inherited, lines reflowed, titles and preamble."""
    clauses = _array(spark, folder, lambda lines, marks: parse.segmented(
        lines, marks, F.col("text")))
    return clauses.groupBy("doc_id", "clause_number", "level", "section", "title", "content").agg(
        F.count("*").alias("n"))


@query("merge_fragments", f"""WITH {SQL_MARKERS}, {SQL_MERGED}
SELECT doc_id, clause_number, level, content, count(*) AS n FROM merged GROUP BY ALL""")
def merge_fragments(spark, folder):
    clauses = _array(spark, folder, lambda lines, marks: tx.let(parse.segmented(
        lines, marks, F.col("text")), parse.merged))
    return clauses.groupBy("doc_id", "clause_number", "level", "content").agg(
        F.count("*").alias("n"))


@query("parse_clauses", f"""WITH {SQL_MARKERS}, {SQL_MERGED}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY clause_no) - 1 AS INTEGER) AS ordinal,
  clause_number, title, content, section, level FROM shown""")
def parse_clauses(spark, folder):
    """The whole parse, to numbered clauses in order."""
    docs = numbered_documents(spark, folder).withColumn("profile", F.lit(PROFILE))
    return parse.parse_documents(docs, "doc_id")


@query("parse_summary", f"""WITH {SQL_MARKERS}, {SQL_MERGED}
SELECT doc_id, count(*) AS clauses, count(DISTINCT nullif(section, '')) AS sections,
  list_sort(list(length(content)))[count(*) // 2 + 1] AS median_chars FROM shown GROUP BY doc_id""")
def parse_summary(spark, folder):
    return parse.parse_summary(parse_clauses(spark, folder), "doc_id")


@query("parse_list_markers", f"""
WITH lines AS (SELECT doc_id, i AS pos, CASE WHEN (i - 1) % 5 = 1 THEN '(' || chr(97 + CAST(((i - 1) // 5) % 26 AS INTEGER)) || ') ' || s
    ELSE s END AS line FROM (SELECT doc_id, {sql_strip('unnest(string_split(text, chr(10)))')} AS s,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE s <> ''),
tracked AS (SELECT *, regexp_matches(line, '{LIST_ITEM}') AS item,
    sum(CASE WHEN regexp_matches(line, '{LIST_ITEM}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS UNBOUNDED PRECEDING) AS clause_no FROM lines),
bodies AS (SELECT doc_id, clause_no, max(CASE WHEN item THEN trim(regexp_extract(line, '^\\S+'), '().') END) AS number,
    {sql_reflow("string_agg(CASE WHEN item THEN " + sql_strip("regexp_replace(line, '^\\S+', '')") + " ELSE line END, ' ' ORDER BY pos)")} AS content
  FROM tracked GROUP BY ALL),
listed AS (SELECT *, max(clause_no) OVER (PARTITION BY doc_id) AS items FROM bodies),
kept AS (SELECT doc_id, clause_no, number, content, 3 AS level FROM listed WHERE clause_no > 0
  UNION ALL SELECT doc_id, 0, '0', content, 1 FROM listed WHERE clause_no = 0 AND items > 0 AND length(content) >= 60
  UNION ALL SELECT doc_id, 0, '1', {sql_strip("string_agg(line, chr(10) ORDER BY pos)")}, 1 FROM tracked
    WHERE doc_id IN (SELECT doc_id FROM listed WHERE items = 0) GROUP BY doc_id),
runs AS (SELECT *, sum(CASE WHEN level <= 1 OR length(content) >= 60 OR first THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY clause_no ROWS UNBOUNDED PRECEDING) AS run,
    level <= 1 OR length(content) >= 60 OR first AS keep
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY clause_no) = 1 AS first FROM kept)),
folded AS (SELECT doc_id, run, max(CASE WHEN keep THEN number END) AS clause_number,
    max(CASE WHEN keep THEN level END) AS level,
    {sql_strip("string_agg(CASE WHEN keep THEN content ELSE number || ' ' || content END, chr(10) ORDER BY clause_no)")} AS content
  FROM runs GROUP BY ALL)
SELECT doc_id, clause_number, content, count(*) AS n FROM folded
WHERE NOT (level <= 1 AND NOT regexp_matches(content, '[.!?]([{SPACE}]|$)') AND len({sql_words('content')}) <= 40)
GROUP BY ALL""")
def parse_list_markers(spark, folder):
    """Documents without numbers fall back to list markers, then to one clause."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(
        (i % 5 == 1) & (tx.strip(l) != ""), F.concat(F.lit("("), F.char(97 + F.floor(i / 5) % 26), F.lit(") "), tx.strip(l)))
        .otherwise(l))
    docs = documents(spark, folder, "doc_id", "text").select(
        "doc_id", F.array_join(lines, "\n").alias("text"), F.lit("generic").alias("profile"))
    return parse.parse_documents(docs, "doc_id").groupBy(
        "doc_id", "clause_number", "content").agg(F.count("*").alias("n"))


@query("parse_every_profile")
def parse_every_profile(spark, folder):
    """Cleaning, detection and splitting of titled documents, counted per profile."""
    docs = clean.clean_documents(_titled(spark, folder)).withColumn("country_code", F.lit("AUTO"))
    return parse.parse_documents(parse.resolve(docs), "doc_id", "profile").groupBy("profile").agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("clauses"),
        F.sum(F.length("content")).alias("characters"))
