"""Registers whose instructions stand between the lines of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.base import documents, query
from clauseloom import fixed
from clauseloom.functions.text import let
from clauseloom.operators import register
from clauseloom.session import fan_out


def interleaved_booklets(spark: SparkSession, folder: str) -> DataFrame:
    """Behind each line but every seventh an instruction; numbers recur, so references do.

    Odd booklets have no list heading, so all of their text is read and no volume is known.
    """
    def written(line, i):
        turn = F.floor(i / 7) % 3
        k, letter = (turn + 1).cast("string"), F.char(65 + turn)

        def noted(prose):
            instructions = [
                F.concat(F.lit(" Paragraph "), k, F.lit(".4, delete the second sentence.")),
                F.concat(F.lit(" Replace Tables "), letter, F.lit("1, "), letter, F.lit("2 as follows.")),
                F.concat(F.lit(" Delete paragraphs B1 to B6"), k, F.lit(".")),
                F.concat(F.lit(" In Appendix "), letter, F.lit(" where it says "), prose, F.lit(" today, add\nthe following.")),
                F.concat(F.lit(" After paragraph "), k, F.lit(".7, insert the following.")),
                F.concat(F.lit(" Amend Section "), k, F.lit(" to read as follows."))]
            chosen = F
            for t, instruction in enumerate(instructions):
                chosen = chosen.when(i % 7 == t, instruction)
            return F.concat(F.lit("Note "), prose, F.lit("."), chosen.otherwise(F.lit("")))

        return let(F.btrim(F.regexp_replace(F.lower(line), "[^a-z]+", " ")), noted)

    body = F.array_join(F.transform(F.split("text", "\n"), written), "\n")
    heading = F.when(F.col("doc_id") % 2 == 0, "Volume 1 – Dwellings\nList of amendments\n").otherwise("")
    # long and short texts in turn to all tasks, however the files are cut
    return fan_out(documents(spark, folder, "doc_id", "text")).select(
        F.col("doc_id").alias("booklet"), F.concat(heading, body).alias("text"))


SQL_INTERLEAVED = f"""
told AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
made AS (SELECT doc_id, i, i % 7 AS t, i // 7 % 3 + 1 AS k, chr(CAST(65 + i // 7 % 3 AS INTEGER)) AS l,
    trim(regexp_replace(lower(line), '[^a-z]+', ' ', 'g')) AS prose FROM told),
said AS (SELECT doc_id, i, regexp_replace(CASE t WHEN 0 THEN 'Paragraph ' || k || '.4, delete the second sentence.'
      WHEN 1 THEN 'Replace Tables ' || l || '1, ' || l || '2 as follows.'
      WHEN 2 THEN 'Delete paragraphs B1 to B6' || k || '.'
      WHEN 3 THEN 'In Appendix ' || l || ' where it says ' || prose || ' today, add the following.'
      WHEN 4 THEN 'After paragraph ' || k || '.7, insert the following.'
      ELSE 'Amend Section ' || k || ' to read as follows.' END, ' +', ' ', 'g') AS instruction,
    CASE t WHEN 1 THEN 'replace' WHEN 0 THEN 'delete' WHEN 2 THEN 'delete' WHEN 5 THEN '{fixed.OPERATION_ALIASES["amend"]}'
      ELSE 'insert' END AS operation,
    CASE t WHEN 0 THEN [k || '.4'] WHEN 1 THEN ['Table ' || l || '1', 'Table ' || l || '2']
      WHEN 2 THEN list_transform(range(1, 61 + k), lambda n: 'B' || n) WHEN 3 THEN ['Appendix ' || l]
      WHEN 4 THEN [k || '.7'] ELSE ['Section ' || k] END AS named FROM made WHERE t < 6),
mentions AS (SELECT doc_id AS booklet, CASE WHEN doc_id % 2 = 0 THEN 1 END AS volume, i, operation, instruction,
    unnest(named) AS reference FROM said)
"""


@query("register_between_lines", f"""WITH {SQL_INTERLEAVED}
SELECT booklet, volume, reference, operation, arg_min(instruction, i) AS instruction FROM mentions
GROUP BY booklet, volume, reference, operation""")
def register_between_lines(spark, folder):
    """Commas, ranges of over sixty, long gaps, verbs behind the place; the first mention stays."""
    return register.parse_booklets(interleaved_booklets(spark, folder)).select(
        "booklet", "volume", "reference", "operation", "instruction")


@query("mentions_by_operation", f"""WITH {SQL_INTERLEAVED}
SELECT booklet, operation, count(DISTINCT reference) AS clauses FROM mentions GROUP BY ALL""")
def mentions_by_operation(spark, folder):
    """How many clauses each booklet amends by each operation."""
    return register_between_lines(spark, folder).groupBy("booklet", "operation").agg(
        F.countDistinct("reference").alias("clauses"))
