"""Substring search by an index of letter triples.

``postings`` lists which clause holds which three characters in a row.  A term can only
occur where all its triples do, so a search reads the postings of those few triples, which
lie together in the sorted table, and looks at the clauses that have all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom import fixed
from clauseloom.operators.search import search

FIELDS = ("content", "title", "section", "clause_number")
GRAM = 3


#: Every three characters in a row, found where the match before began and one further; a
#: match may not begin within a pair of surrogates.
_TRIPLES = r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TRIPLES), F.lit(1))


def postings(clauses: DataFrame) -> DataFrame:
    """(gram, id) of every clause, once each; fields are not joined, so no gram spans two."""
    grams = F.array_distinct(F.concat(*[_grams(F.col(f)) for f in FIELDS]))
    return clauses.select("id", F.explode(grams).alias("gram")).select("gram", "id")


def write_postings(clauses: DataFrame, path: str) -> None:
    """The postings sorted by gram in every file, so that a lookup skips most row groups.

    They are dealt by a hash of gram and id: ranges would need a sample, for which all grams
    would be taken twice, and a gram that every clause holds is in no task whole.
    """
    rows = postings(clauses)
    width = int(clauses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(width, "gram", "id").sortWithinPartitions("gram", "id").write.mode(
        "overwrite").parquet(path)


def term_grams(term: str) -> list[str]:
    """The triples that every hit holds: those of the fixed pieces between wildcards.

    Pieces are cut at characters outside ASCII too, whose lower case two systems may
    write differently.
    """
    pieces = re.split(r"\\.|[%_\\]|[^\x00-\x7f]", term.strip().lower())
    return sorted({p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def indexed_search(term: str, index: DataFrame, documents: DataFrame, versions: DataFrame,
                   clauses: DataFrame, **options) -> DataFrame:
    """What ``search`` finds, with the clauses narrowed by the index first.

    A term without three fixed characters in a row is searched for in all clauses.
    """
    grams = term_grams(term)
    if grams and len(term.strip()) >= fixed.TERM_MIN_CHARS:
        held = index.filter(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n"))
        clauses = clauses.join(held.filter(F.col("n") == len(grams)).select("id"), "id", "left_semi")
    return search(term, documents, versions, clauses, **options)
