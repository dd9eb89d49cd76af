"""Keyword search over the whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom import fixed
from clauseloom.functions.markup import excerpt
from clauseloom.sources.library import _country, country_name, default_level, default_ordinal


def search(term: str, documents: DataFrame, versions: DataFrame, clauses: DataFrame,
           country: str | None = None, version_ids: list[int] | None = None,
           limit: int | None = None) -> DataFrame:
    """Clauses whose text, title, section or number mentions the term.

    ``%`` and ``_`` in the term are wildcards.  The filter runs on the clause scan,
    before the joins.  All hits come out, unordered, unless a limit asks for the first
    ones; that is a top-n, so nothing is sorted as a whole.
    """
    needle = term.strip()
    hit = F.lit(False)
    for field in ("content", "title", "section", "clause_number"):
        hit = hit | F.coalesce(F.col(field).ilike(f"%{needle}%"), F.lit(False))
    found = clauses.filter(hit) if len(needle) >= fixed.TERM_MIN_CHARS else clauses.limit(0)
    if version_ids:
        found = found.filter(F.col("version_id").isin(version_ids))
    if country:
        documents = documents.filter(F.col("country_code") == country)
    owners = versions.select(F.col("id").alias("version_id"), "version_label", "document_id").join(
        documents.select(F.col("id").alias("document_id"), F.col("name").alias("document_name"),
                         "country_code"), "document_id")
    hits = found.join(owners, "version_id")
    if limit is not None:
        hits = hits.orderBy("country_code", "document_name", "ordinal", "id").limit(limit)
    return (
        hits.select("id", "clause_number", "title", "content", "section",
                default_level().alias("level"), default_ordinal().alias("ordinal"),
                "version_id", "version_label", "document_id", "document_name",
                country_name(F.col("country_code")).alias("country_name"),
                _country().alias("country_code"), excerpt(F.col("content"), needle)
                .alias("excerpt")))
