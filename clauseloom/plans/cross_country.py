"""What stands between the instruments of different countries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from clauseloom import fixed
from clauseloom.functions.text import let, occurrences, word_total
from clauseloom.operators import align, metrics


def pair_study(sides: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlap, matched and unmatched clauses, match rate, per comparison."""
    sizes = sides.groupBy("comparison_id").agg(
        F.count_if(F.col("side") == 1).alias("clauses_left"),
        F.count_if(F.col("side") == 2).alias("clauses_right"))
    left, right = F.col("index_v1").isNotNull(), F.col("index_v2").isNotNull()
    matched = pairs.groupBy("comparison_id").agg(
        F.count_if(left & right).alias("matched"), F.count_if(~right).alias("unmatched_left"),
        F.count_if(~left).alias("unmatched_right"))
    overlap = align.identifier_overlap(sides).withColumn(
        "identifier_overlap", F.round("identifier_overlap", 4))
    return (sizes.join(matched, "comparison_id").join(overlap, "comparison_id")
            .withColumn("match_rate", F.round(metrics.ratio(
                F.col("matched"), F.least("clauses_left", "clauses_right")), 4)))


def score_summary(pairs: DataFrame, score: str) -> DataFrame:
    """Distribution of ``match_score`` or ``embedding_score`` of the matched pairs."""
    both = F.col("index_v1").isNotNull() & F.col("index_v2").isNotNull()
    return metrics.describe(pairs.filter(both), score, "comparison_id")


def numbering_shapes(clauses: DataFrame, *by: str) -> DataFrame:
    """Clauses, distinct shapes and mean depth of the numbering."""
    shape = F.regexp_replace("clause_number", r"\d+", "N")
    depth = occurrences(F.col("clause_number"), F.lit(".")) + 1
    return clauses.groupBy(*by).agg(
        F.count("*").alias("clauses"), F.countDistinct(shape).alias("distinct_shapes"),
        F.round(F.avg(depth), 2).alias("mean_depth"))


def top_shapes(clauses: DataFrame, *by: str, limit: int = 5) -> DataFrame:
    counts = clauses.groupBy(*by, F.regexp_replace("clause_number", r"\d+", "N").alias("shape")) \
        .agg(F.count("*").alias("n"))
    return metrics.top(counts, limit, *by, name="shape")


def _terms() -> list[tuple[str, str]]:
    return [(family, term) for family, terms in fixed.TERM_FAMILIES.items() for term in terms]


def term_rates(clauses: DataFrame, *by: str) -> DataFrame:
    """Uses per 10,000 words of every term, over the clauses of a version in order.

    The texts count as joined by spaces, so a phrase may run on into following
    clauses.  Instead of joining them, every clause is counted together with just
    as many characters behind it as a phrase could still need, less the phrases
    that lie in those characters alone.  A phrase of w words touches at most w - 1
    following clauses.  ``by`` must include version_id, so a window is one version.
    """
    reach = max(len(term.split()) for _, term in _terms()) - 1
    order = Window.partitionBy(*by).orderBy("ordinal", "id")
    # an absent follower adds nothing, an empty one still adds its separator
    # of a follower no more is kept than a phrase could still need
    most = max(len(term) for _, term in _terms())
    following = [F.lead(F.concat(F.lit(" "), F.substring(F.lower("content"), 1, most)), n).over(order)
                 for n in range(1, reach + 1)]
    ahead = reduce(F.concat, [F.coalesce(f, F.lit("")) for f in following])
    texts = clauses.select(*by, F.lower("content").alias("_text"), ahead.alias("_ahead"))

    def uses(term: str):
        def counted(rest):
            return (occurrences(F.concat(F.col("_text"), rest), F.lit(term))
                    - occurrences(rest, F.lit(term)))

        # the longest stretch that cannot hold a phrase beginning in the next clause's far part
        return let(F.substring("_ahead", 1, len(term) - 1), counted)

    sums = texts.groupBy(*by).agg(
        F.sum(word_total(F.col("_text"))).alias("words"),
        *[F.sum(uses(term)).alias(f"_t{i}") for i, (_, term) in enumerate(_terms())])
    listed = F.array(*[F.struct(F.lit(family).alias("family"), F.lit(term).alias("term"),
                                F.col(f"_t{i}").alias("uses"))
                       for i, (family, term) in enumerate(_terms())])
    return sums.select(*by, "words", F.explode(listed).alias("t")).select(
        *by, "words", "t.*", F.round(F.col("t.uses") * 10000.0 / F.greatest(
            F.lit(1), F.col("words")), 2).alias("rate"))


def pooled_rates(rates: DataFrame, *by: str) -> DataFrame:
    """Rates of several versions put together, for instance per country."""
    return rates.groupBy(*by, "family", "term").agg(
        F.sum("words").alias("words"), F.sum("uses").alias("uses")).withColumn(
        "rate", F.round(F.col("uses") * 10000.0 / F.greatest(F.lit(1), F.col("words")), 2))


def specific_terms(rates: DataFrame, place: str = "country_code") -> DataFrame:
    """Terms some places use and others never do; ``place`` is a short list like the countries."""
    used = F.col("rate") > 0
    grouped = rates.groupBy("family", "term").agg(
        F.array_sort(F.collect_set(F.when(used, F.col(place)))).alias("used_by"),
        F.array_sort(F.collect_set(F.when(~used, F.col(place)))).alias("absent_from"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(place, "rate")))).alias("rates"))
    return grouped.filter((F.size("used_by") > 0) & (F.size("absent_from") > 0))


