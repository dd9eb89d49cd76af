"""Registry of checked queries, table loading, and SQL fragments shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseloom.functions import text as tx
from clauseloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    return frame.select(*columns) if columns else frame


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return scratch_path(spark, name)


# -- SQL fragments -----------------------------------------------------------

SPACE = tx.SPACE_CLASS
TRIM = tx.SPACES
WORD = tx.WORD.replace("'", "''")
TOKEN = tx.TOKEN.replace("'", "''")


def sql_strip(value: str) -> str:
    return f"trim({value}, '{TRIM}')"


def sql_tokens(value: str) -> str:
    return f"regexp_extract_all({value}, '{TOKEN}')"


def sql_token_count(value: str) -> str:
    return f"CAST(len(regexp_extract_all({value}, '{WORD}')) AS BIGINT)"


def sql_token_set(value: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({value}), '{WORD}'))"


def sql_jaccard(a: str, b: str) -> str:
    """Of two distinct lists."""
    shared = f"CAST(len(list_intersect({a}, {b})) AS DOUBLE)"
    return (f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared} / "
            f"(len({a}) + len({b}) - {shared}) ELSE 0.0 END")


def sql_words(value: str) -> str:
    return (f"list_filter(regexp_split_to_array({value}, '[{SPACE}]+'), "
            "lambda w: w <> '')")


def sql_word_count(value: str) -> str:
    return f"CAST(len({sql_words(value)}) AS BIGINT)"


def sql_redline_counts(source: str, a: str, b: str, out: str) -> str:
    """Words removed, added and kept where one text is a beginning of the other.

    ``source`` has both texts and their word counts w1 and w2.
    """
    return f"""
{out} AS (SELECT *, greatest(w1 - w2, 0) AS words_removed, greatest(w2 - w1, 0) AS words_added,
    CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE least(w1, w2) END AS words_unchanged FROM {source})
"""


def sql_letter_vectors(source: str, key: str, text: str) -> str:
    """CTEs that end in ``encoded`` (key, vector): letter counts of chunks, pooled per text."""
    return f"""
worded AS (SELECT {key} AS key, {text} AS body, {sql_words(text)} AS w FROM {source}),
chunked AS (SELECT key, CASE WHEN len(w) = 0 THEN [''] WHEN len(w) <= 220 THEN [body]
    ELSE list_transform(range(0, len(w), 180), lambda s: array_to_string(w[s + 1:s + 220], ' ')) END AS parts FROM worded),
chunks AS (SELECT key, lower(unnest(parts)) AS chunk, generate_subscripts(parts, 1) AS part FROM chunked),
letters AS (SELECT chr(97 + CAST(i AS INTEGER)) AS letter FROM range(26) r(i)),
counts AS (SELECT key, part, letter, CAST(length(chunk) - length(replace(chunk, letter, '')) AS DOUBLE) AS n
  FROM chunks CROSS JOIN letters),
part_units AS (SELECT key, letter, CASE WHEN sum(n * n) OVER p > 0 THEN n / sqrt(sum(n * n) OVER p) ELSE n END AS x
  FROM counts WINDOW p AS (PARTITION BY key, part)),
sums AS (SELECT key, letter, sum(x) AS x FROM part_units GROUP BY ALL),
encoded AS MATERIALIZED (SELECT key, list(x ORDER BY letter) AS vector FROM (SELECT key, letter,
    CASE WHEN sum(x * x) OVER d > 0 THEN x / sqrt(sum(x * x) OVER d) ELSE x END AS x
  FROM sums WINDOW d AS (PARTITION BY key)) GROUP BY key)
"""


def sql_escape(value: str) -> str:
    return f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def sql_count_of(value: str, phrase: str) -> str:
    return f"CAST((length({value}) - length(replace({value}, {phrase}, ''))) / length({phrase}) AS BIGINT)"


def sql_f1(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    """Rounded precision, recall and F1."""
    p = f"(CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / ({tp} + {fp}) END)"
    r = f"(CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / ({tp} + {fn}) END)"
    f = f"(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2.0 * {p} * {r} / ({p} + {r}) END)"
    return f"round({p}, 4)", f"round({r}, 4)", f"round({f}, 4)"


def sql_describe(source: str, value: str, by: str) -> str:
    """EV-style summary of a column, as a SELECT."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}count({value}) AS count, round(avg({value}) + 1e-12, 4) AS mean,
      round(min({value}), 4) AS min, round(quantile_cont({value}, 0.25) + 1e-12, 4) AS p25,
      round(quantile_cont({value}, 0.5) + 1e-12, 4) AS median,
      round(quantile_cont({value}, 0.75) + 1e-12, 4) AS p75, round(max({value}), 4) AS max
    FROM {source} WHERE {value} IS NOT NULL {group}"""
