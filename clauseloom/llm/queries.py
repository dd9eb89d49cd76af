"""The registered queries of this subpackage, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseloom.llm import collocations, conversation, exact, jaccard, lines, mixing, neighbours, packing, quality, sharding, simhash, suffix, tokenfile
from clauseloom.llm.store import new_path, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine and on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.repeat_digests(_table(spark, folder, "documents"))


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), words=3, distance=2)


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op4_source_mixing")
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op5_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_dedup(_table(spark, folder, "documents").select("doc_id", "text"), words=lines.WORDS)


@query("op6_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, folder, "embeddings"))


@query("op7_sharding")
def shard(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_key(_table(spark, folder, "documents"))


@query("op8_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_token_files(_table(spark, folder, "documents"), path,
                                tokenizer_path("byte_bpe_50k.json"), leading=True, end_id=2)
    return tokenfile.token_digests(spark, path)


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"),
                                  leading=False, end_id=0, capacity=2048)
    return packing.pack(pieces, capacity=2048)


@query("op10_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents),
w AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS place FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, folder, "documents"))


@query("op11_jaccard_join", """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM t),
n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
r AS (SELECT doc_id AS d, doc_id AS reached FROM n UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.reached)
SELECT doc_id, n_shingles, component_id FROM n JOIN (SELECT d AS doc_id, min(reached) AS component_id FROM r GROUP BY d)
USING (doc_id)""")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, folder, "documents"))


@query("op12_collocations", """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
      FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(g, ' ') AS g, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
h AS MATERIALIZED (SELECT lang, g, f, cut, array_to_string(w[1:cut], ' ') AS g1, array_to_string(w[cut + 1:k], ' ') AS g2
      FROM c, (VALUES (1), (2)) AS v(cut) WHERE cut < k),
l AS MATERIALIZED (SELECT h.*, f.f AS l FROM h JOIN f ON f.lang = h.lang AND f.g = g1),
s AS MATERIALIZED (SELECT l.*, f.f AS r, 1000000 * l.f * l.f // (l * f.f) AS score FROM l JOIN f ON f.lang = l.lang AND f.g = g2),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS place FROM s),
d AS (SELECT lang, g, max(f) AS longer FROM (
        SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM c WHERE k = 3)
      GROUP BY 1, 2),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, f DESC, b.g) AS rank,
             b.g AS phrase, f AS a, l, r, score
      FROM b LEFT JOIN d ON d.lang = b.lang AND d.g = b.g
      WHERE place = 1 AND (longer IS NULL OR 100 * longer < 50 * f))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000""")
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.repair_digests(conversation.repair(conversation.damage(_table(spark, folder, "conversations"))))
