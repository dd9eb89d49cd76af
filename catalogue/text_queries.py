"""Tokens, chunks, vectors and cleaning."""

from pyspark.sql import functions as F

from catalogue.base import (
    documents, query, sql_jaccard, sql_strip, sql_token_count, sql_token_set, sql_tokens,
    sql_word_count, sql_words, table,
)
from catalogue.fixtures import library_clauses, SQL_LIBRARY
from clauseloom.functions import text as tx
from clauseloom.operators import clean, embed


@query("tokenise", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '') = text AS lossless,
  CAST(len(list_filter(t, lambda x: {sql_strip('x')} = '')) AS BIGINT) AS n_spaces
FROM (SELECT doc_id, text, {sql_tokens('text')} AS t FROM documents)""")
def tokenise(spark, folder):
    tokens = documents(spark, folder, "doc_id", "text").withColumn("t", tx.tokens(F.col("text")))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                         (F.array_join("t", "") == F.col("text")).alias("lossless"),
                         F.size(F.filter("t", lambda x: tx.strip(x) == "")).cast("long")
                         .alias("n_spaces"))


@query("count_words", f"""
SELECT doc_id, {sql_token_count('text')} AS words, {sql_word_count('text')} AS spaced_words
FROM documents""")
def count_words(spark, folder):
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", tx.token_count(F.col("text")).alias("words"),
        tx.word_total(F.col("text")).alias("spaced_words"))


@query("lexical_similarity", f"""
WITH s AS (SELECT doc_id, {sql_token_set('text')} AS terms FROM documents)
SELECT a.doc_id, round({sql_jaccard('a.terms', 'b.terms')}, 9) AS similarity
FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def lexical_similarity(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(following, "doc_id").select("doc_id", F.round(tx.lexical_similarity(
        F.col("text"), F.col("other")), 9).alias("similarity"))


@query("alignment_text", f"""
WITH {SQL_LIBRARY}
SELECT id, {sql_strip("concat_ws(' ', nullif(section, ''), nullif(title, ''), nullif(content, ''))")}
  AS alignment_text FROM clauses""")
def alignment_text(spark, folder):
    return library_clauses(spark, folder).select("id", tx.alignment_text(
        F.col("section"), F.col("title"), F.col("content")).alias("alignment_text"))


SQL_CHUNKS = f"""
worded AS (SELECT doc_id, text, {sql_words('text')} AS w FROM documents),
chunked AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [''] WHEN len(w) <= 220 THEN [text]
    ELSE list_transform(range(0, len(w), 180),
      lambda s: array_to_string(w[s + 1:s + 220], ' ')) END AS parts FROM worded),
chunks AS (SELECT doc_id, unnest(parts) AS chunk, generate_subscripts(parts, 1) - 1 AS part
  FROM chunked)
"""


@query("chunk_text", f"WITH {SQL_CHUNKS} SELECT doc_id, CAST(part AS INTEGER) AS part, chunk FROM chunks")
def chunk_text(spark, folder):
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("part", "chunk"))


SQL_ENCODED = f"""
letters AS (SELECT unnest(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','))
  AS letter),
counts AS (SELECT doc_id, part, letter,
    CAST(length(lower(chunk)) - length(replace(lower(chunk), letter, '')) AS DOUBLE) AS n
  FROM chunks CROSS JOIN letters),
part_units AS (SELECT doc_id, letter, CASE WHEN sum(n * n) OVER p > 0
    THEN n / sqrt(sum(n * n) OVER p) ELSE n END AS x
  FROM counts WINDOW p AS (PARTITION BY doc_id, part)),
sums AS (SELECT doc_id, letter, sum(x) AS x FROM part_units GROUP BY ALL),
encoded AS MATERIALIZED (SELECT doc_id, list(x ORDER BY letter) AS vector FROM (
  SELECT doc_id, letter, CASE WHEN sum(x * x) OVER d > 0 THEN x / sqrt(sum(x * x) OVER d)
    ELSE x END AS x FROM sums WINDOW d AS (PARTITION BY doc_id)) GROUP BY doc_id)
"""


@query("encode_chunked", f"""
WITH {SQL_CHUNKS}, {SQL_ENCODED}
SELECT doc_id, unnest(list_transform(vector, lambda x: round(x, 6))) AS value,
  CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS dimension FROM encoded""")
def encode_chunked(spark, folder):
    vector = embed.encode_column(F.col("text"), embed.letter_profile)
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", F.posexplode(vector).alias("dimension", "value")).select(
        "doc_id", "dimension", F.round("value", 6).alias("value"))


@query("encode_as_rows", f"""
WITH {SQL_CHUNKS}, {SQL_ENCODED}
SELECT doc_id, round(list_inner_product(vector, list_transform(range(1, 27), lambda x: CAST(x AS DOUBLE))), 6)
  AS weighted FROM encoded""")
def encode_as_rows(spark, folder):
    """The frame path a model would take: chunks as rows, encoded, pooled per document."""
    from clauseloom.functions.vectors import dot

    encoder = lambda frame: frame.withColumn("vector", embed.letter_profile(F.col("chunk")))
    encoded = embed.encode_frame(documents(spark, folder, "doc_id", "text"), ["doc_id"],
                                 F.col("text"), encoder)
    weights = F.array(*[F.lit(float(i)) for i in range(1, 27)])
    return encoded.select("doc_id", F.round(dot(F.col("vector"), weights), 6).alias("weighted"))


def _letter_counts():
    """A model for the hook: what a worker loads once, and the function it runs on batches."""
    import numpy as np

    def predict(texts):
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts],
                        dtype=np.float32)

    return predict


@query("encode_model", f"""
WITH {SQL_CHUNKS}, {SQL_ENCODED}
SELECT doc_id, round(list_inner_product(vector, list_transform(range(1, 27), lambda x: CAST(x AS DOUBLE))), 6)
  AS weighted FROM encoded""")
def encode_model(spark, folder):
    """A model of the user's own, run on batches of chunks; its batches are pooled like any other's."""
    from clauseloom.functions.vectors import dot

    encoded = embed.encode_frame(documents(spark, folder, "doc_id", "text"), ["doc_id"],
                                 F.col("text"), embed.batch_model(_letter_counts))
    weights = F.array(*[F.lit(float(i)) for i in range(1, 27)])
    return encoded.select("doc_id", F.round(dot(F.col("vector"), weights), 6).alias("weighted"))


@query("encode_weighted_terms", f"""
WITH {SQL_CHUNKS},
terms AS (SELECT doc_id, part, unnest(list_filter({sql_tokens('lower(chunk)')}, lambda x: trim(x) <> '')) AS term FROM chunks),
weights AS (SELECT term, ln(((SELECT count(*) FROM chunks) + 1) / (count(DISTINCT doc_id || ':' || part) + 1)) AS weight
  FROM terms GROUP BY 1),
counted AS (SELECT doc_id, part, list_sum(list_transform(range(8), lambda i:
    (strpos('0123456789abcdef', substr(md5(term), i + 1, 1)) - 1) * CAST(pow(16, 7 - i) AS BIGINT))) % 64 AS dimension, weight
  FROM terms JOIN weights USING (term)),
summed AS (SELECT doc_id, part, dimension, sum(weight) AS x FROM counted GROUP BY ALL),
units AS (SELECT doc_id, dimension, CASE WHEN sum(x * x) OVER p > 0 THEN x / sqrt(sum(x * x) OVER p) ELSE x END AS x
  FROM summed WINDOW p AS (PARTITION BY doc_id, part)),
pooled AS (SELECT doc_id, dimension, sum(x) AS x FROM units GROUP BY ALL),
scaled AS (SELECT doc_id, dimension, CASE WHEN sum(x * x) OVER d > 0 THEN x / sqrt(sum(x * x) OVER d) ELSE x END AS x
  FROM pooled WINDOW d AS (PARTITION BY doc_id))
SELECT doc_id, CAST(dimension AS INTEGER) AS dimension, round(x, 5) AS value FROM scaled WHERE round(x, 5) <> 0""")
def encode_weighted_terms(spark, folder):
    """Terms weighted by how few chunks of the corpus hold them; the weights are fitted first."""
    docs = documents(spark, folder, "doc_id", "text")
    weights = embed.term_weights(docs.select(F.explode(tx.chunks(F.col("text"))).alias("chunk")))
    encoded = embed.encode_frame(docs, ["doc_id"], F.col("text"), embed.weighted_terms(weights))
    return encoded.select("doc_id", F.posexplode("vector").alias("dimension", "value")).select(
        "doc_id", "dimension", F.round("value", 5).alias("value")).filter("value <> 0")


@query("encode_hashed_terms", f"""
SELECT doc_id, 256 AS width, CASE WHEN {sql_token_count('text')} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""")
def encode_hashed_terms(spark, folder):
    from clauseloom.functions.vectors import dot

    encoded = embed.encode_frame(documents(spark, folder, "doc_id", "text"), ["doc_id"],
                                 F.col("text"), embed.hashed_terms(256))
    return encoded.select("doc_id", F.size("vector").alias("width"), F.round(
        dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


@query("pool_vectors", """
WITH dims AS (SELECT vec_id // 4 AS owner, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
    generate_subscripts(embedding, 1) - 1 AS dimension FROM embeddings),
sums AS (SELECT owner, dimension, sum(x) AS x FROM dims GROUP BY ALL)
SELECT owner, CAST(dimension AS INTEGER) AS dimension,
  round(CASE WHEN sum(x * x) OVER o > 0 THEN x / sqrt(sum(x * x) OVER o) ELSE x END, 6) AS value
FROM sums WINDOW o AS (PARTITION BY owner)""")
def pool_vectors(spark, folder):
    parts = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("owner"), F.col("vec_id").alias("part"),
        F.col("embedding").alias("vector"))
    return embed.pool(parts, ["owner"]).select(
        "owner", F.posexplode("vector").alias("dimension", "value")).select(
        "owner", "dimension", F.round("value", 6).alias("value"))


@query("cosine_neighbours", """
SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
  AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"),
                               F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(
        embed.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


# -- cleaning ----------------------------------------------------------------

LIGATURE, SQUARED, HALF = "ﬁ", "²", "½"


@query("clean_normalise", f"""
SELECT doc_id, replace(replace(replace(replace(replace(text, 'th', 'fi'), 'ing ', 'ing2 '), ', ', ', 1' || chr(8260) || '2 '),
  'e', 'e'), 'ou', 'o' || chr(252)) AS text FROM documents""")
def clean_normalise(spark, folder):
    """Ligatures, superscripts, fractions and a decomposed umlaut put in, then normalised."""
    text = F.replace(F.col("text"), F.lit("th"), F.lit(LIGATURE))
    text = F.replace(text, F.lit("ing "), F.lit("ing" + SQUARED + " "))
    text = F.replace(text, F.lit(", "), F.lit(", " + HALF + " "))
    text = F.replace(text, F.lit("ou"), F.lit("oü"))
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", clean.normalised(text).alias("text"))


@query("clean_characters", """
SELECT doc_id, replace(replace(replace(replace(text, 'the ', '"the" '), ', ', ' - '), '. ', '... '),
  'on ', 'on - x ') AS text FROM documents""")
def clean_characters(spark, folder):
    text = F.replace(F.col("text"), F.lit("the "), F.lit("“th­e” "))
    text = F.replace(text, F.lit(", "), F.lit(" – "))
    text = F.replace(text, F.lit(". "), F.lit("… "))
    text = F.replace(text, F.lit("on "), F.lit("on​ •× "))
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", clean.standardised(text).alias("text"))


@query("clean_ligatures", """
SELECT doc_id, replace(text, ' the', ' fithe') AS text FROM documents""")
def clean_ligatures(spark, folder):
    text = F.replace(F.col("text"), F.lit(" the"), F.lit(" fi the"))
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", clean.rejoined(text).alias("text"))


@query("clean_spaces", """
SELECT doc_id, replace(replace(text, ', ', ',  '), 'and', 'an d') AS text FROM documents""")
def clean_spaces(spark, folder):
    text = F.replace(F.col("text"), F.lit(", "), F.lit(",  "))
    text = F.replace(text, F.lit("and"), F.lit("an\x07　d\x90"))
    return documents(spark, folder, "doc_id", "text").select(
        "doc_id", clean.plain_spaces(text).alias("text"))


# Whole-document steps run on numbered pages with a header and a page number put in.
PAGE_LINES = 4


def _paged(text):
    lines = F.transform(F.split(text, "\n"), lambda l, i: F.when(i % PAGE_LINES == 0, F.concat(
        l, F.lit("\nFire Guide \nPage "), i + 1, F.lit(" of 90\nEscape routes ..... "), i + 1))
        .when(i % PAGE_LINES == 1, F.concat(l, F.lit("\n\n\n\n-  "), i, F.lit(" -\n;;")))
        .otherwise(l))
    return F.array_join(lines, "\n")


SQL_PAGED = """
paged AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    CASE WHEN (i - 1) % 4 = 0 THEN l || chr(10) || 'Fire Guide ' || chr(10) || 'Page ' || i || ' of 90'
        || chr(10) || 'Escape routes ..... ' || i
      WHEN (i - 1) % 4 = 1 THEN l || chr(10) || chr(10) || chr(10) || chr(10) || '-  ' || (i - 1) || ' -' || chr(10) || ';;'
      ELSE l END), chr(10)) AS text FROM documents),
lines AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM paged),
stripped AS (SELECT *, """ + sql_strip("line") + """ AS s FROM lines),
flagged AS (SELECT *, length(s) > 3 AND length(s) <= 90 AND NOT regexp_matches(s, '^\\d')
    AND count(*) OVER (PARTITION BY doc_id, s) >= 8 AS header,
    s <> '' AND (regexp_matches(s, '^[-—]?\\s*\\d{1,4}\\s*[-—]?$')
      OR regexp_matches(s, '(?i)^page\\s+\\d+(\\s+of\\s+\\d+)?$')
      OR regexp_matches(s, '(?i)^\\d+\\s+of\\s+\\d+$')
      OR regexp_matches(s, '^.{0,120}?[.․‧]{4,}\\s*\\d{1,4}\\s*$')
      OR regexp_matches(s, '^[A-Z][^.!?]{3,70}\\s{2,}\\d{1,4}\\s*$')
      OR (length(s) < 3 AND NOT regexp_matches(s, '\\p{L}'))) AS furniture FROM stripped)
"""


def _joined(condition: str) -> str:
    return f"""SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE {condition}), '')
      AS text FROM flagged GROUP BY doc_id"""


def sql_collapsed(value: str) -> str:
    squeezed = f"regexp_replace({value}, '[ \\t]+', ' ', 'g')"
    squeezed = f"regexp_replace({squeezed}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(f"regexp_replace({squeezed}, ' \\n', chr(10), 'g')")


def _on_pages(spark, folder, step):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", step(_paged(F.col("text"))).alias("text"))


@query("clean_running_headers", f"WITH {SQL_PAGED} {_joined('NOT header')}")
def clean_running_headers(spark, folder):
    return _on_pages(spark, folder, lambda t: tx.let(F.split(t, "\n"), lambda lines: F.array_join(
        clean.without_headers(lines), "\n")))


@query("clean_furniture", f"WITH {SQL_PAGED} {_joined('NOT furniture')}")
def clean_furniture(spark, folder):
    return _on_pages(spark, folder, lambda t: F.array_join(
        clean.without_furniture(F.split(t, "\n")), "\n"))


@query("clean_collapse", f"WITH {SQL_PAGED} SELECT doc_id, {sql_collapsed('text')} AS text FROM paged")
def clean_collapse(spark, folder):
    return _on_pages(spark, folder, clean.collapsed)


@query("clean_documents", f"""
WITH {SQL_PAGED}, kept AS ({_joined('NOT header AND NOT furniture')}),
done AS (SELECT doc_id, {sql_collapsed('text')} AS text FROM kept)
SELECT doc_id, text, length(text) AS characters FROM done""")
def clean_documents(spark, folder):
    return clean.clean_documents(_on_pages(spark, folder, lambda t: t))


@query("clean_rejects", """
SELECT doc_id % 7 = 0 AS rejected, count(*) AS documents FROM documents GROUP BY 1""")
def clean_rejects(spark, folder):
    """Every seventh document is nothing but page furniture."""
    docs = documents(spark, folder, "doc_id", "text").withColumn("text", F.when(
        F.col("doc_id") % 7 == 0, "Page 1 of 2\n 12 \n\n").otherwise(F.col("text")))
    good, bad = clean.split_rejects(clean.clean_documents(docs))
    both = good.withColumn("rejected", F.lit(False)).unionByName(
        bad.withColumn("rejected", F.lit(True)))
    return both.groupBy("rejected").agg(F.count("*").alias("documents"))
