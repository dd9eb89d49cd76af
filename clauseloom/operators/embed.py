"""Encoders and pooling.

An encoder is either a column function ``text -> array<double>`` or a frame
function that adds ``vector`` to a frame holding ``chunk``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clauseloom import fixed
from clauseloom.functions.text import chunks, let, tokens
from clauseloom.functions.vectors import dot, pooled, unit
from clauseloom.session import cut, fan_out

#: Terms sent to every task: those that one chunk in 2,000 or more holds, and how many at most.
COMMON_WEIGHT, COMMON_TERMS = 7.6, 250_000

ColumnEncoder = Callable[[Column], Column]
FrameEncoder = Callable[[DataFrame], DataFrame]


def letter_profile(text: Column) -> Column:
    """Unit vector of letter counts: a model-free stand-in that stays in the JVM.

    A letter is one byte, so sizes in bytes tell its count; lengths would read the text anew.
    """
    return let(F.lower(text), lambda low: unit(F.array(*[
        (F.octet_length(low) - F.octet_length(F.replace(low, F.lit(letter), F.lit("")))).cast("double")
        for letter in "abcdefghijklmnopqrstuvwxyz"])))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, their squares added up in order as ``vectors.unit`` does."""
    norms = np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1])
    return rows / np.where(norms == 0, 1.0, norms)[:, None]


def _letters(text: str) -> np.ndarray:
    """The pooled letter counts of one text, each of its chunks counted in one pass."""
    size, stride = fixed.CHUNK_WORDS, fixed.CHUNK_WORDS - fixed.CHUNK_OVERLAP
    words = text.split()
    parts = [text] if len(words) <= size else [
        " ".join(words[at:at + size]) for at in range(0, len(words), stride)]
    counts = np.stack([np.bincount(np.frombuffer(part.lower().encode("utf-8", "replace"), dtype=np.uint8),
                                   minlength=256)[97:123] for part in parts])
    return _scaled(np.cumsum(_scaled(counts.astype(np.float64)), axis=0)[-1:])[0]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def letter_profiles(text: pa.Array) -> pa.Array:
    """``letter_profile`` of whole texts, chunked and pooled: a missing text is an empty one."""
    found = [_letters((t or b"").decode("utf-8", "replace")) for t in text.cast(pa.binary()).to_pylist()]
    flat = np.concatenate(found) if found else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * 26, pa.int32()), pa.array(flat))


#: What an encoder does to a whole text at once, where it can: see ``encode_column``.
letter_profile.whole = letter_profiles


def hashed_terms(width: int = 1024) -> FrameEncoder:
    """Hashed token counts as unit vectors, by the built-in feature transformers."""
    def encode(frame: DataFrame) -> DataFrame:
        from pyspark.ml.feature import HashingTF
        from pyspark.ml.functions import vector_to_array

        terms = frame.withColumn("_terms", terms_of(F.col("chunk")))
        hashed = HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=width)
        return (hashed.transform(terms)
                .withColumn("vector", unit(vector_to_array("_counts")))
                .drop("_terms", "_counts"))

    return encode


def terms_of(text: Column) -> Column:
    """The lower-cased tokens of a text that are not white space."""
    return F.filter(tokens(F.lower(text)), lambda t: F.trim(t) != "")


def term_weights(chunked: DataFrame) -> DataFrame:
    """(term, weight): log((n + 1) / (df + 1)) over the chunks of a corpus.

    Counts combine before the shuffle; the table is joined by term, never collected.
    """
    held = chunked.select(F.explode(F.array_distinct(terms_of(F.col("chunk")))).alias("term"))
    total = chunked.count()
    return held.groupBy("term").agg(F.log(F.lit(total + 1) / (F.count("*") + 1)).alias("weight"))


def weighted_terms(weights: DataFrame, width: int = 64) -> FrameEncoder:
    """Unit vectors of hashed terms, each occurrence counting its corpus weight.

    A term falls in the dimension of its MD5's first eight digits modulo ``width``; terms
    the corpus does not know count nothing.  Rows are told apart by their other columns,
    as chunks are by key and part; these and the vector come out, and a row with a null
    among them has a vector of zeros.

    Terms of little weight, which make up most of a text, are a bounded table sent to every
    task, so their sums are taken where the row lies.  Only the other terms of a row are
    shuffled to the weights, and none of these is a hot key.
    """
    def encode(frame: DataFrame) -> DataFrame:
        row = [c for c in frame.columns if c != "chunk"]
        place = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % width
        known = cut(weights.select("term", place.cast("int").alias("_dimension"),
                                   "weight", F.col("weight").cast("decimal(28,18)").alias("_weight")))
        common = F.broadcast(known.filter(F.col("weight") <= COMMON_WEIGHT).select(
            "term", "_dimension", "_weight").limit(COMMON_TERMS))
        met = fan_out(frame, *row).select(*row, F.posexplode_outer(terms_of(F.col("chunk"))).alias("_at", "term")).join(
            common, "term", "left")
        # all by the columns that the rows lie by, so nothing moves
        summed = met.groupBy(*row, "_dimension", F.when(F.col("_dimension").isNull(), F.col("term")).alias("_term")).agg(
            F.sum("_weight").alias("_x"), F.count("*").alias("_tf"), F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("_rows"))
        told = cut(summed.groupBy(*row).agg(
            F.collect_list(F.when(F.col("_dimension").isNotNull(), F.struct("_dimension", "_x"))).alias("_common"),
            F.collect_list(F.when(F.col("_term").isNotNull(), F.struct("_term", "_tf"))).alias("_others"),
            F.sum("_rows").cast("int").alias("_rows")))
        others = told.select(*row, F.explode("_others").alias("_o")).select(
            *row, F.col("_o._term").alias("term"), "_o._tf").join(known, "term")
        others = others.groupBy(*row, "_dimension").agg(
            F.sum((F.col("_tf") * F.col("weight")).cast("decimal(28,18)")).alias("_x"))
        others = others.groupBy(*row).agg(F.collect_list(F.struct("_dimension", "_x")).alias("_held"))
        nothing = F.array().cast(others.schema["_held"].dataType)

        def dense(held: Column) -> Column:
            by = F.map_from_entries(held)
            return let(by, lambda m: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.coalesce(
                F.try_element_at(m, d), F.lit(0).cast("decimal(38,18)"))))

        # a row with a null is met by no row of the others, nor counts what it has in common
        whole = F.lit(True)
        for c in row:
            whole = whole & F.col(c).isNotNull()
        every = F.zip_with(dense(F.when(whole, F.col("_common")).otherwise(nothing)), dense(F.coalesce("_held", nothing)),
                           lambda a, b: (a.cast("decimal(37,18)") + b.cast("decimal(37,18)")).cast("double"))
        found = told.join(others, row, "left").select(*row, unit(every).alias("vector"), "_rows")
        return found.select(*row, "vector", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(*row, "vector")

    return encode


def batch_model(make_predict: Callable, batch_size: int = 64) -> FrameEncoder:
    """A user-supplied model: ``make_predict`` runs once per worker and returns a batch function."""
    def encode(frame: DataFrame) -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf

        predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()),
                                    batch_size=batch_size)
        return frame.withColumn("vector", unit(predict(F.col("chunk"))))

    return encode


def encode_column(text: Column, encoder: ColumnEncoder) -> Column:
    """Chunk, encode and pool inside the row; an encoder may bring all three as ``whole``."""
    if hasattr(encoder, "whole"):
        return encoder.whole(text)
    return pooled(F.transform(chunks(text), encoder))


def encode_frame(frame: DataFrame, keys: list[str], text: Column, encoder: FrameEncoder,
                 out: str = "vector") -> DataFrame:
    """(keys, out) with chunks encoded as rows; a key collects the chunks of its own text."""
    parts = frame.select(*keys, F.posexplode(chunks(text)).alias("part", "chunk"))
    return pool(encoder(parts), keys, out)


def pool(parts: DataFrame, keys: list[str], out: str = "vector") -> DataFrame:
    """Sum the part vectors of a key and scale to length one.

    Sums are taken dimension by dimension, so parts combine before the shuffle and a key
    may have any number of them.  They are decimals of 18 places: the order of the parts
    makes no difference.
    """
    sums = parts.select(*keys, F.posexplode("vector").alias("_dimension", "_x")).groupBy(
        *keys, "_dimension").agg(F.sum(F.col("_x").cast("decimal(28,18)")).alias("_x"))
    gathered = F.array_sort(F.collect_list(F.struct("_dimension", F.col("_x").cast("double").alias("_x"))))
    return sums.groupBy(*keys).agg(gathered.alias("_sums")).select(
        *keys, unit(F.transform("_sums", lambda s: s["_x"])).alias(out))


def with_vector(frame: DataFrame, keys: list[str], text: Column,
                encoder: ColumnEncoder | FrameEncoder, out: str = "vector",
                in_row: bool = True) -> DataFrame:
    """Add the pooled vector of ``text`` to every row."""
    if in_row:
        return frame.withColumn(out, encode_column(text, encoder))
    return frame.join(encode_frame(frame, keys, text, encoder, out), keys)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of unit vectors."""
    return dot(left, right)
