"""Token ids in binary files: each document a zstandard frame of its own.

All frames share one dictionary, trained on serialised id arrays, which makes frames of
short documents small and still lets one document be read alone.  A file set is two
tables in one folder:

* ``dictionary``: one row (sha256, dictionary, width), ``width`` being the bytes per id;
* ``shards``: rows (part, seq, sha256, doc_ids, n_tokens, offsets, blob) in ascending
  order of ids.  ``blob`` holds the frames end to end, frame i from offsets[i] to
  offsets[i + 1]; ids inside are little-endian and unsigned.

Spark's own writer commits them, so lost executors leave no half files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.llm.store import column
from clauseloom.llm.tokens import word_encoder

#: Documents, and characters of each, that the dictionary is trained on.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 8192, 65_536
SHARD_BYTES = 4 << 20


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write_token_files(docs: DataFrame, path: str, tokenizer: str, leading: bool, end_id: int,
                      doc_id: str = "doc_id", text: str = "text", width: int = 2,
                      shard_bytes: int = SHARD_BYTES) -> None:
    """Encode whole texts, append ``end_id``, and write the file set to ``path``.

    Null texts are empty: a document of the end id alone.  Null ids come first; rows with
    one id are ordered by their texts' hash, repeated rows are written repeatedly.
    """
    spark = docs.sparkSession
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"),
                       F.coalesce(column(docs, text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    kind = {2: "<u2", 4: "<u4"}[width]

    # ids first, so that no more than the sample's own texts leave the tasks
    chosen = rows.select("doc_id", "h").orderBy(F.xxhash64("doc_id", "h"), "h").limit(SAMPLE_DOCS).distinct()
    match = F.broadcast(chosen.select(F.col("doc_id").alias("i"), F.col("h").alias("g")))
    sample = [r[0] for r in rows.join(match, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
              .select(F.substring("text", 1, SAMPLE_CHARS), "doc_id", "h").limit(SAMPLE_DOCS)
              .orderBy("doc_id", "h").collect()]
    encode = word_encoder(tokenizer, leading)
    data = train_dictionary([np.append(ids, end_id).astype(kind).tobytes()
                             for ids in encode(pa.array(sample, pa.string()))] if sample else [])
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data), width)], "sha256 string, dictionary binary, width int") \
        .coalesce(1).write.parquet(f"{path}/dictionary")

    schema = ("part int, seq int, sha256 string, doc_ids array<long>, n_tokens array<long>, "
              "offsets array<long>, blob binary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, leading)
        compress = zstandard.ZstdCompressor(level=3, dict_data=_dict(data)).compress
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, offsets, frames = [], [], [0], []

        def shard():
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "sha256": sha, "doc_ids": ids, "n_tokens": counts,
                "offsets": offsets, "blob": b"".join(frames)}], schema=pa.schema([
                    ("part", pa.int32()), ("seq", pa.int32()), ("sha256", pa.string()),
                    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
                    ("offsets", pa.list_(pa.int64())), ("blob", pa.binary())]))

        for batch in batches:
            for doc, tokens in zip(batch.column(0).to_pylist(), encoder(batch.column(1))):
                frames.append(compress(np.append(tokens, end_id).astype(kind).tobytes()))
                ids.append(doc)
                counts.append(len(tokens) + 1)
                offsets.append(offsets[-1] + len(frames[-1]))
                if offsets[-1] >= shard_bytes:
                    yield shard()
                    seq += 1
                    ids, counts, offsets, frames = [], [], [0], []
        if ids:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(shards, schema).write.parquet(f"{path}/shards"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document; ``start`` counts the ids before it."""
    return _read(spark, path, with_ids=True)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files alone."""
    return _read(spark, path, with_ids=False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    table = spark.read.parquet(f"{path}/shards")
    sha, data, width = spark.read.parquet(f"{path}/dictionary").first()
    data, kind = bytes(data), {2: "<u2", 4: "<u4"}[width]
    if hashlib.sha256(data).hexdigest() != sha:
        raise ValueError("the dictionary does not match its hash")
    last = ("ids", pa.list_(pa.int32())) if with_ids else ("ids_crc32", pa.int64())
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()),
                        ("before", pa.int64()), ("n_tokens", pa.int64()), last])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=_dict(data)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["sha256"] != sha:
                    raise ValueError("a shard was written with another dictionary")
                offsets, blob, out = row["offsets"], row["blob"], []
                before = 0
                for i, doc in enumerate(row["doc_ids"]):
                    ids = np.frombuffer(expand(blob[offsets[i]: offsets[i + 1]]), dtype=kind)
                    if len(ids) != row["n_tokens"][i]:
                        raise ValueError("a frame does not hold the ids its index names")
                    seen = ids.astype(np.int32) if with_ids else zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((row["part"], row["seq"], doc, before, len(ids), seen))
                    before += len(ids)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    sums = table.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    past = (Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*past)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(*past)
    starts = sums.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("shift")).join(parts, "part")
    ddl = "part int, seq int, doc_id long, before long, n_tokens long, " + (
        "ids array<int>" if with_ids else "ids_crc32 long")
    return (table.mapInArrow(documents, ddl).join(starts, ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("shift") + F.col("before")).alias("start"), "n_tokens", last[0]))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that id), without decoding any other."""
    sha, data, width = spark.read.parquet(f"{path}/dictionary").first()
    hits = spark.read.parquet(f"{path}/shards").where(F.array_contains("doc_ids", doc_id)).select(
        F.explode(F.filter(F.arrays_zip(
            "doc_ids", F.slice("offsets", 1, F.size("doc_ids")).alias("a"),
            F.slice("offsets", 2, F.size("doc_ids")).alias("b")),
            lambda x: x["doc_ids"] == doc_id)).alias("x"), "blob").select(
        F.expr("substring(blob, cast(x.a + 1 as int), cast(x.b - x.a as int))").alias("frame"))
    expand = zstandard.ZstdDecompressor(dict_data=_dict(bytes(data))).decompress
    return [np.frombuffer(expand(bytes(r[0])), dtype={2: "<u2", 4: "<u4"}[width]).tolist()
            for r in hits.collect()]
