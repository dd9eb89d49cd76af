"""SimHash near-dedup: deletion-variant signatures, an equality on them, and a check.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit
in one of their two halves.  So each half is indexed once for each of its bits with that
bit struck out: fingerprints within the distance share at least one such signature.
Every bucket of equal signatures is then checked bit by bit.

A bucket too large for one task is split by the same rule again, on the half that the
signature leaves open (two quarters, then two eighths); after that at most 2 ** 11
different fingerprints can share a bucket.  A bucket yields links that span its linked
groups, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.graph import components
from clauseloom.llm.store import column, cut

SEED = 42
#: Fingerprints of one bucket that a task holds at once; larger buckets are split.
BUCKET = 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer (0 for no words)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())],
                      dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at: at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""
    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        out = np.array([fingerprint(t.as_py(), words) for t in texts], dtype=np.uint64)
        return pa.array(out.view(np.int64))

    return hashed(F.coalesce(text, F.lit("")))


def _variants(frame: DataFrame, level: int) -> DataFrame:
    """A row per signature: the bucket ``k{level}`` and the bits it leaves open.

    ``rest`` is the lowest bit of the part of the fingerprint that earlier levels have
    left open; the part is halved, and each half loses each of its bits in turn.
    """
    width = 32 >> level
    low = f"(rest + {width} * (v div {width}))"
    piece = f"(shiftrightunsigned(fp, cast({low} as int)) & {(1 << width) - 1}L)"
    return (
        frame.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))))
        .withColumn(f"k{level}", F.expr(
            f"shiftleft(cast(v as long), {width}) | ({piece} & ~shiftleft(1L, v % {width}))"))
        .withColumn("rest", F.expr(f"cast(rest + {width} * (1 - v div {width}) as int)"))
        .drop("v")
    )


def _check(keys: list[str], distance: int, bucket: int):
    """Links inside the buckets of a stream of rows sorted by ``keys``."""
    def links(values: np.ndarray) -> list[tuple[int, int]]:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
        label = np.arange(len(values))
        while True:
            low = np.where(near, label[None, :], len(values)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = np.minimum(low, label)
        return [(i, r) for i, r in enumerate(label.tolist()) if i != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, hot_key = 0, None

        def batch(columns: list[np.ndarray], rest, fp, other, hot):
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(rest, pa.int32()),
                 pa.array(fp, pa.int64()), pa.array(other, pa.int64()), pa.array(hot, pa.bool_())],
                names=[*keys, "rest", "fp", "other", "hot"])

        def flush(last: bool):
            """Check all buckets that are whole; keep the last one unless at the end."""
            nonlocal held, rows, hot_key
            if not rows:
                return
            table = pa.Table.from_batches(held)
            key = [table[k].to_numpy() for k in keys]
            fp, rest = table["fp"].to_numpy(), table["rest"].to_numpy()
            change = np.zeros(rows, dtype=bool)
            change[0] = True
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], rows)
            keep = rows
            if not last:
                if ends[-1] - starts[-1] <= bucket and (
                        tuple(k[starts[-1]] for k in key) != hot_key):
                    keep = int(starts[-1])
                    starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            hot = sizes > bucket
            if hot_key is not None and len(starts) and tuple(k[0] for k in key) == hot_key:
                hot[0] = True
            a, b = [], []
            small = starts[(sizes == 2) & ~hot]
            ok = np.bitwise_count(fp[small].view(np.uint64) ^ fp[small + 1].view(np.uint64)) <= distance
            a.append(fp[small + 1][ok])
            b.append(fp[small][ok])
            for s, e in zip(starts[(sizes > 2) & ~hot], ends[(sizes > 2) & ~hot]):
                values = fp[s:e]
                found = links(values.view(np.uint64))
                if found:
                    i, r = np.array(found).T
                    a.append(values[i])
                    b.append(values[r])
            a, b = np.concatenate(a), np.concatenate(b)
            zero = np.zeros(len(a), dtype=np.int64)
            yield batch([zero] * len(keys), zero, a, b, zero.astype(bool))
            if hot.any():
                at = np.concatenate([np.arange(s, e) for s, e in zip(starts[hot], ends[hot])])
                yield batch([k[at] for k in key], rest[at], fp[at], fp[at],
                            np.ones(len(at), dtype=bool))
                hot_key = tuple(k[at[-1]] for k in key)
            table = table.slice(keep)
            held = table.to_batches()
            rows = table.num_rows

        for incoming in batches:
            held.append(incoming)
            rows += incoming.num_rows
            if rows >= 16 * bucket:
                yield from flush(last=False)
        yield from flush(last=True)

    return run


def links(fingerprints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that span every group of fingerprints within the distance.

    ``fingerprints`` has one long column without repeats.  Distances up to 3 are served
    by two segments: no such link is missed.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments serve distances from 0 to 3")
    rows = fingerprints.toDF("fp").withColumn("rest", F.lit(0))
    found, keys = [], []
    for level in range(3):
        # level 0 halves all 64 bits, so the part left open is the other half
        rows = _variants(rows, level)
        keys.append(f"k{level}")
        schema = ", ".join(f"{k} long" for k in keys) + ", rest int, fp long, other long, hot boolean"
        # at the last level at most 2 ** 11 fingerprints can share a bucket
        most = bucket if level < 2 else max(bucket, 1 << 11)
        checked = cut(
            rows.select(*keys, "rest", "fp").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_check(keys, distance, most), schema), "links")
        found.append(checked.where("not hot").select(F.col("fp").alias("a"), F.col("other").alias("b")))
        rows = checked.where("hot").select(*keys, "rest", "fp")
        if level == 2 or rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def groups(fingerprints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(node, root) for every fingerprint that is linked with another one."""
    return components(links(fingerprints, distance, bucket))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, doc_id: str = "doc_id",
                    text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document.

    Words are lower-cased in A-Z and split at ASCII white space.  Null and empty texts
    have fingerprint 0 and are linked like any other; repeated rows stay repeated; null
    ids stay null and never name a component unless all its ids are null.
    """
    prints = cut(docs.select(
        column(docs, doc_id).alias("doc_id"),
        fingerprint_column(column(docs, text), words).alias("fp")), "fingerprints")
    roots = groups(prints.select("fp").distinct(), distance, bucket)
    rooted = prints.join(roots, prints.fp == roots.node, "left").select(
        "doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
