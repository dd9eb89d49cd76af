"""Best-fit packing under several capacities at once (vector best-fit).

A piece of a document asks for tokens, for one document slot and for attention cost (its
length squared).  Pieces go longest first, each into the open sequence where it fits
under every capacity and leaves the smallest weighted residual norm (or where the
weighted dot product of what it asks for and what is left is largest).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut
from clauseloom.llm.tokens import word_encoder

#: Pieces that one task packs together.
GROUP = 16_384


def vector_best_fit(lengths: np.ndarray, capacity: int, documents: int | None = None,
                    attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
                    rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) per piece.

    ``documents`` and ``attention`` default to limits that tokens reach first.  Equal
    lengths keep their order; equal scores go to the older bin.
    """
    documents = documents or capacity
    full = np.array([capacity, documents, attention or float(capacity) ** 2], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64) / full ** (2 if rule == "norm" else 1)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left = np.empty((3, max(1, len(lengths))))
    name = np.empty(max(1, len(lengths)), dtype=np.int64)
    open_, made = 0, 0
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        size = int(lengths[i])
        ask = np.array([size, 1.0, float(size) * size])
        if (ask > full).any():
            raise ValueError("a piece exceeds a capacity")
        at = -1
        if open_:
            t, d, c = left[0, :open_], left[1, :open_], left[2, :open_]
            fits = (t >= size) & (d >= 1) & (c >= ask[2])
            if rule == "norm":
                score = w[0] * (t - size) ** 2 + w[1] * (d - 1) ** 2 + w[2] * (c - ask[2]) ** 2
            else:
                score = -(w[0] * t * size / full[0] + w[1] * d / full[1] + w[2] * c * ask[2] / full[2])
            score[~fits] = np.inf
            best = int(score.argmin())
            if np.isfinite(score[best]):
                at = best
        if at < 0:
            at, open_ = open_, open_ + 1
            left[:, at], name[at] = full, made
            made += 1
        bins[i], offsets[i] = name[at], capacity - int(left[0, at])
        left[:, at] -= ask
        if left[0, at] < max(1, smallest) or left[1, at] < 1 or left[2, at] < 1:  # closed: keep the others in order
            left[:, at: open_ - 1] = left[:, at + 1: open_]
            name[at: open_ - 1] = name[at + 1: open_]
            open_ -= 1
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, leading: bool, end_id: int, capacity: int,
                 doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, **bounds: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): whole texts as pieces of ids.

    A document is its ids and the end id; only one longer than ``capacity`` is cut.
    ``bounds`` tell what the encoder of a worker may hold (see ``word_encoder``).
    """
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
             ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(kinds)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, leading, **bounds)
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1))):
                ids = np.append(ids, end_id).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start: start + capacity]
                    out.append((doc, n, start, len(part), zlib.crc32(part.tobytes()))
                               + ((part.astype(np.int32),) if with_ids else ()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(column(docs, doc_id).cast("long").alias("doc_id"),
                       F.coalesce(column(docs, text), F.lit("")).alias("text")).mapInArrow(pieces, ddl)


def pack(pieces: DataFrame, capacity: int, documents: int | None = None, attention: float | None = None,
         weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Pieces are dealt evenly into groups of about ``group``, whatever their documents, and
    each group is packed in one task; groups do not share sequences, so each may leave
    one of them ill filled in some thousands.
    """
    pieces = cut(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets = vector_best_fit(
            table["length"].to_numpy(), capacity, documents, attention, weights, rule)
        base = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(bins + base))
        yield from table.append_column("offset", pa.array(offsets)).to_batches()

    ddl = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return pieces.repartition(groups).mapInArrow(run, ddl)
