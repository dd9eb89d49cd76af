"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where chunks end, so that
lines put in or taken out elsewhere do not shift the chunks of a repeated passage.  A
chunk of several lines that occurs more than once, in any document, stays where it
occurs first (least id, then place) and is removed elsewhere, once its bytes have been
compared with those that stay.

A passage that repeats need not hold a whole chunk.  So, if a least number of words is
given, shortest runs of whole lines with so many words are chunks too, long lines by
themselves among them.  Of the runs that begin within a window of words the one with the
least rolling hash is taken, so two copies of a passage take the same ones wherever they
stand: any repeated passage of whole lines with ``words + WINDOW`` words holds one.  A
taken run whose bytes equal those of its first occurrence grows line by line on both
sides for as long as the bytes are equal, as far as the next taken run can be.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut, fresh, row_key

#: A chunk ends behind a line with chance 1 / SPACING; it has at least LINES lines.
SPACING, LINES = 3, 2
#: Words that a repeated run of lines has at least in op5 and the pipeline.
WORDS = 20
#: Of the runs that begin within so many words one is taken.
WINDOW = 30
#: Modulus and base of the rolling hash over line hashes.
PRIME, BASE = (1 << 61) - 1, 0x9E3779B97F4A7C1


def chunk_bounds(data: bytes, spacing: int = SPACING, least: int = LINES) -> list[tuple[int, int, int]]:
    """(begin, end, lines) of each chunk of a text, line feeds included; they cover it."""
    lines = [line + b"\n" for line in data.split(b"\n")]
    lines[-1] = lines[-1][:-1]  # a last line without a line feed; nothing, if there is one
    if not lines[-1]:
        lines.pop()
    out, begin, at, count, before = [], 0, 0, 0, 0
    for line in lines:
        digest = xxhash.xxh64_intdigest(line.rstrip(b"\n"))
        rolling = (before * 0x9E3779B97F4A7C15 + digest) & 0xFFFFFFFFFFFFFFFF
        before = digest
        at += len(line)
        count += 1
        if count >= least and (rolling >> 32) % spacing == 0:
            out.append((begin, at, count))
            begin, count = at, 0
    if count:
        out.append((begin, at, count))
    return out


class Run(NamedTuple):
    """A run of whole lines, and the bytes around it in which it may grow."""

    begin: int
    end: int
    h: int
    low: int
    high: int


def taken_runs(data: bytes, words: int, window: int = WINDOW) -> list[Run]:
    """Of the shortest runs of lines with enough words, the least hashes of each window."""
    lines = data.split(b"\n")
    ends, total, rolled, power = [0], [0], [0], [1]
    for line in lines:
        ends.append(ends[-1] + len(line) + 1)
        total.append(total[-1] + len(line.split()))
        rolled.append((rolled[-1] * BASE + xxhash.xxh64_intdigest(line)) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    ends[-1] -= 1
    last = len(lines)
    runs, j = [], 0  # (hash, first line, line behind the last), in order
    for i in range(last):
        while j < last and total[j] - total[i] < words:
            j += 1
        if total[j] - total[i] < words:
            break
        if total[i + 1] > total[i]:
            runs.append(((rolled[j] - rolled[i] * power[j - i]) % PRIME, i, j))
    taken, ahead, behind = set(), deque(), 0
    for n, (_, i, _) in enumerate(runs):
        while behind < len(runs) and total[runs[behind][1]] < total[i] + window:
            while ahead and runs[ahead[-1]][0] > runs[behind][0]:
                ahead.pop()
            ahead.append(behind)
            behind += 1
        while ahead[0] < n:
            ahead.popleft()
        taken.add(ahead[0])
    out = []
    for n in sorted(taken):
        h, i, j = runs[n]
        # lines as long as a window are taken themselves, so nothing need grow over them
        low, high = i, j
        while low and total[i] - total[low - 1] <= window and total[low] - total[low - 1] < window:
            low -= 1
        while high < last and total[high] - total[j] < 2 * window and total[high + 1] - total[high] < window:
            high += 1
        out.append(Run(ends[i], ends[j], h, ends[low], ends[high]))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) * (h >> 63)


def _chunks(spacing: int, least: int, words: int | None):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("run", pa.bool_()), ("begin", pa.int32()),
                        ("size", pa.int32()), ("h", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
                        ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, data in zip(*(c.to_pylist() for c in batch.columns)):
                chunks = [c for c in chunk_bounds(data, spacing, least) if c[2] >= least]
                for begin, end, _ in chunks:
                    # without the last line feed, which the end of a text lacks
                    h = _signed(xxhash.xxh64_intdigest(data[begin:end].rstrip(b"\n")))
                    out.append((k1, k2, False, begin, end - begin, h, begin, end, len(chunks)))
                for r in taken_runs(data, words) if words else ():
                    out.append((k1, k2, True, r.begin, r.end - r.begin, r.h, r.low, r.high, None))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _alike(ours: Iterable[bytes], kept: Iterable[bytes]) -> int:
    """Bytes of the lines, line feeds included, that two lists have in common from their start on."""
    size = 0
    for one, other in zip(ours, kept):
        if one != other:
            break
        size += len(one) + 1
    return size


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes to remove for each occurrence whose bytes equal those that stay."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("begin", pa.int32()), ("size", pa.int32()),
                        ("chunk", pa.bool_())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            body, kept = row["body"], row["kept"]
            if body.rstrip(b"\n") != kept["body"].rstrip(b"\n"):
                continue
            begin, end = row["begin"], row["begin"] + row["size"]
            if row["run"]:
                begin -= _alike(reversed(row["before"].split(b"\n")[:-1]), reversed(kept["before"].split(b"\n")[:-1]))
                after, kept_after = (x[:-1].split(b"\n") if x.endswith(b"\n") else x.split(b"\n")
                                     for x in (row["after"], kept["after"]))
                if row["after"] and kept["after"]:
                    end += min(len(row["after"]), _alike(after, kept_after))
                if row["own_end"] is not None:
                    begin = max(begin, row["own_end"])
            if begin < end:
                out.append((row["k1"], row["k2"], begin, end - begin, not row["run"]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _merge(spans: list) -> list[dict[str, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[dict[str, int]] = []
    for begin, size in sorted((m["begin"], m["size"]) for m in spans):
        if out and begin <= out[-1]["begin"] + out[-1]["size"]:
            out[-1]["size"] = max(out[-1]["size"], begin + size - out[-1]["begin"])
        else:
            out.append({"begin": begin, "size": size})
    return out


def _merged(marks: Column) -> Column:
    @F.pandas_udf("array<struct<begin:int,size:int>>")
    def merged(spans: pd.Series) -> pd.Series:
        return spans.map(_merge)

    return merged(marks)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               spacing: int = SPACING, least: int = LINES, words: int | None = None) -> DataFrame:
    """The documents with repeated chunks removed: all columns, and (n_chunks, n_removed).

    The two counts, named so or, if taken, with an underscore added, tell how many chunks
    of several lines a text has and how many were removed.  A null text stays null.  Rows
    alike in id and text are one place: they keep or lose the same chunks.

    With ``words``, repeated runs of lines of at least so many words go too, with the lines
    around them that are equal as well.  A run that follows its own first occurrence in one
    text loses only what lies behind that one.  Every removed line stays somewhere before.
    """
    a, b, data = (fresh(x, docs) for x in ("k1", "k2", "data"))
    n_chunks, n_removed, marks = (fresh(x, docs) for x in ("n_chunks", "n_removed", "marks"))
    k1, k2 = row_key(column(docs, doc_id), column(docs, text))
    keyed = docs.withColumns({a: k1, b: k2})
    spans = cut(keyed.select(F.col(a).alias("k1"), F.col(b).alias("k2"), F.coalesce(
        column(docs, text), F.lit("")).cast("binary").alias("data"))
        .mapInArrow(_chunks(spacing, least, words),
                    "k1 long, k2 long, run boolean, begin int, size int, h long, low int, high int, n int"), "chunks")
    place = F.struct("k1", "k2", "begin")
    first = (spans.groupBy("run", "h").agg(F.min(F.struct("k1", "k2", "begin", "size")).alias("first"),
                                           F.max(place).alias("last"))
             .where("first.k1 <> last.k1 or first.k2 <> last.k2 or first.begin <> last.begin").drop("last"))
    own = F.expr("k1 = first.k1 and k2 = first.k2")
    hits = spans.join(first, ["run", "h"]).select("k1", "k2", F.struct(
        "run", "h", "begin", "size", "low", "high", (own & (F.col("begin") == F.col("first.begin"))).alias("stays"),
        F.when(own, F.expr("first.begin + first.size")).alias("own_end")).alias("mark"))
    # rows alike in id and text give equal marks
    per = hits.groupBy("k1", "k2").agg(F.collect_set("mark").alias("mark"))
    # the bytes of the repeated chunks alone, and those around runs, to compare them
    part = lambda begin, end: F.expr(f"substring(data, {begin} + 1, {end} - {begin})")
    body = keyed.select(F.col(a).alias("k1"), F.col(b).alias("k2"), column(docs, text).cast("binary").alias("data")) \
        .join(per, ["k1", "k2"]) \
        .select("k1", "k2", "data", F.explode("mark").alias("m")) \
        .select("k1", "k2", "m.*", part("m.begin", "(m.begin + m.size)").alias("body"),
                part("m.low", "m.begin").alias("before"), part("(m.begin + m.size)", "m.high").alias("after")) \
        .drop("low", "high")
    body = cut(body, "bodies")
    stay = body.where("stays").groupBy("run", "h").agg(F.min(F.struct("body", "before", "after")).alias("kept"))
    gone = body.where("not stays").drop("stays").join(stay, ["run", "h"]) \
        .mapInArrow(_compared, "k1 long, k2 long, begin int, size int, chunk boolean")
    span = F.struct("begin", "size")
    gone = gone.groupBy("k1", "k2").agg(F.collect_set(span).alias(marks), F.collect_set(F.when(F.col("chunk"), span)).alias("whole"))
    total = spans.where("not run").groupBy("k1", "k2").agg(F.max("n").alias("n"))
    gone = total.join(gone, ["k1", "k2"], "full").select(
        F.col("k1").alias(a), F.col("k2").alias(b), F.col("n").alias(n_chunks), marks,
        F.size("whole").alias(n_removed)).withColumn(marks, F.when(F.col(marks).isNotNull(), _merged(F.coalesce(
            F.col(marks), F.array().cast("array<struct<begin:int,size:int>>")))))
    joined = keyed.join(gone, [a, b], "left").withColumn(data, column(docs, text).cast("binary"))

    # what lies between the removed spans, in order
    spot, whole = column(joined, marks), column(joined, data)

    def between(i: Column) -> Column:
        before, behind = F.get(spot, i - 1), F.get(spot, i)
        begin = F.coalesce(before["begin"] + before["size"], F.lit(0))
        return F.substring(whole, begin + 1, F.coalesce(behind["begin"], F.octet_length(whole)) - begin).cast("string")

    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size(spot)), between), "")
    return joined.select(
        *[F.when(F.col(marks).isNull(), column(docs, c)).otherwise(kept).alias(c)
          if c == text else column(docs, c) for c in docs.columns],
        F.coalesce(F.col(n_chunks), F.lit(0)).cast("long").alias(n_chunks),
        F.when(F.col(marks).isNull(), F.lit(0)).otherwise(F.col(n_removed)).cast("long").alias(n_removed))
