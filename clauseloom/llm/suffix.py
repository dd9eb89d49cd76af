"""Removal of repeated byte strings, found with Burrows-Wheeler transforms.

A string of LENGTH bytes is repeated if it also starts anywhere else.  Two equal strings
share their least k-gram (by hash) at the same place, so all strings of a text are dealt
out by that k-gram: consecutive strings with the same one form a segment, and every
string lies in exactly one.  Only segments whose k-gram occurs elsewhere can matter.
Those that are equal as a whole fold into one; the others, k-gram by k-gram, are put
together, sorted into a Burrows-Wheeler transform, and intervals of common prefixes are
extended backwards, one byte at a time, breadth first, until the prefix has LENGTH bytes.
What is still in an interval with another suffix is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut, row_key

LENGTH, GRAM = 200, 16
#: Bytes that one transform holds, unless one k-gram alone has more.
TEXT = 1 << 16
#: Bytes by which prefixes grow once they have as many; a power of two.
WORD = 8
#: Different segments of one k-gram beyond which its strings are counted one by one.
HOT = 20_000
_PIECE = 1 << 17
_POWER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(2 * _PIECE + (1 << 12), int(_POWER))
_DOWN = _powers(2 * _PIECE + (1 << 12), pow(int(_POWER), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH,
             gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(piece, start, count, gram_hash, content_hash) of the segments of pieces of a buffer.

    Piece i is buffer[begin[i]:end[i]]; pieces lie end to end.  A segment is ``count``
    strings that start at ``start`` and behind; both hashes follow the bytes alone.
    """
    n = len(buffer)
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    span = length - gram + 1
    if n < length:
        return empty
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buffer] * _UP[:n], out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1])
    # the hash above, the place below: the least is the first of the least
    bits = np.uint64(19)
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    m = len(key)
    blocks = -(-m // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:m] = key
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - span + 1], ahead[span - 1: m]) & ((np.uint64(1) << bits) - np.uint64(1))
    # strings that stay inside their piece
    piece = np.repeat(np.arange(len(begin)), end - begin)[: len(least)]
    inside = np.arange(len(least)) + length <= end[piece]
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return empty
    marks = np.append(starts, len(least))
    counts = np.add.reduceat(inside.astype(np.int64), starts) if len(starts) else starts
    counts = np.minimum(counts, marks[1:] - marks[:-1])
    at = least[starts].astype(np.int64)
    stop = starts + counts + length - 1
    content = _mixed((sums[stop] - sums[starts]) * _DOWN[starts] + (stop - starts).astype(np.uint64)
                     + (at - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return piece[starts], starts - begin[piece[starts]], counts, grams[at].view(np.int64), content.view(np.int64)


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings laid end to end, by doubling of prefixes.

    ``text`` has 1 to 256 for bytes and 0 behind each string, at ``ends``.  These marks
    count as all different, in their order.
    """
    n, first = len(text), 5
    wide = np.concatenate((text, np.zeros(first, text.dtype))).astype(np.uint64)
    which = np.repeat(np.arange(1, len(ends) + 1), np.diff(np.concatenate(([-1], ends))))
    to_end = ends[which - 1] - np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(first):
        key = (key << np.uint64(9)) | np.where(to_end >= j, wide[j: n + j], 0)
    key = (key << np.uint64(19)) | np.where(to_end < first, which, 0).astype(np.uint64)
    order = np.argsort(key)
    place = np.arange(n)
    change = np.ones(n, dtype=bool)
    change[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, place, 0))
    tied = np.flatnonzero(~change | np.append(~change[1:], False))
    known = first
    while len(tied):
        mine = order[tied]
        key = (rank[mine] << 32) | rank[mine + known]
        sort = np.argsort(key)
        mine, key = mine[sort], key[sort]
        order[tied] = mine
        change = np.ones(len(tied), dtype=bool)
        change[1:] = key[1:] != key[:-1]
        rank[mine] = np.maximum.accumulate(np.where(change, tied, 0))
        tied = tied[~change | np.append(~change[1:], False)]
        known *= 2
    return order


def repeated_suffixes(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where the strings of ``length`` bytes start that occur at least twice.

    Intervals of suffixes with a common prefix are numbered along the transform.  Two
    neighbours in an interval stay together for one byte more if, one step along the
    transform, they fall in one interval of the level before.  Once all prefixes of WORD
    bytes are known, each level extends by a word instead of a byte.
    """
    order = suffix_array(text, ends).astype(np.int32)
    transform = text[order - 1]
    step = np.argsort(transform, kind="stable").astype(np.int32)  # inverse of the last-to-first map
    head = text[order]
    split = np.ones(len(text), dtype=bool)
    split[1:] = (head[1:] != head[:-1]) | (head[1:] == 0)
    open_ = np.flatnonzero(~split).astype(np.int32)
    known, stride = 1, 1
    upper, lower = step[open_], step[open_ - 1]
    while known < length and len(open_):
        if stride == 1 and known >= WORD and (length - known) % WORD == 0:
            stride = WORD
            for _ in range(WORD.bit_length() - 1):
                step = step[step]
            upper, lower = step[open_], step[open_ - 1]
        interval = np.cumsum(split, dtype=np.int32)
        apart = interval[upper] != interval[lower]
        known += stride
        if apart.any():
            split[open_[apart]] = True
            together = ~apart
            open_, upper, lower = open_[together], upper[together], lower[together]
    return np.union1d(order[open_], order[open_ - 1]).astype(np.int64)


def _segment_rows(length: int, gram: int):
    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int64()), ("c", pa.int64()),
                       ("start", pa.int32()), ("n", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, shifts, parts, size = [], [], [], 0

            def flush():
                nonlocal rows, shifts, parts, size
                end = np.cumsum([len(p) for p in parts])
                begin = end - [len(p) for p in parts]
                found = segments(np.frombuffer(b"".join(parts), dtype=np.uint8), begin, end, length, gram)
                piece, start, n, a, c = found
                row = np.array(rows, dtype=np.int64)[piece]
                start = start + np.array(shifts, dtype=np.int64)[piece]
                rows, shifts, parts, size = [], [], [], 0
                return pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(
                        (k1[row], k2[row], a, c, start, n), kinds.types)], schema=kinds)

            for i, data in enumerate(batch.column(2).to_pylist()):
                for at in range(0, len(data) - length + 1, _PIECE):
                    rows.append(i)
                    shifts.append(at)
                    parts.append(data[at: at + _PIECE + length - 1])
                    size += len(parts[-1])
                    if size >= _PIECE:
                        yield flush()
            if parts:
                yield flush()

    return run, "k1 long, k2 long, a long, c long, start int, n short"


def _transform_rows(length: int, limit: int):
    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def spans(k1, k2, start, bodies: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
        text = np.frombuffer(b"\0".join(bodies) + b"\0", dtype=np.uint8).astype(np.int16) + 1
        text[ends] = 0
        hits = repeated_suffixes(text, ends, length)
        which = np.searchsorted(ends, hits)
        begins = np.concatenate(([0], ends[:-1] + 1))
        first = np.ones(len(hits), dtype=bool)
        first[1:] = (hits[1:] != hits[:-1] + 1) | (which[1:] != which[:-1])
        last = np.append(first[1:], True)[: len(hits)]
        which = which[first]
        shift = start[which] - begins[which]
        return pa.RecordBatch.from_arrays([
            pa.array(k1[which]), pa.array(k2[which]), pa.array((hits[first] + shift).astype(np.int32)),
            pa.array((hits[last] + shift + length).astype(np.int32))], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush(whole: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held)
            a = table["a"].to_numpy()
            stop = len(a) if whole else int(np.searchsorted(a, a[-1]))  # the last k-gram may go on
            rest = table.slice(stop)
            table = table.slice(0, stop)
            held, size = rest.to_batches(), rest.nbytes if rest.num_rows else 0
            bodies = table["body"].to_pylist()
            k1, k2, start = (table[c].to_numpy() for c in ("k1", "k2", "start"))
            a = a[:stop]
            upto, low = np.cumsum([len(b) for b in bodies]), 0
            while low < len(bodies):
                base = upto[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(upto, base + limit)))
                if high < len(bodies):  # whole k-grams only
                    high = max(int(np.searchsorted(a, a[high - 1], "right")), low + 1)
                yield spans(k1[low:high], k2[low:high], start[low:high], bodies[low:high])
                low = high

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 16 * limit:
                yield from flush(whole=False)
        if held and size:
            yield from flush(whole=True)

    return run, "k1 long, k2 long, begin int, end int"


def _counted(bodies: DataFrame, length: int) -> DataFrame:
    """The same spans for segments of very frequent k-grams, in column functions.

    Every string is hashed to 128 bits and counted; sums are partial, so that no task
    meets all strings of the k-gram.
    """
    each = bodies.select("k1", "k2", "start", "body", F.explode(
        F.sequence(F.lit(0), F.octet_length("body") - length)).alias("i"))
    each = each.select("k1", "k2", (F.col("start") + F.col("i")).alias("begin"), F.expr(
        f"substring(body, i + 1, {length})").alias("s"))
    each = each.select("k1", "k2", "begin", F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("g"))
    again = each.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
    return each.join(again, ["h", "g"]).select(
        "k1", "k2", "begin", (F.col("begin") + length).cast("int").alias("end"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM, limit: int = TEXT, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): per document with repeats, spans (begin, end) that cover them.

    k1 and k2 are the row's keys; spans may touch or overlap, and lie in bytes.
    """
    k1, k2 = row_key(column(docs, doc_id), column(docs, text))
    data = F.coalesce(column(docs, text), F.lit("")).cast("binary")
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), column(docs, doc_id).cast("long").alias("doc_id"),
                        data.alias("data"))
    run, ddl = _segment_rows(length, gram)
    long = keyed.where(F.octet_length("data") >= length).select("k1", "k2", "data")
    rows = cut(long.mapInArrow(run, ddl), "segments")
    # written, so that a very frequent k-gram can be split in the join that follows
    often = cut(rows.groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "often")
    rows = cut(rows.join(often, "a"), "repeated")
    different = rows.groupBy("a", "c").agg(
        F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start", "n")).alias("r"))
    different = cut(different, "different")
    equal = rows.join(different.where("times > 1").select("a", "c"), ["a", "c"]).select(
        "k1", "k2", F.col("start").alias("begin"), (F.col("start") + F.col("n") + length - 1).cast("int").alias("end"))
    several = different.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a")
    open_ = different.join(several, "a").select("a", "r.*")
    per = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "start", "n")).alias("s"))
    # with the same columns as the join in _removed, so that texts are shuffled once for both
    bodies = keyed.join(per, ["k1", "k2"]).select("k1", "k2", "doc_id", "data", F.explode("s").alias("s")).select(
        "k1", "k2", "doc_id", "s.a", "s.start", F.expr(f"substring(data, s.start + 1, s.n + {length - 1})").alias("body"))
    crowded = open_.groupBy("a").count().where(F.col("count") > hot).select("a")
    crowded = cut(crowded, "crowded")
    run, ddl = _transform_rows(length, limit)
    if crowded.isEmpty():
        few, many = bodies, None
    else:
        bodies = cut(bodies, "bodies")
        few, many = bodies.join(crowded, "a", "left_anti"), bodies.join(crowded, "a", "left_semi")
    found = few.repartition("a").sortWithinPartitions("a").mapInArrow(run, ddl)
    found = equal.union(found)
    if many is not None:
        found = found.union(_counted(many, length))
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for begin, end in runs:
        out.append(data[at:begin])
        at = end
    return b"".join([*out, data[at:]])


def _removed(docs: DataFrame, doc_id: str, text: str, make, ddl: str, **options) -> DataFrame:
    k1, k2 = row_key(column(docs, doc_id), column(docs, text))
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), column(docs, doc_id).cast("long").alias("doc_id"),
                        F.coalesce(column(docs, text), F.lit("")).cast("binary").alias("data"))
    spans = repeated_spans(docs, doc_id, text, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [merged([(s["begin"], s["end"]) for s in x or ()]) for x in batch.column(2).to_pylist()]
            yield make(doc, data, found)

    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans").mapInArrow(run, ddl)


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document.

    Null texts are empty and texts shorter than ``length`` lose nothing; repeated rows
    are repeats of each other and come out as often as they go in; null ids stay null.
    """
    def make(doc, data, found):
        return pa.RecordBatch.from_arrays([
            pa.array(doc, pa.int64()), pa.array(map(len, data), pa.int64()),
            pa.array([sum(e - b for b, e in runs) for runs in found], pa.int64()),
            pa.array(map(len, found), pa.int64()),
            pa.array([hashlib.sha256(_kept(d, r)).hexdigest() for d, r in zip(data, found)], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _removed(docs, doc_id, text, make,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, kept, spans): the remaining bytes and the removed runs (begin, end)."""
    def make(doc, data, found):
        return pa.RecordBatch.from_arrays([
            pa.array(doc, pa.int64()), pa.array([_kept(d, r) for d, r in zip(data, found)], pa.binary()),
            pa.array([[{"begin": b, "end": e} for b, e in runs] for runs in found],
                     pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "kept", "spans"])

    return _removed(docs, doc_id, text, make,
                    "doc_id long, kept binary, spans array<struct<begin: bigint, end: bigint>>", **options)
