"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are pairs of neighbouring words, edges are the longest grams (three words) between
overlapping nodes, and a last edge leads from the last pair of a piece to its end.  Edges
are summed per task before they are shuffled, packed in binary blocks, and once more per
part.  Shorter counts follow from the flow: a pair occurs as often as edges leave its
node, ends of pieces included; a word occurs as often as pairs begin with it, and once
more for each piece that it ends.

Edges and pairs are dealt out by their node.  A node that has very many edges within one
task is dealt out by edge instead; such edges carry their count below zero, and the node's
own part gets a note, so that no partial count of it is dropped before they are added.  Words are told by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut

SEED = 42
#: Tokens (words and ends) that a task gathers before it deals their edges out.
GATHER = 1 << 20
#: Edges of one node in one gathering from which the node is spread.
SPREAD = 1 << 12
_END = 0  # the third word of an edge that ends a piece
_SPLIT = 1  # no edge: says that a node is spread
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"." * 9 + b" ")
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SCHEMA = "kind int, lang string, a long, b long, c long, word string, f long"
EDGE, NODE, WORD, TOTAL = range(4)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for part, factor in zip(parts, _FACTORS):
        out = (out ^ part ^ (out >> np.uint64(29))) * factor
    return out ^ (out >> np.uint64(32))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z, with ``.`` where a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . ").split()


class _Gathering:
    """Words numbered as they come, per language; 0 is the end of a piece."""

    def __init__(self):
        self.names, self.known, self.parts, self.size = [None], {}, [], 0

    def add(self, lang: str, text: str | None):
        known = self.known.setdefault(lang, _Numbers(lang, self.names))
        said = tokens(text)
        if not said:
            return
        self.parts.append(np.fromiter(map(known.__getitem__, said), dtype=np.int64, count=len(said)))
        self.parts.append(np.zeros(1, dtype=np.int64))
        self.size += len(said) + 1

    def edges(self) -> tuple[np.ndarray, ...]:
        """(a, b, c, f) of different edges, c = 0 at ends, and f per word, by number."""
        line = np.concatenate([np.zeros(1, dtype=np.int64), *self.parts, np.zeros(1, dtype=np.int64)])
        a, b, c = line[:-2], line[1:-1], line[2:]
        pair = (a > 0) & (b > 0)
        many = len(self.names)
        pairs, c = a[pair] * many + b[pair], c[pair]
        if many >> 21:  # three numbers do not fit in 63 bits
            pairs, numbers = np.unique(pairs, return_inverse=True)
            key, f = np.unique(numbers * many + c, return_counts=True)
            pairs = pairs[key // many]
        else:
            key, f = np.unique(pairs * many + c, return_counts=True)
            pairs = key // many
        a, b, c = pairs // many, pairs % many, key % many
        # a word: the flow of the nodes it begins, and the pieces it ends
        words = np.bincount(a, weights=f, minlength=many) + np.bincount(
            line[:-1][(line[:-1] > 0) & (line[1:] == 0)], minlength=many)
        return a, b, c, f, words.astype(np.int64)


class _Numbers(dict):
    def __init__(self, lang: str, names: list):
        super().__init__({b".": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append((self.lang, word))
        return at


def _name(lang: str, word: bytes) -> int:
    # 0 and 1 are taken
    return max(2, xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, SEED))


def _dealt(parts: int):
    fields = [("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcf"),
              ("lang", pa.list_(pa.string())), ("word", pa.list_(pa.string()))]
    schema = pa.schema(fields)

    def deal(held: _Gathering) -> Iterator[pa.RecordBatch]:
        a, b, c, f, words = held.edges()
        names = np.array([_END] + [_name(*n) for n in held.names[1:]], dtype=np.uint64)
        node = _mixed(names[a], names[b])
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else a
        many = np.diff(np.append(starts, len(a)))
        spread = many.repeat(many) > SPREAD if len(a) else np.zeros(0, dtype=bool)
        told = starts[many > SPREAD]
        by = np.where(spread, _mixed(names[a], names[b], names[c]), node)
        edge = [np.concatenate(x) for x in (
            (names[a], names[a[told]]), (names[b], names[b[told]]),
            (names[c], np.full(len(told), _SPLIT, dtype=np.uint64)),
            (np.where(spread, -f, f), np.zeros(len(told), dtype=np.int64)))]
        part = (np.concatenate((by, node[told])) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        edge = [x[order] for x in edge]
        at_word = (names % np.uint64(parts)).astype(np.int64)
        at_word[0] = -1
        by_word = np.argsort(at_word, kind="stable")
        word_bounds = np.searchsorted(at_word[by_word], np.arange(parts + 1))
        rows = []
        for p in range(parts):
            low, high = bounds[p], bounds[p + 1]
            if low < high:
                rows.append({"part": p, "kind": EDGE, **{k: x[low:high].tobytes() for k, x in zip("abcf", edge)}})
            chosen = by_word[word_bounds[p]: word_bounds[p + 1]]
            if len(chosen):
                said = [held.names[i] for i in chosen]
                rows.append({"part": p, "kind": WORD, "a": names[chosen].tobytes(), "f": words[chosen].tobytes(),
                             "lang": [x for x, _ in said],
                             "word": [w.decode("utf-8", "surrogatepass") for _, w in said]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathering()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                held.add(lang.as_py(), text.as_py())
                if held.size >= GATHER or len(held.names) >= 1 << 19:
                    yield from deal(held)
                    held = _Gathering()
        if held.size:
            yield from deal(held)

    return run


def _summed(least: int):
    """One part: edges, flows of nodes and words from ``least`` on, and all words by language."""
    names = ["kind", "lang", "a", "b", "c", "word", "f"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=kind), *(np.frombuffer(x.as_buffer(), dtype=kind) for x in column)])

    def rows(kind: int, f, **values) -> pa.Table:
        values |= {"kind": np.full(len(f), kind, dtype=np.int32), "f": f}
        return pa.table([pa.array(values[n], t) if n in values else pa.nulls(len(f), t)
                         for n, t in zip(names, types)], schema=schema)

    def of_edges(frame: pa.Table) -> Iterator[pa.Table]:
        a, b, c = (joined(frame[x], np.uint64) for x in "abc")
        f = joined(frame["f"], np.int64)
        order = np.lexsort((c, b, a))
        a, b, c, f = (x[order] for x in (a, b, c, f))
        split = (c == _SPLIT) | (f < 0)
        f = np.abs(f)
        node = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        edge = np.flatnonzero(node | np.concatenate(([True], c[1:] != c[:-1])))
        partial = np.logical_or.reduceat(split, np.flatnonzero(node))  # by node
        flow = np.add.reduceat(f, edge)
        keep = (flow >= least) | partial[np.cumsum(node)[edge] - 1]
        keep &= (c[edge] != _END) & (c[edge] != _SPLIT)
        at = edge[keep]
        yield rows(EDGE, flow[keep], **{k: x[at].view(np.int64) for k, x in zip("abc", (a, b, c))})
        node = np.flatnonzero(node)
        flow = np.add.reduceat(f, node)
        keep = (flow >= least) | partial
        at = node[keep]
        yield rows(NODE, flow[keep], a=a[at].view(np.int64), b=b[at].view(np.int64))

    def of_words(frame: pa.Table) -> Iterator[pa.Table]:
        every = pd.DataFrame({
            "a": joined(frame["a"], np.uint64).view(np.int64), "f": joined(frame["f"], np.int64),
            "lang": [x for y in frame["lang"].to_pylist() for x in y],
            "word": [x for y in frame["word"].to_pylist() for x in y]})
        every = every.groupby(["a", "lang", "word"], as_index=False)["f"].sum()
        total = every.groupby("lang", as_index=False)["f"].sum()
        yield rows(TOTAL, total["f"], lang=total["lang"])
        every = every[every["f"] >= least]
        yield rows(WORD, every["f"], a=every["a"], lang=every["lang"], word=every["word"])

    def run(frame: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        for kind, of in ((EDGE, of_edges), (WORD, of_words)):
            part = frame.filter(pc.equal(frame["kind"], kind))
            if part.num_rows:
                out += of(part)
        return pa.concat_tables(out)

    return run


def grams(docs: DataFrame, least: int, lang: str, text: str) -> DataFrame:
    """The graph: edges, nodes (both partial) and words that occur ``least`` times, and totals."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = docs.select(F.coalesce(column(docs, lang), F.lit("und")).alias("lang"), column(docs, text).alias("text"))
    dealt = said.mapInArrow(_dealt(parts), "part int, kind int, a binary, b binary, c binary, f binary, "
                                           "lang array<string>, word array<string>")
    return cut(dealt.groupBy("part").applyInArrow(_summed(least), _SCHEMA), "grams")


def unary_paths(edges: DataFrame) -> DataFrame:
    """(words, f): edges (a, b, c, f) compacted along nodes with one way in and one way out.

    Edges are joined where their counts are equal too, so a path says the count of each of
    its edges.  Starts are found by doubling steps.  What only leads in a circle stays
    apart: it is what a round leaves as it was.
    """
    edges = edges.withColumn("edge", F.xxhash64("a", "b", "c"))
    into = edges.groupBy(F.col("b").alias("x"), F.col("c").alias("y")).agg(
        F.count("*").alias("ways"), F.max("edge").alias("at"), F.max("f").alias("flow")).where("ways = 1")
    out = edges.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(
        F.count("*").alias("ways"), F.max("edge").alias("edge"), F.max("f").alias("flow")).where("ways = 1")
    before = into.drop("ways").join(out.drop("ways"), ["x", "y", "flow"]).where("at <> edge").select("edge", "at")
    steps = cut(edges.select("edge").join(before, "edge", "left").select(
        "edge", F.coalesce("at", "edge").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("place"),
        F.col("at").isNull().alias("done")), "steps")
    left = steps.where("not done").count()
    while left:
        further = steps.select(F.col("edge").alias("at"), F.col("at").alias("to"), F.col("place").alias("more"),
                               F.col("done").alias("ended"))
        steps = cut(steps.where("done").unionByName(
            steps.where("not done").join(further, "at").select(
                "edge", F.col("to").alias("at"), (F.col("place") + F.col("more")).alias("place"),
                F.col("ended").alias("done"))), "steps")
        now = steps.where("not done").count()
        if now == left:
            break
        left = now
    start = F.when(F.col("done"), F.col("at")).otherwise(F.col("edge"))
    placed = edges.join(steps, "edge").select(start.alias("path"), F.when(F.col("done"), F.col("place")).otherwise(0)
                                              .alias("place"), "a", "b", "c", "f")
    return placed.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("place", "a", "b", "c"))).alias("e"), F.max("f").alias("f")).select(
        F.concat(F.array(F.col("e")[0]["a"], F.col("e")[0]["b"]), F.col("e.c")).alias("words"), "f")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50, lang: str = "lang",
                 text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words per language.

    Texts are lower-cased in A-Z, split into pieces at ``.,;:!?`` and ASCII line ends, and
    pieces into words at spaces and tabs.  A phrase that occurs a times (at least ``least``)
    is cut after its first k words into parts that occur l and r times; its score is
    floor(1000000 a a / (l r)) of the lowest cut.  A pair that lies in a phrase of three
    words with at least ``covered`` percent of its count is dropped.  The first ``top`` by
    score, count and phrase stay, so ties end with the phrase.

    Null languages are ``und``, null texts are empty; repeated rows count as often as they
    stand there.  Sums are decimals of 38 digits.
    """
    graph = grams(docs, least, lang, text)
    word = graph.where(F.col("kind") == WORD).select("lang", F.col("a").alias("name"), "word", "f")
    total = graph.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("f").alias("n"))
    node, edge = (cut(graph.where(F.col("kind") == kind).groupBy(*keys).agg(F.sum("f").alias("f"))
                      .where(F.col("f") >= least), "summed") for kind, keys in ((NODE, "ab"), (EDGE, "abc")))

    def score(l: str, r: str) -> Column:
        return F.expr(f"(cast(1000000 as decimal(7, 0)) * cast(f as decimal(15, 0)) * cast(f as decimal(15, 0))) "
                      f"div (cast({l} as decimal(18, 0)) * cast({r} as decimal(18, 0)))")

    x, y = (word.select(F.col("name").alias(k), F.col("word").alias(f"{k}_word"), F.col("f").alias(f"{k}_f"),
                        *(["lang"] if k == "a" else [])) for k in "ab")
    longer = edge.select("a", "b", F.col("f").alias("longer")).union(edge.select("b", "c", "f")).groupBy("a", "b").agg(
        F.max("longer").alias("longer"))
    two = node.join(longer, ["a", "b"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f"))).join(x, "a").join(y, "b").select(
        "lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("f").alias("a"), F.col("a_f").alias("l"),
        F.col("b_f").alias("r"), score("a_f", "b_f").alias("score"))

    path = unary_paths(edge).withColumn("path", F.xxhash64("words"))
    said = path.select("path", "f", F.posexplode("words").alias("place", "name")).join(word.withColumnRenamed(
        "f", "word_f"), "name")
    whole = said.groupBy("path").agg(
        F.max("f").alias("f"), F.max("lang").alias("lang"),
        F.sort_array(F.collect_list(F.struct("place", "name", "word", "word_f"))).alias("w"))
    triple = whole.select("lang", "f", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 3)).alias("i")).select(
        "lang", "f", *(F.col("w")[F.col("i") + k].alias(v) for k, v in enumerate("xyz")))
    first, last = (node.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("f").alias(k)) for k in ("xy", "yz"))
    flows = triple.withColumns({"p": F.col("x.name"), "q": F.col("y.name")}).join(first, ["p", "q"]).withColumns(
        {"p": F.col("y.name"), "q": F.col("z.name")}).join(last, ["p", "q"])
    cuts = flows.select(
        "lang", F.concat_ws(" ", "x.word", "y.word", "z.word").alias("phrase"), "f",
        F.struct(score("x.word_f", "yz").alias("score"), F.lit(1).alias("k"), F.col("x.word_f").alias("l"), F.col("yz").alias("r")).alias("one"),
        F.struct(score("xy", "z.word_f").alias("score"), F.lit(2).alias("k"), F.col("xy").alias("l"), F.col("z.word_f").alias("r")).alias("two"))
    three = cuts.withColumn("s", F.when(F.col("one.score") <= F.col("two.score"), F.col("one")).otherwise(F.col("two"))).select(
        "lang", "phrase", F.col("f").alias("a"), "s.l", "s.r", "s.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
