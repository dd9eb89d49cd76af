"""Jaccard join of shingle sets by prefixes under several global orders.

If two sets have a Jaccard similarity of at least t, then, in any order of all shingles,
the first ``n - ceil(t n) + 1`` shingles of the two (n the size of each) share one.  Here
candidates must share one under each of several orders: by document frequency, and twice
by its magnitude with different hashes behind it.  What passes every filter is verified.

* Texts with equal sets are one node.
* Shingles that only one node has come first in every order, so they are never sent on:
  a node is its number of shingles and those it shares.  A node with too few shared ones
  (under t n) is out, which most are.
* Nodes first meet the most central node of those they share prefixes with (its shingles
  are the most frequent), then groups of nodes meet as blocks of bounded size: pairs of
  blocks are listed, never pairs of nodes, and pairs already in one component are left out.
  A pair of blocks yields links that span what it connects.

Shingles are told by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm import simhash
from clauseloom.llm.graph import components
from clauseloom.llm.store import column, cut, fresh, row_key

SEED = 42
#: Shingles that a task gathers before it deals them out.
GATHER = 1 << 19
#: Nodes whose shared shingles a task unpacks together.
TOGETHER = 64
#: Shingles in a block of nodes, on average; a longer text is a block of its own.
BLOCK = 1 << 15
ORDERS = 3
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_COLUMNS = 1 << 12


def _mixed(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * factor
    return h ^ (h >> np.uint64(29))


class _Words(dict):
    """Hashes of words, each computed once; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_WORDS = _Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of the different shingles of a text, sorted."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if not tokens:
        return h
    size = min(words, len(tokens))
    out = np.full(len(tokens) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = _mixed(out, _FACTORS[0]) + h[i: i + len(out)]
    return np.unique(_mixed(out, _FACTORS[1]))


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64)) if len(found) else 0


def _nodes(text: Column, words: int) -> Column:
    @F.arrow_udf("node long, n long")
    def named(texts: pa.Array) -> pa.Array:
        sets = (shingles(t.as_py(), words) for t in texts)
        node, n = np.array([(_node(s), len(s)) for s in sets], dtype=np.int64).reshape(-1, 2).T
        return pa.StructArray.from_arrays([pa.array(node), pa.array(n)], names=["node", "n"])

    return named(text)


def _dealt(words: int, parts: int):
    """From texts: rows (part, shingle blob, owner blob), a shingle and its node once a batch."""
    def deal(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(list(sets.values()))
        owner = np.repeat(np.array(list(sets), dtype=np.int64), [len(s) for s in sets.values()])
        part = (_mixed(h, _FACTORS[2]) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        h, owner = h[order], owner[order]
        rows = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()),
             pa.array([h[bounds[p]: bounds[p + 1]].tobytes() for p in rows], pa.binary()),
             pa.array([owner[bounds[p]: bounds[p + 1]].tobytes() for p in rows], pa.binary())],
            names=["part", "shingles", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, gathered = {}, 0
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), words)
                if len(found) and (node := _node(found)) not in sets:
                    sets[node] = found
                    gathered += len(found)
                    if gathered >= GATHER:
                        yield from deal(sets)
                        sets, gathered = {}, 0
        if sets:
            yield from deal(sets)

    return run


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one part: the shingles that several nodes have, with their number of nodes."""
    h = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]])
    owner = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in frame["owners"]])
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])  # a node met in several batches
    h, owner = h[new], owner[new]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    df = np.diff(np.append(starts, len(h))).repeat(np.diff(np.append(starts, len(h))))
    keep = df > 1
    return pd.DataFrame({"node": owner[keep], "h": h[keep].view(np.int64), "df": df[keep]})


def _ranked(h: np.ndarray, df: np.ndarray, order: int) -> np.ndarray:
    """Places of shingles in one of the global orders, the same for every node."""
    if order == 0:
        return np.lexsort((h, df))
    return np.lexsort((_mixed(h, _FACTORS[order + 1]), np.log2(df).astype(np.int64)))


def _prefixes(percent: int):
    """Adds to each node its central measure and its prefix in each order (shared part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few nodes at a time: their shingles as Python numbers take ten times a batch's bytes
        for some in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            rows = []
            for row in some.to_pylist():
                h = np.array(row["h"], dtype=np.int64).view(np.uint64)
                df = np.array(row["df"], dtype=np.int64)
                by = np.argsort(h)
                h, df = h[by], df[by]
                n = row["n"]
                # own shingles stand first in every order
                length = n - -(-percent * n // 100) + 1 - (n - len(h))
                first = [h[_ranked(h, df, o)[:length]] for o in range(ORDERS)]
                rows.append({
                    "node": row["node"], "n": n, "central": float(np.log2(df).sum() / n),
                    "shingles": h.tobytes(), "prefixes": [p.view(np.int64).tolist() for p in first]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("node", pa.int64()), ("n", pa.int64()), ("central", pa.float64()), ("shingles", pa.binary()),
                ("prefixes", pa.list_(pa.list_(pa.int64())))]))

    return run


def candidate_nodes(texts: DataFrame, sizes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, n, central, shingles, prefixes) of nodes that share enough to have a partner.

    ``texts`` has one column; ``sizes`` has the number of shingles of each node.
    """
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(_dealt(words, parts), "part int, shingles binary, owners binary")
    shared = dealt.groupBy("part").applyInPandas(_shared, "node long, h long, df long")
    gathered = (
        shared.groupBy("node").agg(F.collect_list(F.struct("h", "df")).alias("s"))
        .join(sizes, "node").where(F.col("n") * percent <= 100 * F.size("s"))
        .select("node", "n", F.col("s.h").alias("h"), F.col("s.df").alias("df")))
    return cut(gathered.mapInArrow(
        _prefixes(percent), "node long, n long, central double, shingles binary, prefixes array<array<long>>"), "nodes")


def _incidence(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(known)), dtype=np.float32)
    for i, s in enumerate(sets):
        if len(s) and len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            out[i, at[known[at] == s]] = 1
    return out


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, some columns of the incidence at a time."""
    if len(one) * len(two) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in two] for a in one])
    known = np.intersect1d(np.concatenate(one), np.concatenate(two))
    out = np.zeros((len(one), len(two)))
    for at in range(0, len(known), _COLUMNS):
        part = known[at: at + _COLUMNS]
        out += _incidence(one, part) @ _incidence(two, part).T
    return out.astype(np.int64)


def _meet(percent: int):
    """Links that span what the left and the right nodes of one pair of blocks connect."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        n, m = left["n"].to_numpy(), right["n"].to_numpy()
        ok = (a[:, None] != b[None, :]) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :])
        ok &= 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
        for order in range(ORDERS):
            if ok.any():
                i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
                firsts = [[np.sort(np.asarray(p[order], dtype=np.int64)) for p in f["prefixes"].iloc[at]]
                          for f, at in ((left, i), (right, j))]
                ok[np.ix_(i, j)] &= _overlaps(*firsts) > 0
        if ok.any():
            i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            sets = [[np.frombuffer(s, dtype=np.uint64) for s in f["shingles"].iloc[at]]
                    for f, at in ((left, i), (right, j))]
            both = _overlaps(*sets)
            union = n[i][:, None] + m[j][None, :] - both
            ok[np.ix_(i, j)] &= 100 * both >= percent * union
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        links = []
        for x, y in np.argwhere(ok):
            p, q = root(int(a[x])), root(int(b[y]))
            if p != q:
                parent[q] = p
                links.append((int(a[x]), int(b[y])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _met(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Verified links of pairs (one, two) of blocks; ``nodes`` has block and root."""
    facts = ["node", "n", "root", "shingles", "prefixes"]
    # aliases give the two sides columns of their own
    left, right = (
        pairs.join(nodes.withColumnRenamed("block", side), side)
        .select(*(F.col(c).alias(c) for c in ["one", "two", *facts])).groupBy("one", "two") for side in ("one", "two"))
    return cut(left.cogroup(right).applyInPandas(_meet(percent), "a long, b long"), "links")


def _slots(nodes: DataFrame, *keys: str) -> DataFrame:
    """Adds ``block``: nodes with the same keys, dealt into blocks of bounded size."""
    many = nodes.groupBy(*keys).agg(F.sum("n").alias("many"))
    slot = F.pmod(F.xxhash64("node", F.lit("slot")), F.ceil(F.col("many") / BLOCK))
    return nodes.join(many, [*keys]).withColumn("block", F.xxhash64(*keys, slot)).drop("many")


def _stars(single: DataFrame, percent: int) -> DataFrame:
    """Verified links between nodes and their ``home``, a node as well."""
    around = _slots(single.where("node <> home"), "home")
    centre = single.join(single.select(F.col("home").alias("node")).distinct(), "node", "left_semi")
    centre = centre.withColumn("block", F.col("node"))
    stars = around.select(F.col("home").alias("one"), F.col("block").alias("two")).distinct()
    return _met(stars, centre.select(*around.columns).unionByName(around), percent)


def near_links(nodes: DataFrame, percent: int, near: DataFrame) -> DataFrame:
    """(a, b): verified links that span what the candidates connect.

    Any two nodes of a group that the links ``near`` make are candidates.  A group's nodes meet
    its least node first; then, where a group is still apart, each two of its blocks meet.
    """
    grouped = cut(nodes.drop("central").join(
        components(near).withColumnRenamed("root", "group"), "node"), "near")
    homes = grouped.groupBy("group").agg(F.min("node").alias("home"))
    known = _stars(grouped.join(homes, "group").withColumn("root", F.col("node")), percent)
    named = grouped.join(components(known), "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocked = cut(_slots(named, "group"), "near")
    kinds = cut(blocked.groupBy("group", "block").agg(
        F.min("root").alias("low"), F.max("root").alias("high")), "near")
    one, two = (kinds.select("group", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high")))
                for side in ("one", "two"))
    pairs = one.join(two, "group").where(
        "block_one <= block_two and not (low_one = high_one and low_two = high_two and low_one = low_two)")
    pairs = cut(pairs.select(F.col("block_one").alias("one"), F.col("block_two").alias("two")), "pairs")
    return known.union(_met(pairs, blocked, percent))


def links(nodes: DataFrame, percent: int, near: DataFrame | None = None) -> DataFrame:
    """(a, b): links that span every component of the nodes.

    Candidates ``near`` from elsewhere are verified first; what they connect is not compared
    again.
    """
    known = None if near is None else near_links(nodes, percent, near)
    postings = cut(nodes.select("node", "central", F.posexplode("prefixes").alias("sort", "p"))
                   .select("node", "central", "sort", F.explode("p").alias("h")), "postings")
    # the most central of those that a node shares the first order's prefix with
    heads = postings.where("sort = 0").groupBy("h").agg(
        F.max(F.struct("central", "node")).alias("head"), F.count("*").alias("many")).where("many > 1")
    homes = (postings.where("sort = 0").join(heads, "h").groupBy("node")
             .agg(F.max("head").alias("head")).select("node", F.col("head.node").alias("home")))
    placed = cut(nodes.drop("central").join(homes, "node"), "homes")
    single = placed.withColumn("root", F.col("node"))
    if known is not None:
        single = placed.join(components(known), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = _stars(single, percent)
    found = found if known is None else found.union(known)

    roots = components(found)
    named = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = named.where("node = home").select("home", F.col("root").alias("main"))
    named = named.join(main, "home", "left").withColumn("inner", F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    blocked = cut(_slots(named.drop("main"), "home", "inner"), "blocked")
    kinds = blocked.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    met = postings.join(blocked.select("node", "block"), "node").select("sort", "h", "block").distinct()
    shared = met.groupBy("sort", "h").agg(F.count("*").alias("many"))
    # a block meets itself where its nodes are of several components
    itself = kinds.where("low <> high").select(F.col("block").alias("one"), F.col("block").alias("two"))
    met = cut(met.join(shared.where("many > 1"), ["sort", "h"]).join(kinds, "block").select(
        "sort", "h", "block", "low", "high"), "met")
    other = met.select("sort", "h", *(F.col(c).alias(f"{c}2") for c in ("block", "low", "high")))
    pairs = met.join(other, ["sort", "h"]).where(
        "block < block2 and not (low = high and low2 = high2 and low = low2)")
    pairs = (pairs.groupBy("block", "block2").agg(F.count_distinct("sort").alias("sorts"))
             .where(F.col("sorts") == ORDERS).select(F.col("block").alias("one"), F.col("block2").alias("two")))
    return found.union(_met(cut(pairs.union(itself), "pairs"), blocked, percent))


def _roots(told: DataFrame, texts: DataFrame, words: int, percent: int,
           near: DataFrame | None = None) -> DataFrame:
    """(node, root) of linked nodes; ``told`` has node and n of every document."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    sizes = told.where("n > 0").groupBy("node").agg(F.max("n").alias("n"))
    return components(links(candidate_nodes(texts, sizes, words, percent), percent, near))


def _simhash_links(told: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between nodes whose fingerprints differ in few bits or not at all.

    ``told`` has node, n and fp.  Texts without words have no part in it.
    """
    worded = told.where("n > 0").select("node", "fp").distinct()
    first = cut(worded.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    alike = worded.join(first, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    one, two = (first.select(F.col("fp").alias(side), F.col("least").alias(f"node_{side}")) for side in ("a", "b"))
    near = simhash.links(first.select("fp"), distance).join(one, "a").join(two, "b")
    return cut(alike.union(near.select("node_a", "node_b")), "links")


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document.

    A document is the set of its different ``words``-word shingles, words lower-cased in
    A-Z and split at ASCII white space; fewer words are one shingle.  Two link when 100 times
    the intersection is at least ``percent`` times the union; component_id is the least id
    reachable.  Null and empty texts, and texts without words, link with nothing and are
    their own component.  Repeated rows stay repeated; null ids stay null and name a
    component only if all its ids are null.
    """
    told = cut(docs.select(column(docs, doc_id).alias("doc_id"), _nodes(column(docs, text), words).alias("s"))
               .select("doc_id", "s.node", "s.n"), "sets")
    roots = _roots(told, docs.select(column(docs, text).alias("text")), words, percent)
    rooted = told.join(roots, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, distance: int = 3, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The documents less near-duplicates: of each component the one with the least id stays.

    SimHash comes first: documents whose fingerprints over shingles of ``words`` words differ in
    at most ``distance`` bits, by themselves or through others, are candidates; all pairs of
    them that are still apart are checked by their sets of shingles, not only those with one
    head.  The exact join then finds the links that fingerprints cannot tell, among what is
    still apart.
    Components are those of ``jaccard_components``, but texts without words are one.  All
    columns are kept.  Ties in the id are broken by the text's hash; of rows alike in both
    one stays.  Null ids come last.
    """
    id_key, text_key = (fresh(n, docs) for n in ("id_key", "text_key"))
    first, second = row_key(column(docs, doc_id), column(docs, text))
    keyed = docs.withColumns({id_key: first, text_key: second})
    told = cut(keyed.select(_nodes(column(docs, text), words).alias("s"),
                            simhash.fingerprint_column(column(docs, text), words).alias("fp"),
                            column(docs, doc_id).alias("id"), F.col(id_key).alias("k1"), F.col(text_key).alias("k2"))
               .select("s.node", "s.n", "fp", "id", "k1", "k2"), "sets")
    roots = _roots(told, docs.select(column(docs, text).alias("text")), words, percent,
                   _simhash_links(told, distance))
    stays = (
        told.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2")).alias("m"))
        .select(F.col("m.k1").alias(id_key), F.col("m.k2").alias(text_key))
    )
    return (keyed.join(stays, [id_key, text_key], "left_semi")
            .dropDuplicates([id_key, text_key]).select(*[column(docs, c) for c in docs.columns]))
