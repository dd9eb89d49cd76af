"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order.  Each block of vectors keeps an
inverted file: for every pivot, the vectors that have it among their nearest, with its
place.  A query walks the lists of its own pivots, which gives the footrule distance
between the two orders (a pivot that is missing counts as one place past the last), and
the best of a block by footrule, with all that tie with the last of them, are reranked by
the cosine of the original vectors.

Equal vectors are indexed once, with the least ids of the rows that hold them, so that
copies neither fill the list to rerank nor lose their place in it.

Vectors and queries are dealt into blocks of bounded size and every block of queries
meets every block of vectors, so each task is bounded whatever the tables hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.store import column, cut

#: The pivots are a sample of this bounded size; every row is indexed with them.
PIVOTS, NEAREST = 256, 64
#: Part of a block that is reranked.  Measured recall at 5: see README.
RERANK = 0.1
BLOCK, QUERY_BLOCK = 8192, 1024
#: What a cosine of rounded unit vectors can be off by, amply.
MARGIN = 1e-9


def orders(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The ``nearest`` pivots of each unit vector, nearest first."""
    near = vectors @ pivots.T
    m = min(nearest, len(pivots))
    if m < len(pivots):
        top = np.argpartition(-near, m - 1, axis=1)[:, :m]
        top.sort(axis=1)
    else:
        top = np.broadcast_to(np.arange(m), near.shape)
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


class InvertedFile:
    """Postings of one block: per pivot, the rows that have it near and at which place."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.rows, self.m = order.shape
        by = np.argsort(order.ravel(), kind="stable")
        self.row, self.place = by // self.m, (by % self.m).astype(np.int32)
        self.begin = np.searchsorted(order.ravel()[by], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of every row to the query's order."""
        out = np.full(self.rows, self.m * (self.m + 1), dtype=np.int32)
        for i, pivot in enumerate(query.tolist()):
            at = slice(self.begin[pivot], self.begin[pivot + 1])
            # a shared pivot replaces two "missing" terms by the difference of places
            out[self.row[at]] -= 2 * (self.m - np.maximum(i, self.place[at]))
        return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    # by powers of two, so that squares of very large or small numbers stay finite and no digit is lost
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of scaled vectors with a scaled query, each summed alike in extended precision.

    Rounded to doubles only at the end, so that vectors of one direction tie wherever they lie.
    """
    a, q = vectors.astype(np.longdouble), query.astype(np.longdouble)
    score = (a * q).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((q * q).sum()))
    return score.astype(np.float64)


def _search(pivots: np.ndarray, nearest: int, k: int, rerank: float):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, given = rows["ids"].to_numpy(), _scaled(np.stack(rows["vector"].to_numpy()))
            vectors = _units(given)
            least, many = np.array([x[0] for x in ids]), np.array([len(x) for x in ids])
            file = InvertedFile(orders(vectors, pivots, nearest), len(pivots))
            whole = _scaled(np.stack(queries["vector"].to_numpy()))
            asked = _units(whole)
            count = min(len(ids), max(8 * k, int(np.ceil(rerank * len(ids)))))
            for q, own, vector, order in zip(queries["vec_id"].tolist(), whole, asked, orders(asked, pivots, nearest)):
                far = file.footrule(order)
                near = np.flatnonzero((far <= np.partition(far, count - 1)[count - 1]) & ~((many == 1) & (least == q)))
                if not len(near):
                    continue
                score = vectors[near] @ vector
                # the k best different vectors and what ties with them hold the k best rows
                most = min(k, len(near))
                best = near[score >= -np.partition(-score, most - 1)[most - 1] - MARGIN]
                found = [(-s, i) for b, s in zip(best.tolist(), cosines(given[best], own).tolist())
                         for i in ids[b].tolist() if i != q]
                out += [(q, i, -s) for s, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _exact(k: int):
    pivots = np.zeros((1, 1))

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        inner = _search(np.zeros((1, len(rows["vector"].iloc[0]))) if len(rows) else pivots, 1, k, 1.0)
        return inner(queries, rows)

    return run


def _meet(queries: DataFrame, rows: DataFrame, search, block: int, query_block: int) -> DataFrame:
    """Every block of queries with every block of rows."""
    n, q = rows.count(), queries.count()
    blocks, asked = max(1, -(-n // block)), max(1, -(-q // query_block))
    deal = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many))
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = queries.withColumns({"q": deal(asked).cast("int"), "b": every(blocks)})
    right = rows.withColumns({"b": deal(blocks).cast("int"), "q": every(asked)})
    return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(
        search, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(table: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id",
                       vector: str = "embedding", pivots: int = PIVOTS, nearest: int = NEAREST,
                       rerank: float = RERANK, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    those with the query's id.  The score is the cosine in double precision, ties go to
    the smaller id.  Rows with a null id, and vectors that are null, zero, of another
    length than most, or that hold a null or non-finite component, take no part.  Of rows
    alike in id and vector one takes part.  A query for which fewer than k are found
    although more rows exist is answered by comparing it with all rows, in blocks.
    """
    data = table.select(column(table, vec_id).cast("long").alias("vec_id"),
                        F.transform(column(table, vector), lambda x: x.cast("double")).alias("vector"))
    bound = float("inf")
    data = data.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == bound)) & F.exists("vector", lambda x: x != 0))
    data = cut(data.distinct(), "vectors")
    usual = data.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is not None:
        data = data.where(F.size("vector") == usual["n"])
    queries = data.where(F.pmod("vec_id", F.lit(every)) == 0)
    n = data.count()
    # of the rows that hold a vector no answer takes more than k, besides the query itself
    alike = Window.partitionBy("vector").orderBy("vec_id")
    heads = cut(data.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1)
                .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                .withColumn("vec_id", F.col("ids")[0]), "heads")
    different = heads.count()
    # small tables get so few pivots that every two orders share one
    many = max(1, min(pivots, different, max(nearest, different // 16)))
    sample = [r[0] for r in heads.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(many)
              .select("vector").collect()]
    fitted = _units(np.array(sample)) if sample else np.zeros((1, 1))
    found = _meet(queries, heads, _search(fitted, nearest, k, rerank), block, query_block)
    found = cut(_best(found, k), "found")
    have = found.groupBy("query_id").count()
    short = queries.join(have.where(F.col("count") >= min(k, n - 1)), queries.vec_id == have.query_id, "left_anti")
    short = cut(short, "short")
    if n > 1 and not short.isEmpty():
        again = _best(_meet(short, heads, _exact(k), block, query_block), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti") \
            .select("query_id", "vec_id", "score", "rank").union(again.select("query_id", "vec_id", "score", "rank"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
