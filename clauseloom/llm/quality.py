"""A byte-level convolutional network for quality, written in numpy.

Bytes become vectors of EMBED numbers; FILTERS learned filters look at chunks of WIDTH
bytes that start every STRIDE bytes and so overlap and cover the whole document; each
filter's largest answer goes through a ReLU into one logistic unit.  It is trained on
the driver on a bounded sample of labelled documents, with a fixed number of steps, and
applied to every whole text in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.llm.store import column

EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 2, 24
#: The training sample: labelled documents, whole, and their bytes together (what the driver
#: holds); mini-batches and their size.
SAMPLE_DOCS, SAMPLE_BYTES, STEPS, BATCH = 4096, 268_435_456, 900, 32
THRESHOLD = 0.7
_PIECE = 1 << 16


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class ByteNet:
    """The network; ``parameters`` is a dict of small arrays."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters
        # one product per pair of bytes for all places in a chunk that the pair can take
        w = parameters["filters"].reshape(WIDTH // STRIDE, STRIDE * EMBED, FILTERS)
        self._w = np.ascontiguousarray(w.transpose(1, 0, 2).reshape(STRIDE * EMBED, -1))

    @staticmethod
    def start(seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return ByteNet({
            "embed": draw(256, EMBED, scale=0.5), "filters": draw(WIDTH, EMBED, FILTERS, scale=0.2),
            "shift": np.zeros(FILTERS, np.float32), "weights": draw(FILTERS, scale=0.3),
            "bias": np.zeros(1, np.float32)})

    def strongest(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest answer, and the bytes of the chunk that gave it."""
        data = b"\0" * STRIDE + data + b"\0" * (WIDTH + len(data) % STRIDE)
        codes = np.frombuffer(data, dtype=np.uint8)
        best, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        reach = WIDTH // STRIDE
        for at in range(0, len(codes) - WIDTH + 1, _PIECE):
            piece = codes[at: at + _PIECE + WIDTH - STRIDE]
            if len(piece) < WIDTH:
                break
            pairs = len(piece) // STRIDE
            rows = self.p["embed"][piece[: pairs * STRIDE]].reshape(pairs, STRIDE * EMBED) @ self._w
            n = pairs - reach + 1
            answer = rows[:n, :FILTERS].copy()
            for j in range(1, reach):
                answer += rows[j: j + n, j * FILTERS: (j + 1) * FILTERS]
            top = answer.argmax(axis=0)
            value = answer[top, np.arange(FILTERS)]
            better = value > best
            best[better], where[better] = value[better], at + STRIDE * top[better]
        return best, codes[where[:, None] + np.arange(WIDTH)]

    def _unit(self, answers: np.ndarray) -> np.ndarray:
        pooled = np.maximum(answers + self.p["shift"], 0)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.p["weights"] + self.p["bias"][0], -30, 30).astype(np.float64)))

    def score(self, text: str | bytes | None) -> float:
        """Rounded, so that the order of sums in a linear algebra library cannot show."""
        data = text if isinstance(text, bytes) else _bytes(text)
        return round(float(self._unit(self.strongest(data)[0])), 6)

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        found = [self.strongest(t) for t in texts]
        answers, chunks = np.stack([f[0] for f in found]), np.stack([f[1] for f in found])
        p = self.p
        error = ((self._unit(answers) - y) / len(y)).astype(np.float32)
        pooled = np.maximum(answers + p["shift"], 0)
        back = error[:, None] * p["weights"] * (pooled > 0)
        seen = p["embed"][chunks]  # document, filter, place, number
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, chunks, back[:, :, None, None] * p["filters"].transpose(2, 0, 1))
        return {"embed": embed, "filters": np.einsum("bf,bfwe->wef", back, seen), "shift": back.sum(axis=0),
                "weights": error @ pooled, "bias": np.array([error.sum()], np.float32)}


def train(texts: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, seed: int = 7,
          rate: float = 0.01) -> ByteNet:
    """Adam over ``steps`` mini-batches; with no labelled text, the untrained network."""
    net = ByteNet.start(seed)
    if not texts:
        return net
    rng, y = np.random.default_rng(seed), np.asarray(labels, dtype=np.float64)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    order: list[int] = []
    for step in range(1, steps + 1):
        while len(order) < batch:
            order += rng.permutation(len(texts)).tolist()
        pick, order = order[:batch], order[batch:]
        grad = net.gradients([texts[i] for i in pick], y[pick])
        now = rate * (1 - 0.9 * step / steps)
        fresh = {}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            fresh[k] = (net.p[k] - now * (m[k] / (1 - 0.9 ** step))
                        / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        net = ByteNet(fresh)
    return net


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, steps: int = STEPS) -> ByteNet:
    """Train on at most ``sample_docs`` labelled documents outside the held-out fold, whole.

    Labels are 0 or 1; other values, null ids and ids labelled both ways are left out.
    Documents are taken in order of a hash; one that would bring the sample over
    ``sample_bytes`` is left out of it, whole.  Rows alike in id and text count once.
    """
    known = labels.select(column(labels, doc_id).alias("id"), column(labels, label).cast("int").alias("y"))
    known = (known.where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
             .orderBy(F.xxhash64("id"), "id").limit(sample_docs).select("id", "y"))
    # a bounded table, sent to every task rather than moving the texts
    texts = docs.select(column(docs, doc_id).alias("id"), F.coalesce(column(docs, text), F.lit("")).alias("t")) \
        .join(F.broadcast(known), "id").select("id", "y", "t", F.xxhash64("t").alias("h"))
    heads = texts.groupBy("id", "h").agg(F.max(F.octet_length("t")).alias("n")) \
        .orderBy(F.xxhash64("id"), "id", "h").limit(sample_docs).collect()
    wanted, total = [], 0
    for r in heads:
        if total + r["n"] <= sample_bytes:
            total += r["n"]
            wanted.append((r["id"], r["h"]))
    if not wanted:
        return train([], [], steps)
    chosen = docs.sparkSession.createDataFrame(
        wanted, T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("h", T.LongType())]))
    rows = texts.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h").agg(
        F.first("y").alias("y"), F.first(F.col("t").cast("binary")).alias("t")).orderBy("id", "h").collect()
    return train([bytes(r["t"]) for r in rows], [r["y"] for r in rows], steps)


def score_column(net: ByteNet, text: Column) -> Column:
    """The probability that a document is good; null is scored as an empty text.

    A worker holds a batch as it came and one text at a time, as the bytes that are scored.
    """
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array((net.score(t.as_py()) for t in texts), pa.float64(), size=len(texts))

    return scored(F.coalesce(text, F.lit("")).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document; repeated rows score alike."""
    net = fit(docs, labels, doc_id, text, **options)
    key = column(docs, doc_id)
    scored = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"),
                         score_column(net, column(docs, text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents, all columns, that the classifier does not reject."""
    net = fit(docs, labels, doc_id, text, **options)
    return docs.where(score_column(net, column(docs, text)) >= threshold)
