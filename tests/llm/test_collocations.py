"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clauseloom.llm import collocations as col
from clauseloom.llm.queries import ORACLES

FOLDER = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=10, top=2000, covered=50):
    f = defaultdict(Counter)
    for lang, text in rows:
        f[lang or "und"].update(())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for g, v in counts.items() if len(g) == 1)
        wanted = {g: v for g, v in counts.items() if len(g) > 1 and v >= least}
        longer = Counter()
        for g, v in wanted.items():
            if len(g) == 3:
                longer[g[:2]], longer[g[1:]] = max(longer[g[:2]], v), max(longer[g[1:]], v)
        found = []
        for g, a in wanted.items():
            if 100 * longer[g] >= covered * a and longer[g]:
                continue
            score, k = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(frame, **more):
    return sorted(tuple(r) for r in col.collocations(frame, **more).collect())


def rows_of(frame):
    return [(r["lang"], r["text"]) for r in frame.select("lang", "text").collect()]


def test_given_rows(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = got(frame)
    assert found == brute(rows_of(frame)) and len(found) > 100


@pytest.mark.parametrize("gather,spread", [(1 << 21, 1 << 12), (400, 1 << 12), (2000, 3)])
def test_odd_rows(spark, docs, monkeypatch, gather, spread):
    """Gathered in one go or in many, with every other node spread over parts by its edges."""
    monkeypatch.setattr(col, "GATHER", gather)
    monkeypatch.setattr(col, "SPREAD", spread)
    rng = random.Random(4)
    said = ["a", "b", "A", "c", "dd", "é", "a.", "b,", "\t", "\n", "a;b", "ß"]
    rows = [(None, rng.choice([None, "en", "de"]), " ".join(rng.choices(said, k=rng.randrange(30)))) for _ in range(300)]
    rows += [(1, "en", "loop loop loop loop"), (2, "fr", "x y x y x y x y x y"), (3, "und", "a b a b"),
             (4, "en", " ".join(f"only{i}" for i in range(3000)))] * 11
    more = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for frame in (docs, more):
        assert got(frame, least=3) == brute(rows_of(frame), least=3)
    assert got(more, least=2, top=7, covered=80) == brute(rows_of(more), 2, 7, 80)


def test_no_rows(no_docs):
    assert got(no_docs) == []


def test_gathering_with_many_words(monkeypatch):
    held = col._Gathering()
    held.add("en", "a b c a b c. a b")
    plain = held.edges()
    held.names += [("en", b"x")] * (1 << 21)  # so many that three numbers take over 63 bits
    large = held.edges()
    for one, two in zip(plain[:4], large[:4]):
        assert (one == two).all()


def test_paths(spark):
    """A passage is one path; circles stay edge by edge; branches end paths."""
    line = list(range(10, 20))
    edges = [(*line[i:i + 3], 5) for i in range(8)] + [(1, 2, 1, 4), (2, 1, 2, 4), (7, 7, 7, 3)]
    edges += [(30, 31, 32, 6), (31, 32, 33, 6), (31, 32, 34, 6), (40, 41, 42, 6), (41, 42, 43, 9)]
    frame = spark.createDataFrame(edges, "a long, b long, c long, f long")
    found = sorted((r["words"], r["f"]) for r in col.unary_paths(frame).collect())
    assert found == sorted([(line, 5), ([1, 2, 1], 4), ([2, 1, 2], 4), ([7, 7, 7], 3), ([30, 31, 32], 6),
                            ([31, 32, 33], 6), ([31, 32, 34], 6), ([40, 41, 42], 6), ([41, 42, 43], 9)])


def test_large_products(spark, monkeypatch):
    """Scores stay exact where products pass 64 bits."""
    from pyspark.sql import functions as F

    big = 3_000_000_019
    rows = [(col.EDGE, None, 1, 2, 3, None, big), (col.NODE, None, 1, 2, None, None, 2 * big),
            (col.NODE, None, 2, 3, None, None, 3 * big), (col.TOTAL, "en", None, None, None, None, 99 * big)]
    rows += [(col.WORD, "en", i, None, None, f"w{i}", f) for i, f in ((1, 5 * big), (2, 7 * big + 1), (3, 9 * big + 1))]
    monkeypatch.setattr(col, "grams", lambda *a: spark.createDataFrame(rows, col._SCHEMA))
    found = {r["phrase"]: r for r in col.collocations(spark.range(0).select(F.lit("").alias("lang"))).collect()}
    assert found["w1 w2 w3"]["score"] == min(1000000 * big * big // (5 * big * 3 * big),
                                             1000000 * big * big // (2 * big * (9 * big + 1)))
    assert found["w2 w3"]["score"] == 1000000 * 9 * big * big // ((7 * big + 1) * (9 * big + 1))


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    assert np.array_equal(got(spark.read.parquet(f"{FOLDER}/documents.parquet")),
                          sorted(con.execute(ORACLES["op12_collocations"]).fetchall()))
