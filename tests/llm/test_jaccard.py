"""The Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from clauseloom.llm import jaccard
from clauseloom.llm.queries import ORACLES

FOLDER = "/root/testdata/sf0.01"


def brute(rows, words=4, percent=85):
    sets = []
    for _, text in rows:
        tokens = (text or "").encode().lower().split()
        size = min(words, len(tokens))
        sets.append({tuple(tokens[i:i + size]) for i in range(len(tokens) - size + 1)} if tokens else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) \
                    and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(frame, **more):
    return Counter(tuple(r) for r in jaccard.jaccard_components(frame, **more).collect())


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("words,percent", [(4, 85), (2, 60)])
def test_odd_rows(docs, words, percent):
    assert got(docs, words=words, percent=percent) == brute(rows_of(docs), words, percent)


def test_no_rows(no_docs):
    assert not got(no_docs)


def test_given_rows(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got(frame) == brute(rows_of(frame))


@pytest.mark.parametrize("block,gather", [(1 << 15, 1 << 21), (300, 500)])
def test_dense_families(spark, monkeypatch, block, gather):
    """Families around a base, alike at 0.7 to 1, in which chains decide; a base may be absent."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GATHER", gather)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = " ".join(rng.choices(vocabulary, k=30))  # a passage of every text
    rows = []
    for family in range(6):
        base = rng.choices(vocabulary, k=80)
        for _ in range(70):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4])):
                words[rng.randrange(80)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words) + " " + common))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    wanted = brute(rows)
    assert got(frame) == wanted
    sizes = Counter(c for _, _, c in wanted.elements())
    assert 6 < len(sizes) and max(sizes.values()) > 20  # neither all one nor all apart


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(jaccard, "_COLUMNS", 16)
    one, two = ([np.unique(rng.integers(0, 200, k)) for k in rng.integers(0, 60, 12)] for _ in range(2))
    assert (jaccard._overlaps(one, two) == [[len(set(a) & set(b)) for b in two] for a in one]).all()


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet' WHERE doc_id < 300")
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300")
    assert got(frame) == Counter(con.execute(ORACLES["op11_jaccard_join"]).fetchall())


def test_pipeline_takes_simhash_links_first(spark, monkeypatch):
    """Fingerprints find candidates, the sets decide: alike but for tails of many words is apart."""
    import corpus_pipeline

    found, own = [], jaccard.simhash.links
    monkeypatch.setattr(jaccard.simhash, "links", lambda *call: found.append(own(*call)) or found[-1])
    rng = random.Random(5)
    body = " ".join([" ".join(f"b{i}" for i in range(21))] * 50)
    tails = [" ".join(f"t{rng.random()}" for _ in range(30)) for _ in range(2)]
    prose = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = [(1, f"{body} {tails[0]}"), (2, f"{body} {tails[1]}"), (3, " ".join(prose)), (4, " ".join(prose + ["end"])),
            (5, " ".join(prose[:350])), (6, ""), (7, None), (8, " ".join(prose[:200]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 2, 3, 6, 8}
    assert found


def test_prefixes_are_taken_of_a_few_nodes_at_a_time():
    import pyarrow as pa

    from clauseloom.llm import jaccard

    rows = [{"node": i, "n": 40, "h": [7 * j - i for j in range(38)], "df": [2 + j % 5 for j in range(38)]} for i in range(300)]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("node", pa.int64()), ("n", pa.int64()), ("h", pa.list_(pa.int64())), ("df", pa.list_(pa.int64()))]))
    out = list(jaccard._prefixes(80)(iter([batch])))
    assert max(b.num_rows for b in out) <= jaccard.TOGETHER
    singly = [next(jaccard._prefixes(80)(iter([batch.slice(i, 1)]))).to_pylist()[0] for i in range(300)]
    assert [r for b in out for r in b.to_pylist()] == singly


def test_all_near_candidates_are_checked(spark):
    """Candidates of one group are checked among themselves, not only against its least node."""
    rng = random.Random(14)
    texts = []
    for _ in range(6):
        own = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [own, own[:-1] + ["other"]]
    node = [jaccard._node(jaccard.shingles(" ".join(t), 5)) for t in texts]
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    sizes = docs.select(jaccard._nodes(docs["text"], 5).alias("s")).select("s.*")
    chain = spark.createDataFrame(list(zip(node, node[1:])), "a long, b long")
    found = jaccard.near_links(jaccard.candidate_nodes(docs, sizes, 5, 80), 80, chain).collect()
    assert {frozenset(r) for r in found} == {frozenset(node[i:i + 2]) for i in range(0, 12, 2)}
