"""Each operator against a brute-force version, on odd and on given rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clauseloom.llm import exact, jaccard, lines, mixing, neighbours, packing, quality, sharding, simhash, suffix, tokenfile
from clauseloom.llm.graph import components
from clauseloom.llm.queries import tokenizer_path
from clauseloom.llm.store import new_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")


def pairs_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


# -- suffix-array dedup -------------------------------------------------------

def brute_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = t.encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = int((hit & ~np.concatenate(([False], hit[:-1]))).sum()) if len(b) else 0
        out.append((d, len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length,hot,limit", [(200, 20_000, 1 << 18), (40, 20_000, 3000), (40, 2, 1 << 18)])
def test_repeats(docs, given, length, hot, limit):
    for frame in (docs, given):
        got = Counter(tuple(r) for r in suffix.repeat_digests(
            frame, length=length, hot=hot, limit=limit).collect())
        assert got == brute_repeats(pairs_of(frame), length)


def test_repeats_in_long_text(spark):
    rng = random.Random(3)
    body = "".join(rng.choices("abcd ", k=150_000))
    text = body + "".join(rng.choices("efgh ", k=120_000)) + body[70_000:140_000]
    frame = spark.createDataFrame([(1, text), (2, "abc")], "doc_id long, text string")
    got = Counter(tuple(r) for r in suffix.repeat_digests(frame).collect())
    assert got == brute_repeats(pairs_of(frame), 200)


def test_removed_runs(docs):
    for r in suffix.remove_repeats(docs, length=40).collect():
        assert all(a["end"] < b["begin"] for a, b in zip(r["spans"], r["spans"][1:]))


# -- SimHash ------------------------------------------------------------------

def brute_print(text, words):
    tokens = [w for w in (text or "").encode().lower().split() if w]
    if not tokens:
        return 0
    parts = [tokens] if len(tokens) < words else [tokens[i:i + words] for i in range(len(tokens) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(docs, given):
    for frame in (docs, given):
        rows = pairs_of(frame)
        prints = [brute_print(t, 3) for _, t in rows]
        groups = defaultdict(list)
        for (d, _), g in zip(rows, brute_groups(prints, 2)):
            groups[g].append(d)
        least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
        want = Counter((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, brute_groups(prints, 2)))
        assert Counter(tuple(r) for r in simhash.near_duplicates(frame).collect()) == want


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_of_dense_groups(spark, bucket):
    """A ball of fingerprints in which all buckets are large, split or not."""
    rng = random.Random(5)
    prints = set()
    for centre in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.choice((0, 1, 2, 3, 5))):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) * (x >> 63) for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = dict(map(tuple, simhash.groups(frame, 2, bucket).collect()))
    got, want = defaultdict(set), defaultdict(set)
    for x, g in zip(signed, brute_groups(prints, 2)):
        got[root.get(x, x)].add(x)
        want[g].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_keep_one(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(7) == 0 and 5 in ids and 1 in ids and 2 not in ids
    assert 3 in ids and 4 not in ids  # empty texts are one group


def test_keep_one_of_near_copies(spark):
    """Copies with two of 400 words changed (similarity 0.95) all go."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for i in range(100):
        own = [word() for _ in range(400)]
        near = list(own)
        for at in rng.sample(range(400), 2):
            near[at] = word()
        rows += [(i, " ".join(own)), (1000 + i, " ".join(near))]
    kept = {r["doc_id"] for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(100))


def test_keep_one_by_jaccard(spark):
    """All pairs at 0.8 or more go and none below, whatever else shares their buckets."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, goes = [], set()
    for i in range(150):
        own = [word() for _ in range(300)]
        near = list(own)
        for at in rng.sample(range(300), (2, 4, 6, 9, 14)[i % 5]):
            near[at] = word()
        x, y = (set(zip(*(t[j:] for j in range(5)))) for t in (own, near))
        if len(x & y) >= 0.8 * len(x | y):
            goes.add(1000 + i)
        rows += [(i, " ".join(own)), (1000 + i, " ".join(near))]
    family = [word() for _ in range(300)]  # alike only below 0.8
    rows += [(2000 + i, " ".join(family + [word() for _ in range(120)])) for i in range(2000)]
    kept = {r["doc_id"] for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 40 < len(goes) < 110 and {i for i, _ in rows} - kept == goes


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = dict(map(tuple, components(chain).collect()))
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000


# -- quality ------------------------------------------------------------------

def test_gradients():
    net = quality.ByteNet.start(1)
    net = quality.ByteNet({k: v.astype(np.float64) for k, v in net.p.items()})
    texts, y = [b"Some text, some more.", b"", b"###$$$ %%%"], np.array([1.0, 0.0, 0.0])

    def loss(p):
        z = quality.ByteNet(p)
        s = z._unit(np.stack([z.strongest(t)[0] for t in texts]))
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = net.gradients(texts, y)
    for name, at in (("filters", (1, 2, 3)), ("weights", (4,)), ("shift", (2,)), ("bias", (0,)), ("embed", (101, 2))):
        values = []
        for sign in (1, -1):
            p = {k: v.copy() for k, v in net.p.items()}
            p[name][at] += sign * 1e-3
            values.append(loss(p))
        assert abs((values[0] - values[1]) / 2e-3 - grad[name][at]) < 2e-3


def test_chunks_cover_long_texts():
    net = quality.ByteNet.start(1)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 120, 150_001, dtype=np.uint8).tobytes()
    best, chunks = net.strongest(data)
    padded = np.frombuffer(b"\0\0" + data + b"\0" * 9, dtype=np.uint8)
    starts = np.arange(0, len(padded) - quality.WIDTH + 1, quality.STRIDE)
    seen = net.p["embed"][padded[starts[:, None] + np.arange(quality.WIDTH)]]
    want = np.einsum("nwe,wef->nf", seen, net.p["filters"]).max(axis=0)
    assert np.allclose(best, want, atol=1e-4) and chunks.shape == (quality.FILTERS, quality.WIDTH)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r[0] for r in out if r[1] == 1], [r[0] for r in out if r[1] == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9
    assert np.mean([g >= quality.THRESHOLD for g in good]) > 0.95


def test_classify_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels, steps=3).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert quality.classify(no_docs, labels.where("false"), steps=3).count() == 0


def test_whole_texts_are_learnt(spark, monkeypatch):
    """What tells the labels apart lies behind 70,000 bytes; repeated rows count once."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    ids = [i for i in range(60) if not held(i)]
    frame = spark.createDataFrame(
        [(i, "lorem ipsum " * 6000 + ("good words here." if i % 2 else "### @@@ %%% ###")) for i in ids] * 2,
        "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y, steps: seen.append((texts, y)))
    quality.fit(frame, labels)
    quality.fit(frame, labels, sample_docs=10)
    quality.fit(frame, labels, sample_bytes=200_000)
    quality.fit(frame, labels, sample_bytes=100)
    assert [len(t) for t, _ in seen] == [len(ids), 10, 2, 0]
    assert all(t.endswith(b"here." if y else b"###") and len(t) > 70_000 for t, y in zip(*seen[0]))


# -- mixing -------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / total for s in order}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def test_mix(docs, given, no_docs):
    import re

    for frame in (docs, given):
        rows = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in frame.collect()]
        sizes = defaultdict(int)
        for _, n, s in rows:
            sizes[s] += n
        want = brute_targets(sizes)
        out = mixing.mix(frame).collect()
        assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, n) for d, n, _ in rows)
        source = {d: s for d, _, s in rows if d is not None}
        taken, largest = defaultdict(int), defaultdict(int)
        for r in out:
            assert 0 <= r["taken"] <= 2 * r["size"]
            if r["doc_id"] is not None:
                s = source[r["doc_id"]]
                assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
                taken[s] += r["taken"]
                largest[s] = max(largest[s], r["size"])
        for s, words in taken.items():
            assert abs(words - want[s]) <= 2 * largest[s] + 1e-6
        again = mixing.mix(frame.repartition(5)).collect()
        assert Counter(tuple(r) for r in out) == Counter(tuple(r) for r in again)
    assert mixing.mix(no_docs).count() == 0


def test_flight_keeps_both_totals(spark):
    rng = random.Random(1)
    size = [rng.randint(1, 1000) for _ in range(500)]
    p = [0.3] * 500
    out = mixing.flight(size, p, random.Random(2))
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(out, size)) == pytest.approx(0.3 * sum(size))
    frame = spark.createDataFrame([(i, "w " * rng.randint(1, 50), "a" if i % 3 else "b") for i in range(3000)],
                                  "doc_id long, text string, source string")
    for part in (20, 400):
        total = defaultdict(lambda: [0, 0.0])
        for r in mixing.mix(frame, part=part).collect():
            total[r["target"]][0] += r["taken"]
        assert all(abs(t[0] - goal) <= 100 for goal, t in total.items())


def test_alike_rows_share_parts_and_copies(spark):
    """Half of all rows alike in id and text: no part holds them, and the totals hold."""
    frame = spark.createDataFrame(
        [(None, "one two three", "a", i) for i in range(3000)] + [(i, "w " * (i % 40), "a" if i % 3 else None, i) for i in range(3000)],
        "doc_id long, text string, source string, row long")
    sized = frame.select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"),
                         F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))
    goal = spark.createDataFrame([("a", 25), (None, 5)], "s string, parts long")
    dealt = mixing.dealt(sized, goal, 200, 42)
    assert dealt.count() == 6000 and dealt.groupBy("source", "part").count().agg(F.max("count")).first()[0] < 400
    out = [Counter(tuple(r) for r in mixing.mix(f, part=200).collect()) for f in (frame, frame.repartition(7))]
    assert out[0] == out[1] and sum(out[0].values()) == 6000
    got, want = Counter(), Counter()
    written = frame.repartition(5)
    for r in mixing.mixed_documents(written, part=200).collect():
        got[r["doc_id"], r["source"]] += 1
        assert r["row"] is not None
    for r in mixing.mix(frame, part=200).collect():
        want[r["doc_id"], "a" if r["doc_id"] is None or r["doc_id"] % 3 else None] += r["times"]
    assert got == Counter({k: v for k, v in want.items() if v})


def test_mixed_documents(docs):
    takes = defaultdict(int)
    for r in mixing.mix(docs).collect():
        takes[(r["doc_id"], r["size"])] += r["times"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], len((r["text"] or "").replace(" ", "x").replace(" ", "x").split())) for r in out.collect())
    assert got == Counter({k: v for k, v in takes.items() if v})


# -- line dedup ---------------------------------------------------------------

def brute_line_spans(rows):
    places, first = defaultdict(list), {}
    unique = sorted(set(rows), key=lambda x: (-1 if x[0] is None else x[0]))
    for d, t in unique:
        for b, e, n in lines.chunk_bounds(t.encode()):
            if n >= lines.LINES:
                places[t.encode()[b:e].rstrip(b"\n")].append((d, t, b, e))
    for body, at in places.items():
        first[body] = min(at, key=lambda x: (-1 if x[0] is None else x[0], x[2]))
    gone = defaultdict(list)
    for body, at in places.items():
        for d, t, b, e in at:
            if (d, t, b, e) != first[body]:
                gone[(d, t)].append((b, e))
    return gone


def brute_lines(rows):
    gone, out = brute_line_spans(rows), {}
    for d, t in set(rows):
        data = t.encode()
        for b, e in sorted(gone[(d, t)], reverse=True):
            data = data[:b] + data[e:]
        out[(d, t)] = data.decode()
    return out


def brute_runs(rows, words=lines.WORDS, window=lines.WINDOW):
    """What the registered form leaves: chunks as above, and runs taken by trying every window."""
    unique = sorted(set(rows), key=lambda x: (-1 if x[0] is None else x[0]))
    places, split = defaultdict(list), {}
    for row in unique:
        own = split[row] = row[1].encode().split(b"\n")
        count = [len(x.split()) for x in own]
        runs = {}
        for i in range(len(own)):
            j = next((j for j in range(i + 1, len(own) + 1) if sum(count[i:j]) >= words), None)
            if j and count[i]:
                h = sum(lines.xxhash.xxh64_intdigest(x) * lines.BASE ** (j - i - 1 - n) for n, x in enumerate(own[i:j]))
                runs[i] = (h % lines.PRIME, j)
        for i in runs:
            begins = [k for k in runs if k >= i and sum(count[i:k]) < window]
            best = min(begins, key=lambda k: (runs[k][0], k))
            if (row, best) not in places[b"\n".join(own[best:runs[best][1]])]:
                places[b"\n".join(own[best:runs[best][1]])].append((row, best))
    gone = defaultdict(set)
    for body, at in places.items():
        many = body.count(b"\n") + 1
        at.sort(key=lambda x: (-1 if x[0][0] is None else x[0][0], x[1]))
        first, begin = at[0]
        for row, i in at[1:]:
            mine, other = split[row], split[first]
            num = lambda own, x: len(own[x].split())
            taken, back, on = set(range(i, i + many)), 1, 0

            def reach(own, b, step):
                """How many lines around a run it may grow over."""
                n, seen = 0, 0
                while 0 <= b < len(own) and num(own, b) < window and (
                        seen + num(own, b) <= window if step < 0 else seen < 2 * window):
                    n, seen, b = n + 1, seen + num(own, b), b + step
                return n
            far = min(reach(mine, i - 1, -1), reach(other, begin - 1, -1))
            while back <= far and mine[i - back] == other[begin - back]:
                taken.add(i - back)
                back += 1
            far = min(reach(mine, i + many, 1), reach(other, begin + many, 1))
            while on < far and mine[i + many + on] == other[begin + many + on]:
                taken.add(i + many + on)
                on += 1
            gone[row] |= {x for x in taken if row != first or x >= begin + many}
    return gone, split


def left_by_both(rows):
    gone, split = brute_runs(rows)
    out = {}
    for row, own in split.items():
        data, spans, at = row[1].encode(), [], 0
        for n, line in enumerate(own):
            if n in gone[row]:
                spans.append((at, min(len(data), at + len(line) + 1)))
            at += len(line) + 1
        out[row] = spans
    return out


def test_registered_line_dedup(docs, given, no_docs):
    """The form of op5 and the pipeline, on odd rows and on given ones, against brute force."""
    for frame in (docs, given):
        rows = pairs_of(frame)
        runs, chunks = left_by_both(rows), brute_line_spans(rows)
        want = Counter()
        for row in rows:
            data, keep = row[1].encode(), bytearray()
            gone = runs[row] + chunks[row]
            drop = bytearray(len(data))
            for b, e in gone:
                drop[b:e] = b"\x01" * (e - b)
            keep = bytes(x for x, d in zip(data, drop) if not d)
            want[(row[0], keep.decode())] += 1
        out = lines.line_dedup(frame, words=lines.WORDS)
        assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == want
    assert lines.line_dedup(no_docs, words=lines.WORDS).count() == 0


def test_repeated_passages_are_found(spark):
    """Passages of 50 words and more in whole lines of any length: all copies but the first go whole."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))

    def some(n):
        out = []
        while n > 0:
            out.append(" ".join(word() for _ in range(min(n, rng.choice([1, 3, 7, 12, 18, 29, 31, 70])))))
            n -= len(out[-1].split())
        return out

    rows, passages = [], []
    for i in range(300):
        passage = some(rng.randint(50, 160))
        passages.append(passage)
        for copy in range(3):
            rows.append((1000 * copy + i, "\n".join(some(rng.randint(0, 60)) + passage + some(rng.randint(0, 60)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.line_dedup(frame, words=lines.WORDS).collect()}
    for i, passage in enumerate(passages):
        assert out[i] == dict(rows)[i]
        for copy in (1, 2):
            left = out[1000 * copy + i].split("\n")
            assert not set(left) & {x for x in passage if len(x.split()) > 3}
            assert len(left) >= 1


def test_line_dedup(docs, given):
    for frame in (docs, given):
        want = brute_lines(pairs_of(frame))
        out = lines.line_dedup(frame)
        assert out.columns[: len(frame.columns)] == frame.columns
        rows = out.collect()
        assert Counter((r["doc_id"], r["text"] or "") for r in rows) == Counter(
            (d, want[(d, t)]) for d, t in pairs_of(frame))
    texts = {r["doc_id"]: r["text"] for r in lines.line_dedup(docs).collect()}
    assert texts[3] is None and texts[4] == ""


def test_chunks_do_not_shift(spark):
    passage = "\n".join(f"line number {i} of the passage" for i in range(40))
    frame = spark.createDataFrame([(1, passage), (2, "one more\n" + passage + "\nand behind"), (3, "own\ntext\nhere")],
                                  "doc_id long, text string")
    out = {r["doc_id"]: r for r in lines.line_dedup(frame).collect()}
    assert out[1]["text"] == passage and out[3]["text"] == "own\ntext\nhere"
    assert len(out[2]["text"]) < len(passage) / 3 and out[2]["n_removed"] > 3


def test_passages_that_hold_no_chunk(spark):
    """Repeated passages of one to four lines go whole, wherever chunks end."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = []
    for i in range(60):
        passage = "\n".join(line(-(-60 // (1 + i % 4))) for _ in range(1 + i % 4))
        rows += [(i, f"{line(30)}\n{passage}\n{line(30)}"), (1000 + i, f"{line(9)}\n{line(30)}\n{passage}\n{line(30)}")]
    rows.append((3000, "\n".join(["five words are in this"] * 50)))  # its own copies
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.line_dedup(frame, words=lines.WORDS).collect()}
    text = dict(rows)
    for i in range(60):
        own = text[1000 + i].split("\n")
        assert out[i] == text[i] and out[1000 + i] == "\n".join(own[:2] + own[-1:])
    assert out[3000].strip("\n").split("\n") == ["five words are in this"] * 2  # its first chunk


# -- nearest neighbours -------------------------------------------------------

def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = table.orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in data])
    x = np.array([r["embedding"] for r in data], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 50 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        best = np.lexsort((ids, -score))[:5]
        hits += len({i for i, _ in got[q]} & set(ids[best].tolist()))
        total += 5
        assert len(got[q]) == 5
        for i, s in got[q]:
            assert s == pytest.approx(score[ids == i][0], abs=1e-12)
    assert hits / total >= 0.9


@pytest.mark.parametrize("block", [8192, 1000])
def test_recall_beside_copies(spark, block):
    """A third of the rows are equal; some queries are copies, others lie near them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 24))
    x[::3] = x[0]
    near = (np.arange(6000) % 20 == 10) & (np.arange(6000) % 3 > 0)
    x[near] = x[0] + 0.3 * rng.normal(size=(near.sum(), 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(frame, block=block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 6000, 50):
        if q % 3 == 0:
            assert got[q] == [i for i in range(0, 21, 3) if i != q][:5]
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        hits += len(set(got[q]) & set(np.lexsort((np.arange(6000), -score))[:5].tolist()))
        total += 5
    assert hits / total >= 0.97


@pytest.mark.parametrize("block", [8192, 40])
def test_vectors_of_one_direction_tie(spark, block):
    """Multiples of a vector have one cosine with any query, so they come in the order of their ids."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16)).astype(np.float32).astype(np.float64)
    x = np.concatenate([7 * base, base, 3 * base])[rng.permutation(120)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest_neighbours(frame, k=6, every=1, block=block, rerank=1.0).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    scores = {}
    for q, found in got.items():
        assert len(found) == 6 and found == sorted(found, key=lambda f: (-f[0], f[1]))
        # the query's own two multiples tie at one
        assert [s for s, _ in found[:2]] == [1.0, 1.0]
        scores[q] = found
        # then three of one direction, and one of the next
        assert found[2][0] == found[3][0] == found[4][0] > found[5][0]
    assert len(scores) == 120


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]),
            (5, [None, 1.0]), (6, [nan, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (8, [1e30, 1e30])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest_neighbours(frame).orderBy("query_id", "rank").collect()
    assert [(r[0], r[1], r[2]) for r in out] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 8), (0, 4, 50), (50, 1, 1), (50, 2, 2), (50, 3, 8), (50, 4, 0)]
    assert neighbours.nearest_neighbours(frame.where("false")).count() == 0
    assert neighbours.nearest_neighbours(frame.where("vec_id = 0")).count() == 0


def test_footrule():
    rng = np.random.default_rng(0)
    order = np.array([rng.permutation(9)[:4] for _ in range(50)])
    file = neighbours.InvertedFile(order, 9)
    for q in order[:5]:
        place = lambda o: {p: i for i, p in enumerate(o.tolist())}
        want = [sum(abs(place(q).get(p, 4) - place(o).get(p, 4)) for p in range(9)) for o in order]
        assert file.footrule(q).tolist() == want


# -- sharding -----------------------------------------------------------------

def test_shards(spark, docs, no_docs):
    many = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    for frame in (docs, many):
        out = sharding.shard_by_key(frame).collect()
        want = Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in pairs_of(frame))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 24)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 24 and max(map(len, slots.values())) < 1.2 * 20_000 / 24
    moved = sum(r["grown_shard"] == 24 for r in out)
    assert 0.8 / 25 < moved / 20_000 < 1.2 / 25
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_by_key(many, 25).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in out)
    assert sharding.shard_by_key(no_docs).count() == 0


# -- token files and packing --------------------------------------------------

def reference_ids(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name,leading", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_encode_as_whole_texts(name, leading):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from clauseloom.llm.tokens import WordEncoder

    rng = random.Random(1)
    signs = ["a", "B", "é", "Wörter", "ÆON", "straße", " ", "  ", "\n", "1", "22", ".", ",", "'s", "'", "#", "$$", "»", "\t", "\u00a0", "\u0301",
             "Σ", "漢", "<|endoftext|>", "İ", "-", "\0", "K", "\u2003"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(4000)]
    whole = Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)
    mine = WordEncoder(tokenizer_path(name), leading)(pa.array(texts))
    assert [x.tolist() for x in mine] == [x.ids for x in whole]


def test_token_files(spark, docs, given, no_docs):
    for frame in (docs, given):
        path = new_path(spark, "t")
        tokenfile.write_token_files(frame, path, tokenizer_path("byte_bpe_50k.json"), True, 2, shard_bytes=500)
        want = [(d, reference_ids("byte_bpe_50k.json", t) + [2]) for d, t in pairs_of(frame)]
        got = tokenfile.read_token_files(spark, path).orderBy("start").collect()
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(i)) for d, i in want)
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        for r in tokenfile.token_digests(spark, path).collect():
            assert (r["doc_id"], r["n_tokens"], r["ids_crc32"]) in {
                (d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in want}
    assert sorted(tokenfile.read_document(spark, path, 1)) == [want[[d for d, _ in want].index(1)][1]]
    path = new_path(spark, "t")
    tokenfile.write_token_files(no_docs, path, tokenizer_path("byte_bpe_50k.json"), True, 2)
    assert tokenfile.token_digests(spark, path).count() == 0


def test_packing(docs, given, no_docs):
    name = "word_bpe_49k.json"
    for frame in (docs, given):
        pieces = packing.token_pieces(frame, tokenizer_path(name), False, 0, 2048)
        out = packing.pack(pieces, 2048).collect()
        want = Counter()
        for d, t in pairs_of(frame):
            ids = np.array(reference_ids(name, t) + [0], dtype="<u4")
            for n, s in enumerate(range(0, len(ids), 2048)):
                want[(d, n, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()))] += 1
        assert Counter(tuple(r)[:5] for r in out) == want
        bins = defaultdict(list)
        for r in out:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r["length"] for r in out)
        assert len(bins) <= -(-total // 2048) + 1 + len(bins) // 10
    assert packing.pack(packing.token_pieces(no_docs, tokenizer_path(name), False, 0, 2048), 2048).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 2000)
    bins, offsets = packing.vector_best_fit(lengths, 128, documents=5, attention=6000 + 100 ** 2, rule=rule)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 128 and len(mine) <= 5 and (mine ** 2).sum() <= 16000
        order = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][order] == np.concatenate(([0], np.cumsum(mine[order])[:-1]))).all()


# -- exact dedup --------------------------------------------------------------

@pytest.mark.parametrize("block,digests", [(8192, None), (7, None), (64, 3)])
def test_exact(docs, given, no_docs, block, digests):
    options = {"digest": lambda c: F.pmod(F.xxhash64(c), F.lit(digests))} if digests else {}
    upper = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for frame in (docs, given):
        rows = [(d, t.encode().translate(upper)) for d, t in pairs_of(frame)]
        groups = defaultdict(list)
        for d, b in rows:
            groups[b].append(d)
        keep = {b: max((d for d in ids if d is not None), default=None) for b, ids in groups.items()}
        out = exact.exact_duplicates(frame, block=block, **options).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == Counter(
            (d, keep[b], len(groups[b]), hashlib.sha256(b).hexdigest()) for d, b in rows)
        assert sum(r["kept"] for r in out) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert exact.exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("operator", [
    suffix.repeat_digests, simhash.near_duplicates, jaccard.keep_one, lines.line_dedup, mixing.mixed_documents])
def test_empty_tables(no_docs, operator):
    assert operator(no_docs).count() == 0


def test_a_bounded_encoder_gives_the_same_ids_and_remembers_no_more():
    import pyarrow as pa

    from clauseloom.llm.tokens import WordEncoder
    path = tokenizer_path("word_bpe_49k.json")
    texts = pa.array([" ".join(f"word{i % 7}x{i}" for i in range(k, k + 20)) for k in range(0, 400, 10)])
    small = WordEncoder(path, False, words=60, together=2)
    assert [a.tolist() for a in small(texts)] == [a.tolist() for a in WordEncoder(path, False)(texts)]
    assert len(small.table) <= 60


def test_quality_scores_the_bytes_of_a_text():
    net = quality.ByteNet.start(3)
    assert net.score("naïve texts".encode()) == net.score("naïve texts")
