import random

import pytest
from pyspark.sql import functions as F

from clauseloom import grammar
from clauseloom.functions import markup
from clauseloom.functions import text as tx
from clauseloom.operators import clean, embed


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("words, parts", [(0, 1), (220, 1), (221, 2), (400, 3), (5000, 28)])
def test_chunk_counts(spark, words, parts):
    text = " ".join(f"w{i}" for i in range(words))
    chunks = one(spark, tx.chunks(F.col("t")), text)
    starts = range(0, words, 180)
    wanted = [" ".join(f"w{i}" for i in range(s, min(s + 220, words))) for s in starts]
    assert len(chunks) == parts
    assert chunks == (wanted if words > 220 else [text])


def test_words_far_behind_move_the_vector(spark):
    from clauseloom.operators import embed

    near, far = "alpha beta gamma " * 2000, "zzz qqq " * 3000
    vectors = [one(spark, embed.encode_column(F.col("t"), embed.letter_profile), t) for t in (near, near + far)]
    assert sum(a * b for a, b in zip(*vectors)) < 0.99


def test_measurements_follow_the_number_rules(spark):
    bump = tx.measurements_bumped(F.col("t"))
    assert one(spark, bump, "a 600mm gap and 30 minutes") == "a 750mm gap and 38 minutes"
    assert one(spark, bump, "2 mm or 0 m or 1.5 metres") == "2.5 mm or 1.0 m or 1.9 metres"
    assert one(spark, bump, "10 mm and 14 mm") == "12 mm and 18 mm"      # half to even
    assert one(spark, bump, "50% of them") is None                       # no word behind the sign
    assert one(spark, bump, "no measure 12 here") is None


def test_sentence_edits(spark):
    text = "One. Two; Three. Four."
    assert one(spark, tx.without_last_sentence(F.col("t")), text) == "One. Two; Three."
    assert one(spark, tx.ends_swapped(F.col("t")), text) == "Four. Two; Three. One."
    assert one(spark, tx.ends_swapped(F.col("t")), "One. Two.") is None


def test_cleaning_chain(spark):
    header = "\n".join(f"Fire Safety Guide\nline number {chr(97 + i)} of the text" for i in range(8))
    text = ("ﬁre doors “quoted” – a­b…\n" + header
            + "\nPage 3 of 9\n- 12 -\nMeans of escape ........ 14\nEscape routes   17\n;;\n\n\n\n"
            "• the fi re door\t\twide\x07 ")
    done = one(spark, clean.cleaned(F.col("t")), text)
    assert done.startswith('fire doors "quoted" - ab...\nline number a of the text\n')
    assert "Fire Safety Guide" not in done and "Page" not in done and "14" not in done
    assert done.endswith("line number h of the text\n\n- the fire door wide")


def test_header_needs_eight_and_no_digit(spark):
    seven = "\n".join(["Running head"] * 7 + ["1.1 Clause"] * 9 + ["abc"] * 9)
    assert one(spark, clean.cleaned(F.col("t")), seven) == seven


def test_markup(spark):
    html = '<b onclick="x">A</b> &amp; <del class="rl-del">fire</del> <img src='
    assert one(spark, markup.sanitise(F.col("t")), html) == \
        'A &amp; <del class="rl-del">fire</del> '
    marked = one(spark, markup.highlight(F.col("t"), "AMP"), "camp &amp; <del class=\"rl-del\">Amp</del>")
    assert marked == ('c<mark class="hit">amp</mark> &amp; <del class="rl-del">'
                      '<mark class="hit">Amp</mark></del>')
    assert one(spark, markup.highlight(F.col("t"), "a"), "aaa") == "aaa"


def test_excerpt(spark):
    text = "x" * 100 + " needle " + "y" * 200
    cut = one(spark, markup.excerpt(F.col("t"), "NEEDLE"), text)
    assert cut.startswith("…") and cut.endswith("…") and "needle" in cut
    assert one(spark, markup.excerpt(F.col("t"), "absent"), text) == text[:160].strip()


def test_zero_vector_stays_zero(spark):
    assert one(spark, embed.encode_column(F.col("t"), embed.letter_profile), "12 34") == [0.0] * 26


def test_model_encoder_hook(spark):
    def make_predict():
        import numpy as np

        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

    frame = spark.createDataFrame([(1, "abc"), (2, " ".join(["w"] * 300))], "id long, t string")
    rows = embed.encode_frame(frame, ["id"], F.col("t"), embed.batch_model(make_predict)).collect()
    assert {r["id"] for r in rows} == {1, 2}
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-6 for r in rows)


def test_normalised_texts_come_back_a_few_at_a_time(spark):
    import unicodedata

    import pyarrow as pa

    texts = ["ﬁre ² ½ oü", None, "plain", "", "é é Ａ", "한글 ㈱"] * 200
    wanted = [t if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFKD", t)) for t in texts]
    parts = list(clean._recompose.func(iter([pa.array(texts), pa.array(["ﬁ"])])))
    assert max(len(p) for p in parts) <= clean._TOGETHER
    assert [t for p in parts for t in p.to_pylist()] == wanted + ["fi"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(2)
    assert [r["v"] for r in frame.select("i", clean.normalised(F.col("t")).alias("v")).orderBy("i").collect()] == wanted


def test_weighted_terms_of_repeated_null_and_wordless_rows(spark, monkeypatch):
    """Common terms met where the row lies and rare ones by a shuffle give what plain sums give."""
    import hashlib
    import math

    monkeypatch.setattr(embed, "COMMON_WEIGHT", 1.0)
    rows = [(1, 0, "the cat, the dog"), (1, 0, "the cat, the dog"), (1, 1, ""), (2, 0, None), (None, 0, "the cat"),
            (3, 0, "the odd bird the unknown")]
    weights = {"the": 0.25, "cat": 1.5, "dog": 2.0, "odd": 3.0, ",": 0.5, "bird": 1.0 / 3}
    frame = spark.createDataFrame(rows, "k int, part int, chunk string")
    known = spark.createDataFrame(list(weights.items()), "term string, weight double")
    plan = embed.weighted_terms(known, 8)(frame)
    got = sorted(((r["k"], r["part"]), [round(x, 12) for x in r["vector"]]) for r in plan.na.fill(-1, ["k"]).collect())
    place = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8 for t in weights}
    wanted = []
    for k, part, text in rows:
        x = [0.0] * 8
        for t in (text or "").replace(",", " ,").split() * (k is not None):
            if t in weights:
                x[place[t]] += weights[t]
        n = math.sqrt(sum(v * v for v in x)) or 1.0
        wanted.append(((-1 if k is None else k, part), [round(v / n, 12) for v in x]))
    assert got == sorted(wanted)
    passed = _plan_of_the_pass(frame, known)
    assert "BroadcastHashJoin" in passed
    assert passed.count("Exchange hashpartitioning") == passed.count("REPARTITION_BY_NUM") == 1


def _plan_of_the_pass(frame, known):
    """The plan of the one pass over the terms of all rows, as written by ``cut``."""
    seen = []
    plain = embed.cut
    try:
        embed.cut = lambda f: (seen.append(f._jdf.queryExecution().executedPlan().toString()), plain(f))[1]
        embed.weighted_terms(known, 8)(frame)
    finally:
        embed.cut = plain
    return seen[1]


def test_occurrences_look_before_they_replace(spark):
    frame = spark.createDataFrame([("aaa ab", "aa"), ("xyz", "aa"), (None, "aa"), ("", "aa")], "t string, p string")
    counted = frame.select(tx.occurrences(F.col("t"), F.col("p")).alias("n"))
    assert [r.n for r in counted.collect()] == [1, 0, None, 0]
    assert "Contains" in counted._jdf.queryExecution().optimizedPlan().toString()


def test_lexical_similarity_of_equal_texts(spark):
    texts = [("a B a", "a B a"), ("", ""), (" \n", " \n"), ("a b", "b c"), (None, "a"), ("A", "a")]
    frame = spark.createDataFrame(texts, "a string, b string")
    found = [r[0] for r in frame.select(tx.lexical_similarity(F.col("a"), F.col("b"))).collect()]
    assert found[:4] == [1.0, 0.0, 0.0, 1 / 3] and found[5] == 1.0


def test_quick_classes_hold_the_same_characters(spark):
    """Classes that tell letters by one range match what the plain classes match, over all of the plane."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0xFFFE)])) + "😀"
    control = grammar.CONTROL[1:-1]
    pairs = [(f"[{tx.SPACE_CLASS}]", tx.quick(tx.SPACE_CLASS)), (f"[{tx.INLINE_CLASS}]", tx.quick(tx.INLINE_CLASS)),
             (f"[{tx.INLINE_CLASS[1:]}]", tx.quick(tx.INLINE_CLASS[1:], r"\x00-\x1F\x7F-　")),
             (f"[{tx.EXOTIC_CLASS}{control}]", clean._UNPLAIN)]
    frame = spark.createDataFrame([(every,)], "t string")
    for plain, quick in pairs:
        a, b = frame.select(*[F.regexp_extract_all("t", F.lit(f"({p})"), F.lit(1)) for p in (plain, quick)]).first()
        assert a == b and len(a) > 20
    assert clean._UNPLAIN.startswith("[[")


def test_squeezing_looks_first(spark):
    """Patterns that are tried only where they can match leave what they left when always tried."""
    rng = random.Random(8)
    texts = ["".join(rng.choices([" ", "  ", "\t", "\n", "\r", "a", "fi", "ff", "ffl", "staf", "7", "é", "."], k=n % 60)) for n in range(900)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n")
    pairs = [(tx.strip(F.regexp_replace(plain, r" (?=\n)", "")), clean.collapsed(t)),
             (F.regexp_replace(t, grammar.SPLIT_LIGATURE, "$1"), clean.rejoined(t)),
             (t.rlike(r"[^\x00-\x7F]"), clean._foreign(t)),
             ((t != "") & (t.rlike(clean._FURNITURE) | (F.length(t) < 3) & ~t.rlike(r"\p{L}")), clean.is_furniture(t))]
    for was, now in pairs:
        assert frame.filter(~was.eqNullSafe(now)).count() == 0
