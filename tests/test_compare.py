import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogue import fixtures
from clauseloom import fixed
from clauseloom.functions import diff, vectors
from clauseloom.operators import align, positions, redline, report
from clauseloom.operators.embed import letter_profile
from clauseloom.operators.positions import numbered
from clauseloom.plans import annotation, compare


def plain_redline_counts(a, b):
    """Word counts by the standard library's matcher."""
    token = re.compile(r"\s+|[^\W_]+(?:['’][^\W_]+)*|[^\s\w]|_")
    x, y = token.findall(a), token.findall(b)
    removed = added = kept = 0
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        left, right = [sum(1 for t in s if t.strip()) for s in (x[i1:i2], y[j1:j2])]
        if op == "equal":
            kept += left
        else:
            removed, added = removed + left, added + right
    return removed, added, kept


def test_matching_runs_equal_the_standard_matcher():
    rng = random.Random(7)
    for trial in range(600):
        kinds = rng.choice([2, 4, 40, 400])
        a = [rng.randrange(kinds) for _ in range(rng.randrange(160))]
        b = list(a) if trial % 2 else [rng.randrange(kinds) for _ in range(rng.randrange(160))]
        for _ in range(rng.randrange(6)):
            if b:
                b[rng.randrange(len(b))] = rng.randrange(kinds)
                del b[rng.randrange(len(b))]
        wanted = [tuple(m) for m in difflib.SequenceMatcher(
            None, a, b, autojunk=False).get_matching_blocks()][:-1]
        assert diff.matching_runs(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == wanted


def test_matching_starts_from_runs_at_one_place(monkeypatch):
    """Two editions with a few words replaced need few looks at the windows of a range."""
    rng, looks, of = random.Random(3), [], diff._Windows.of
    monkeypatch.setattr(diff._Windows, "of", lambda *call: looks.append(call) or of(*call))
    old = np.arange(3000)
    new = old.copy()
    for at in range(50, 3000, 100 + rng.randrange(20)):
        new[at] = 5000 + at
    matched = sum(size for *_, size in diff.matching_runs(old, new))
    assert matched == int((old == new).sum()) and len(looks) < 6 * int((old != new).sum())


def test_redline_of_an_edited_sentence():
    left, right, both, removed, added, kept = diff.redline(
        "A gap of 600mm & more.", "A gap of 750mm & more.")
    assert left == 'A gap of <del class="rl-del">600mm</del> &amp; more.'
    assert right == 'A gap of <ins class="rl-ins">750mm</ins> &amp; more.'
    assert both == ('A gap of <del class="rl-del">600mm</del><ins class="rl-ins">750mm</ins>'
                    ' &amp; more.')
    assert (removed, added, kept) == (1, 1, 6)


def test_panes_rebuild_long_texts():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    old = " ".join(rng.choice(words) + rng.choice(["", "", ".", ";\n"]) for _ in range(2500))
    new = old.replace("word7", "seven").replace("word9.", "word9. Added <here>.")
    left, right, _, removed, added, kept = diff.redline(old, new)
    bare = lambda html: re.sub(r"</?(?:del|ins)[^>]*>", "", html)
    assert bare(left) == old and bare(right) == new.replace("<", "&lt;").replace(">", "&gt;")
    assert removed > 0 and added > 0 and kept > 0


@pytest.mark.parametrize("n, every", [(800, 800), (3000, 20), (3000, 7)])
def test_long_texts_are_compared_word_by_word(n, every):
    old = [f"w{i}" for i in range(n)]
    new = ["changed" if i % every == every // 2 else w for i, w in enumerate(old)]
    changed = n // every
    counts = diff.redline(" ".join(old), " ".join(new))[3:]
    assert abs(counts[0] - changed) <= 1 and counts == (counts[0], counts[0], n - counts[0])


def test_long_texts_match_like_the_standard_matcher():
    rng = random.Random(11)
    for kinds in (3, 50, 2000):
        old = [f"w{rng.randrange(kinds)}" for _ in range(1200)]
        new = [w if rng.random() > 0.1 else f"w{rng.randrange(kinds)}" for w in old]
        new[300:300] = old[700:800]
        a, b = " ".join(old), " ".join(new)
        assert diff.redline(a, b)[3:] == plain_redline_counts(a, b)


def test_redline_table(spark):
    rng = random.Random(5)
    rows = [(0, None, None), (1, "only old", None), (2, None, "only < new"), (3, "same", "same"),
            (4, "", ""), (5, "  ", None)]
    for i in range(6, 40):
        a = " ".join(rng.choice("abcdef") for _ in range(rng.randrange(60)))
        rows.append((i, a, a.replace("a b", "x") + rng.choice([".", ""])))
    frame = spark.createDataFrame(rows, "id int, content_v1 string, content_v2 string")
    got = {r["id"]: r["redline"] for r in redline.with_redline(frame).collect()}
    assert tuple(got[0]) == ("", "", "", 0, 0, 0)
    assert tuple(got[1])[:2] == ('<del class="rl-del">only old</del>', "")
    assert tuple(got[2])[1] == '<ins class="rl-ins">only &lt; new</ins>' and got[2]["words_added"] == 3
    assert tuple(got[3]) == ("same", "same", "same", 0, 0, 1)
    assert got[5]["html_v1"] == "  "
    for i, a, b in rows[6:]:
        r = got[i]
        assert (r["words_removed"], r["words_added"], r["words_unchanged"]) == plain_redline_counts(a, b)


@pytest.mark.parametrize("similarity, ratio, touched, wanted", [
    (0.95, 0.05, 20, fixed.UNCHANGED), (0.95, 0.0501, 0, fixed.MINOR), (0.95, 0.0, 21, fixed.MINOR),
    (0.9499, 0.0, 0, fixed.MINOR), (0.80, 0.0, 0, fixed.MINOR), (0.7999, 0.0, 0, fixed.SIGNIFICANT),
    (1.0, 0.35, 0, fixed.SIGNIFICANT), (1.0, 0.3499, 199, fixed.MINOR),
    (1.0, 0.0, 200, fixed.SIGNIFICANT),
])
def test_classification_boundaries(spark, similarity, ratio, touched, wanted):
    row = spark.range(1).select(report.classify(
        F.lit(similarity), F.lit(ratio), F.lit(touched)).alias("c")).first()
    assert row["c"] == wanted


def greedy(rows):
    taken_i, taken_j, out = set(), set(), set()
    for c, i, j, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (c, i) not in taken_i and (c, j) not in taken_j:
            taken_i.add((c, i))
            taken_j.add((c, j))
            out.add((c, i, j))
    return out


def test_both_matchings_equal_sequential_greedy_with_ties(spark):
    rng = random.Random(11)
    rows = {(c, rng.randrange(12), rng.randrange(12)): rng.choice([0.5, 0.6, 0.6, 0.7, 0.9])
            for c in range(8) for _ in range(50)}
    data = [(*key, score) for key, score in rows.items()]
    frame = spark.createDataFrame(
        data, "comparison_id long, index_v1 int, index_v2 int, score double")
    for found in (align.match_in_groups(frame), align.match_in_rounds(frame),
                  align.one_to_one(frame, group_limit=35)):
        assert {(r[0], r[1], r[2]) for r in found.select(
            "comparison_id", "index_v1", "index_v2").collect()} == greedy(data)


def test_rounds_are_few_for_a_chain_of_falling_scores(spark, monkeypatch):
    """Each pair waits for the one before it: a chain is matched as a component, not round by round."""
    n = 50_000
    chain = spark.range(n).select(
        F.lit(1).cast("long").alias("comparison_id"), F.floor(F.col("id") / 2).cast("int").alias("index_v1"),
        F.floor((F.col("id") + 1) / 2).cast("int").alias("index_v2"), (1.0 - F.col("id") / (2 * n)).alias("score"))
    other = spark.createDataFrame([(2, 0, 0, 0.5), (2, 1, 0, 0.6), (2, 1, 1, 0.4)], chain.schema)
    written = []
    monkeypatch.setattr(align, "cut", lambda frame, real=align.cut: written.append(1) or real(frame))
    found = align.match_in_rounds(chain.union(other))
    assert {tuple(r)[1:3] for r in found.filter("comparison_id = 1").collect()} == {(i, i) for i in range(n // 2)}
    assert {tuple(r)[1:3] for r in found.filter("comparison_id = 2").collect()} == {(1, 0)}
    assert len(written) < 6
    assert align.match_in_rounds(chain.limit(0)).isEmpty()


def test_components(spark):
    from clauseloom.operators.components import components

    edges = [(i, i + 1) for i in range(200)] + [(900, 800), (800, 700), (5, 5), (1000, 1001)]
    random.Random(2).shuffle(edges)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in (700, 800, 900)} == {700}
    assert found[1001] == 1000 and len(found) == 206


def test_nearest_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(7, side, i, [float(x) for x in rng.normal(size=6)])
            for side, n in ((1, 25), (2, 31)) for i in range(n)]
    rows += [(8, 1, 0, [1.0] * 6)]                      # a comparison without a right side
    frame = spark.createDataFrame(
        rows, "comparison_id long, side int, idx int, vector array<double>")
    results = [sorted(tuple(r) for r in align.nearest(frame, 4, block).collect())
               for block in (3, 10, 1024)]
    assert results[0] == results[1] == results[2]
    left = np.array([r[3] for r in rows if r[0] == 7 and r[1] == 1])
    right = np.array([r[3] for r in rows if r[0] == 7 and r[1] == 2])
    top = np.argsort(-(left @ right.T), axis=1)[:, :4]
    assert {(r[1], r[2]) for r in results[0]} == {(i, int(j)) for i in range(25) for j in top[i]}


def test_pivots_find_nearly_all_and_meet_fewer(spark):
    """Recall against the exact shortlist, and how many vectors meet."""
    from clauseloom.operators import shortlist

    rng = np.random.default_rng(5)
    topics = rng.random((60, 26))
    rows = [(1, side, i, [float(x) for x in np.abs(topics[rng.integers(60)] + rng.normal(scale=0.15, size=26))])
            for side, n in ((1, 600), (2, 872)) for i in range(n)]
    rows += [(2, 1, i, [1.0, float(i)] + [0.0] * 24) for i in range(5)]    # no right side
    rows += [(3, side, i, [0.0] * 26) for side in (1, 2) for i in range(7)]  # zero vectors, fewer than twelve
    rows += [(4, side, i, [1.0] * 26) for side in (1, 2) for i in range(50)]  # all alike
    rows += [(4, 1, 50, None)]
    frame = spark.createDataFrame(
        rows, "comparison_id long, side int, idx int, vector array<double>")
    unit = frame.withColumn("vector", vectors.unit(F.col("vector")))
    exact = {tuple(r) for r in align.nearest(unit.filter("vector is not null")).collect()}
    found = [{tuple(r) for r in shortlist.nearest_by_pivots(unit, block=b).collect()} for b in (1024, 10)]
    assert found[0] == found[1] and len(found[0]) == len(exact)
    large = {r for r in exact if r[0] == 1}
    assert len(large & found[0]) >= 0.95 * len(large)
    assert {r for r in exact if r[0] != 1} == {r for r in found[0] if r[0] != 1}
    assert shortlist.nearest_by_pivots(unit.limit(0)).count() == 0
    left, right = (unit.filter(f"comparison_id = 1 and side = {s}") for s in (1, 2))
    pivots = shortlist.pivots_of(right)
    dealt = [shortlist.homes(f, pivots, n).groupBy("pivot").count() for f, n in ((left, 32), (right, 1))]
    met = dealt[0].join(dealt[1].withColumnRenamed("count", "n"), "pivot").agg(F.sum(F.col("count") * F.col("n")))
    assert (600 + 872) * pivots.count() + met.first()[0] < 600 * 872


def test_alignment_takes_the_shortlist_by_pivots(spark):
    from clauseloom.operators import shortlist

    frame = sides(spark, [(str(i), f"clause on matter {i} alpha") for i in range(20)],
                  [(str(i), f"clause on matter {i} alpha") for i in range(20)])
    frame = frame.withColumn("vector", vectors.unit(F.array(F.lit(1.0), F.col("idx") * 0.1)))
    both = [sorted(map(str, align.align_semantic(frame, shortlist=s).collect()))
            for s in (align.nearest, shortlist.nearest_by_pivots)]
    assert both[0] == both[1]


def test_numbered_groups_over_many_partitions(spark):
    """One group over all partitions, ties of groups, null keys, empty frames, no window over rows."""
    from clauseloom.operators.positions import numbered

    rows = [(1, i * 7 % 5003, "x") for i in range(5003)] + [(None, 3, "b"), (None, 1, "a"), (2, 9, "c")]
    frame = spark.createDataFrame(rows, "g long, o long, t string")
    out = numbered(frame, ["g"], ["o"], "at", size="n")
    got = {(r["g"], r["o"]): (r["at"], r["n"]) for r in out.collect()}
    assert all(got[1, i] == (i, 5003) for i in range(5003))
    assert got[None, 1] == (0, 2) and got[None, 3] == (1, 2) and got[2, 9] == (0, 1) and len(got) == 5006
    assert numbered(frame.limit(0), ["g"], ["o"], "at").count() == 0
    assert out.columns == ["g", "o", "t", "at", "n"]


def test_reading_order_has_no_window_over_pairs(spark):
    frame = sides(spark, [(str(i), "a") for i in range(30)], [(str(i), "a") for i in range(0, 60, 2)])
    plan = align.reading_order(align.align_by_identifier(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(comparison_id" in plan  # of stretches only


def sides(spark, old, new):
    rows = [(1, side, i, number, None, None, text, i, len(clauses))
            for side, clauses in ((1, old), (2, new)) for i, (number, text) in enumerate(clauses)]
    return spark.createDataFrame(
        rows, "comparison_id long, side int, idx int, clause_number string, title string, "
        "section string, content string, ordinal int, version_size int")


def test_repeated_numbers_pair_in_order_and_reading_order(spark):
    frame = sides(spark, [("1", "a"), ("Table 1", "b"), ("2", "c"), ("Table 1", "d")],
                  [("0", "new"), ("1", "a"), ("Table 1", "b"), ("Table 1", "d"), ("Table 1", "e")])
    pairs = align.reading_order(align.align_by_identifier(frame)).orderBy("row_index").collect()
    assert [(p["index_v1"], p["index_v2"]) for p in pairs] == [
        (0, 1), (None, 0), (1, 2), (2, None), (3, 3), (None, 4)]


def test_empty_side_gives_one_sided_rows(spark):
    frame = sides(spark, [("1", "alpha beta"), ("2", "gamma")], [])
    rows = compare.semantic_rows(frame, lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)))
    got = rows.orderBy("row_index").collect()
    assert [(r["label"], r["change_type"], r["similarity_score"]) for r in got] == [
        ("1", fixed.REMOVED, None), ("2", fixed.REMOVED, None)]


def test_every_clause_is_in_exactly_one_row(spark):
    old = [(str(i), f"clause {i} about doors and stairs number {i * 7}") for i in range(20)]
    new = [(f"x{i}", text) for i, (_, text) in enumerate(old[3:])] + [("y", "wholly different")]
    from clauseloom.operators.embed import letter_profile

    rows = compare.semantic_rows(sides(spark, old, new), letter_profile).collect()
    assert sorted(r["v1"]["ordinal"] for r in rows if r["v1"]) == list(range(20))
    assert sorted(r["v2"]["ordinal"] for r in rows if r["v2"]) == list(range(18))
    assert sorted(r["row_index"] for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("n, segments", [(0, 0), (1, 1), (220, 220), (221, 111), (441, 147)])
def test_spine(spark, n, segments):
    frame = spark.range(n).select(
        F.lit(1).alias("comparison_id"), F.col("id").alias("row_index"),
        F.when(F.col("id") == n - 1, fixed.ADDED).otherwise(fixed.UNCHANGED).alias("change_type"))
    got = report.change_spine(frame).orderBy("start").collect()
    assert len(got) == segments and sum(s["clauses"] for s in got) == n
    if n:
        assert got[-1]["change_type"] == fixed.ADDED


def test_type_toggle():
    assert report.toggle_types((), ("Added",)) == tuple(
        t for t in fixed.CHANGE_TYPES if t != "Added")
    assert report.toggle_types(("Removed",), ("Added",)) == ()
    assert report.toggle_types(("Removed",), ()) == ()


def test_likeness_moves_a_set_once_and_equals_the_pairs_one_by_one(spark):
    texts = {1: ["a b c", "", "c d", "a a b", "x"], 2: ["b c d", "c", None, "a b", "y x", "a"]}
    sides = spark.createDataFrame(
        [(c, s, i, t, len(ts)) for c in (1, 2) for s, ts in texts.items() for i, t in enumerate(ts)],
        "comparison_id long, side int, idx int, content string, version_size int")
    pairs = spark.createDataFrame(
        [(c, i, j, 0.5) for c in (1, 2) for i in range(5) for j in range(6) if (i + j) % 2 or c == 2],
        "comparison_id long, index_v1 int, index_v2 int, cosine double")

    def wanted(i, j):
        a, b = [set((texts[s][k] or "").split()) for s, k in ((1, i), (2, j))]
        return (len(a & b) / len(a | b) if a and b else 0.0, 1.0 - abs(i / 4 - j / 5))

    for top_k, cell in ((12, 256), (12, 2), (1, 2)):  # one cell, cells whole, clause by clause
        found = align.with_likeness(pairs, sides, top_k, cell).collect()
        assert len(found) == pairs.count()
        for r in found:
            assert (r.lexical, r.positional) == pytest.approx(wanted(r.index_v1, r.index_v2))


def test_positions_leave_the_rows_where_they_lie(spark):
    frame = spark.createDataFrame([(i % 3, i, "t" * 50) for i in range(60)], "v long, o long, t string")
    plan = numbered(frame, ["v"], ["o"], "idx")._jdf.queryExecution().executedPlan().toString()
    # rows and stretches are both read as written
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "HashAggregate" not in plan


def test_export_sorts_written_rows(spark):
    frame = sides(spark, [(str(i), f"a {i}") for i in range(9)], [(str(i), "a b") for i in range(9)])
    rows = report.export_rows(compare.identifier_rows(frame), "Old", "New")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # a range sort runs what is below it twice
    assert "Sort" in plan and "redline_udf" not in plan
    assert rows.count() == 9 and "row_index" not in rows.columns


def small_sides(spark):
    rows = [(1, side, n, n, 10, f"{n % 3}.{n}", "Scope", "Section 1", f"Clause {n} of side {side % 2 + n % 2} says so.", n)
            for side in (1, 2) for n in range(10) if n != 3 * side]
    return spark.createDataFrame(rows, "comparison_id long, side int, idx long, id long, version_size long, "
                                       "clause_number string, title string, section string, content string, ordinal int")


def test_vectors_meet_pairs_before_texts(spark, monkeypatch):
    """Similarity is known when the texts come, so these need not move to the vectors."""
    brought, own = [], report.attach_sides
    monkeypatch.setattr(report, "attach_sides", lambda pairs, *rest: brought.append(pairs.columns) or own(pairs, *rest))
    encoder = lambda chunks: chunks.withColumn("vector", letter_profile(F.col("chunk")))
    found = compare.identifier_rows(small_sides(spark), encoder, in_row=False)
    plain = compare.identifier_rows(small_sides(spark), letter_profile)
    assert "similarity" in brought[0] and "similarity" not in brought[1]
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() == 10


def test_rows_to_label_carry_no_marked_texts(spark):
    rows = compare.identifier_rows(small_sides(spark), letter_profile)
    drawn = annotation.to_label(rows)
    assert drawn.schema["redline"].dataType.names == ["word_change_ratio"]
    for part in (annotation.sheet, annotation.answer_key):
        whole, less = (part(annotation.draw(f, size=6)) for f in (rows, drawn))
        assert sorted(map(str, whole.collect())) == sorted(map(str, less.collect())) and less.count() == 6


def test_positioned_texts_are_written_once_and_packed(spark, monkeypatch, tmp_path):
    written = []
    for module in (positions, fixtures):
        own = module.cut
        monkeypatch.setattr(module, "cut", lambda frame, own=own: written.append((frame.columns, own(frame))) or written[-1][1])
    spark.createDataFrame([(d, f"Text {d}.") for d in range(120)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert fixtures.positioned_sides(spark, str(tmp_path)).count() == 192
    texts = [copy for columns, copy in written if "content" in columns]
    assert len(texts) == 1 and all(".zstd." in name for name in texts[0].inputFiles())
