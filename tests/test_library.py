import csv
import glob

import pytest
from pyspark.sql import functions as F

from clauseloom import fixed
from clauseloom.operators import metrics, report
from clauseloom.operators.search import search
from clauseloom.plans import annotation, cross_country
from clauseloom.plans.ingest import (
    ingest_report, library_rows, parse_submissions, split_rejects,
)
from clauseloom.operators import search_index
from clauseloom.operators.search import search
from clauseloom.sources import corpus, library
from clauseloom.streaming.ingest import SUBMISSIONS, batch_number, read_submissions, start_ingest

BODY = "The building shall be designed so that there are provisions for early warning of fire."


def submissions(spark, *rows):
    full = [(*r[:4], None, None, None, None, r[4]) for r in rows]
    frame = spark.createDataFrame(full, SUBMISSIONS.replace("uploaded_at timestamp", "uploaded_at long"))
    return frame.withColumn("uploaded_at", F.timestamp_seconds("uploaded_at"))


def state(store):
    counts = store.clauses().groupBy(F.col("version_id").alias("id")).agg(
        F.count("*").alias("n"), F.max("content").alias("c"))
    rows = store.versions().drop("batch").join(counts, "id").join(
        store.documents().select(F.col("id").alias("document_id"), "name", "country_code"),
        "document_id")
    return sorted((r["name"], r["version_label"], r["country_code"], r["n"], r["c"])
                  for r in rows.collect())


def test_ingest_stream_equals_batch_and_replaces(spark, tmp_path):
    first = [("Guide A", "2019", "AUTO", f"Technical Booklet E\n1.1 {BODY}\n1.2 {BODY}", 100),
             ("Guide B", "2020", "SC", f"2.1 {BODY}", 100), (" ", "x", "SC", f"1.1 {BODY}", 100),
             ("Guide C", "2020", "SC", "12", 100)]
    second = [("Guide A", "2019", "AUTO", f"Technical Booklet E\n1.1 {BODY} Again.", 200)]
    inbox = str(tmp_path / "inbox")
    store = library.LibraryStore(spark, str(tmp_path / "library"))
    for rows in (first, second, second):                      # the last one delivered twice
        submissions(spark, *rows).coalesce(1).write.mode("append").parquet(inbox)
        query = start_ingest(read_submissions(spark, inbox), store.root, str(tmp_path / "ck"))
        query.awaitTermination()
    wanted = [("Guide A", "2019", "NI", 1, f"{BODY} Again."), ("Guide B", "2020", "SC", 1, BODY)]
    assert state(store) == wanted
    rejects = spark.read.parquet(f"{store.root}/rejects").select("reason").distinct().collect()
    assert {r["reason"] for r in rejects} == {"no document name", "no readable text"}

    batch = library.LibraryStore(spark, str(tmp_path / "batch"))
    parsed, _ = split_rejects(parse_submissions(submissions(spark, *first, *second)))
    assert {r["profile_name"] for r in ingest_report(parsed).collect()} == {
        "technical_booklet", "technical_handbook"}
    batch.store(*library_rows(parsed), 1)
    assert state(batch) == wanted


def test_store_deletes_with_what_lies_below(spark, tmp_path):
    store = library.LibraryStore(spark, str(tmp_path))
    rows = [("A", "1", "SC", f"1.1 {BODY}", 1), ("A", "2", "SC", f"1.1 {BODY}", 2),
            ("B", "1", "SC", f"1.1 {BODY}", 3)]
    parsed, _ = split_rejects(parse_submissions(submissions(spark, *rows)))
    store.store(*library_rows(parsed), 1)
    store.delete_documents(store.documents().filter("name = 'A'"), 2)
    assert [s[:2] for s in state(store)] == [("B", "1")]
    assert [r["name"] for r in store.documents().collect()] == ["B"]
    assert store.clauses().count() == 1


def test_compacted_store_holds_the_same_and_goes_on(spark, tmp_path):
    store = library.LibraryStore(spark, str(tmp_path / "old"))
    for number, rows in enumerate([
            [("A", "1", "SC", f"1.1 {BODY}", 1), ("B", "1", "SC", f"1.1 {BODY}", 1)],
            [("A", "1", "SC", f"1.1 {BODY} Again.", 2)]], start=1):
        store.store(*library_rows(split_rejects(parse_submissions(submissions(spark, *rows)))[0]), number)
    store.delete_documents(store.documents().filter("name = 'B'"), 3)
    small = store.compacted(str(tmp_path / "new"))
    assert store.last_batch() == small.last_batch() == 3
    assert state(small) == state(store) == [("A", "1", "SC", 1, f"{BODY} Again.")]
    assert library.LibraryStore(spark, str(tmp_path / "none")).last_batch() == 0
    small.delete_documents(small.documents(), 4)
    assert state(small) == []


def test_streams_and_batches_share_one_sequence(spark, tmp_path):
    """Stream, batch, stream: the last one written counts, and a number is never given twice."""
    store = library.LibraryStore(spark, str(tmp_path / "library"))

    def edition(again, day):
        return [("Guide A", "2019", "SC", f"1.1 {BODY}{again}", day)]

    def by_stream(rows, name):
        inbox = str(tmp_path / f"inbox-{name}")
        submissions(spark, *rows).coalesce(1).write.mode("append").parquet(inbox)
        start_ingest(read_submissions(spark, inbox), store.root, str(tmp_path / name)).awaitTermination()

    by_stream(edition(" One.", 100), "first")
    assert state(store)[0][4] == f"{BODY} One." and store.last_batch() == 1
    store.store(*library_rows(split_rejects(parse_submissions(submissions(spark, *edition(" Two.", 200))))[0]))
    assert state(store)[0][4] == f"{BODY} Two." and store.last_batch() == 2
    by_stream(edition(" Three.", 300), "first")
    assert state(store)[0][4] == f"{BODY} Three." and store.last_batch() == 3
    by_stream(edition(" Four.", 400), "other")
    assert state(store)[0][4] == f"{BODY} Four." and store.last_batch() == 4

    checkpoint = str(tmp_path / "first")
    assert batch_number(store, checkpoint, 1) == 3  # a micro-batch that runs again
    assert [store.claim(), store.claim()] == [5, 6]
    hand = library.LibraryStore(spark, str(tmp_path / "hand"))
    rows = library_rows(split_rejects(parse_submissions(submissions(spark, *edition("", 1))))[0])
    hand.store(*rows, 7)
    with pytest.raises(ValueError):
        hand.store(*rows, 3)
    hand.store(*rows, 7)
    assert hand.claim() == 8


def test_registry(spark):
    entries = corpus.registry_table(spark)
    assert entries.count() == 22 and corpus.open_entries(entries).count() == 19
    assert corpus.load_plan(spark).join(entries, "key").count() == 17
    assert corpus.jurisdictions(spark).count() == 6


def test_text_and_file_scans(spark, tmp_path):
    (tmp_path / "adb-amd-2020.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("", encoding="utf-8")
    texts = {r["key"]: r["text"] for r in corpus.read_texts(spark, str(tmp_path)).collect()}
    assert texts["adb-amd-2020"] == "one\ntwo"
    files = corpus.file_listing(spark, str(tmp_path))
    entries = spark.createDataFrame([("adb-amd-2020.txt",), ("empty.txt",), ("absent.txt",)],
                                    "filename string")
    got = {r["filename"]: (r["present"], r["size_bytes"])
           for r in corpus.coverage(entries, files).collect()}
    assert got == {"adb-amd-2020.txt": (True, 7), "empty.txt": (False, 0),
                   "absent.txt": (False, 0)}


def test_search_needs_two_characters_and_bounds_its_limit(spark):
    docs = spark.createDataFrame([(1, "D", "EW")], "id long, name string, country_code string")
    versions = spark.createDataFrame([(1, 1, "v")], "id long, document_id long, version_label string")
    clauses = spark.createDataFrame(
        [(1, 1, "B3", None, "a fire door", None, 0, None)],
        "id long, version_id long, clause_number string, title string, content string, "
        "section string, level int, ordinal int")
    assert search(" b3 ", docs, versions, clauses).first()["level"] == 2
    assert search("f", docs, versions, clauses).count() == 0
    many = clauses.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(700)))).drop("copy")
    assert search("fire", docs, versions, many).count() == 700
    assert search("fire", docs, versions, clauses, limit=0).count() == 0


def test_csv_export_quotes(spark, tmp_path):
    side = "struct<clause_number:string,title:string,section:string,content:string,ordinal:int>"
    rows = spark.createDataFrame(
        [(0, "Removed", None, None, ("1", None, None, 'a "q", b\nc', 0), None, (0, 4))],
        f"row_index long, change_type string, similarity_score double, match_score double, "
        f"v1 {side}, v2 {side}, redline struct<words_added:long,words_removed:long>")
    library.write_csv(report.export_rows(rows, "2019", "2025").coalesce(1), str(tmp_path / "out"))
    with open(glob.glob(str(tmp_path / "out" / "*.csv"))[0], newline="") as handle:
        read = list(csv.DictReader(handle))
    assert read == [{
        "Change Type": "Removed", "2019 Clause": "1", "2019 Section": "", "2019 Text": 'a "q", b\nc',
        "2025 Clause": "", "2025 Section": "", "2025 Text": "(not present)", "Similarity": "N/A",
        "Match Confidence": "N/A", "Words Added": "0", "Words Removed": "4"}]


def test_study_results_as_json(spark, tmp_path):
    library.write_study(spark.range(3), str(tmp_path / "study"))
    assert spark.read.json(str(tmp_path / "study")).count() == 3


def test_empty_matrix_and_perfect_agreement(spark):
    rows = spark.createDataFrame([("Added", "Added")] * 3, "truth string, prediction string")
    got = metrics.matrix_scores(metrics.confusion(rows), fixed.CHANGE_TYPES).first()
    assert (got["accuracy"], got["macro_f1"], got["kappa"]) == (1.0, 1.0, 1.0)
    nothing = spark.createDataFrame([], "x double")
    assert metrics.describe(nothing, "x").first()["count"] == 0


def test_unknown_label_is_an_error(spark):
    sheet = spark.createDataFrame(
        [(1, 0, "changed a bit", "", "1", "1", "")],
        "comparison_id long, id long, annotator_change_type string, annotator_alignment_ok string, "
        "clause_v1 string, clause_v2 string, annotator_notes string")
    key = spark.createDataFrame([(1, 0, "Added", 0.5)],
                                "comparison_id long, id long, system_change_type string, "
                                "system_similarity double")
    with pytest.raises(Exception, match="unknown label"):
        annotation.labelled(sheet, key).collect()
    assert annotation.labelled(sheet, key, strict=False).first()["truth"] is None


def test_terms_across_short_clauses(spark):
    texts = ["means", "of", "escape", "", "fire", "door", "fire  door", "means", "", "of escape",
             "Fire Door"]
    clauses = spark.createDataFrame(
        [(1, i, i, t) for i, t in enumerate(texts)],
        "version_id long, id long, ordinal int, content string")
    joined = " ".join(texts).lower()
    rates = cross_country.term_rates(clauses, "version_id").collect()
    assert {r["term"]: r["uses"] for r in rates} == {
        t: joined.count(t) for ts in fixed.TERM_FAMILIES.values() for t in ts}


def test_indexed_search_equals_the_scan(spark, tmp_path):
    texts = ["Fire doors", "FIRE  DOOR", "a fire, door", "100% of it", "ab", None, "Ünder the tür", "x" * 5000 + "fire"]
    rows = [(i, 1, str(i), None if i % 2 else "Fire title", t, None, "General" if i == 4 else None, None, i)
            for i, t in enumerate(texts)]
    clauses = spark.createDataFrame(rows, library.CLAUSES)
    versions = spark.createDataFrame([(1, 1, "v", None, None, None, None, None)], library.VERSIONS)
    documents = spark.createDataFrame([(1, "d", None, "EW", None, None, None)], library.DOCUMENTS)
    path = str(tmp_path / "postings")
    search_index.write_postings(clauses, path)
    index = spark.read.parquet(path)
    assert index.count() == index.distinct().count()
    for term in ("fire", "Fire door", "fire%door", "_ire doo", "0% of", "ab", "e", "general", "tür", "ünder", "nowhere",
                 "re\\%do", "the t"):
        found, wanted = (sorted(r["id"] for r in f.collect()) for f in (
            search_index.indexed_search(term, index, documents, versions, clauses),
            search(term, documents, versions, clauses)))
        assert found == wanted, term
    assert search_index.term_grams("a%fir_door") == ["doo", "fir", "oor"]


def test_postings_take_the_grams_of_a_clause_once(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = ["Fire doors", "aaaa", "a😀bc d", "😀😀😀", "x\ny", "ab", "", None, "Straße ÉÀÜ"]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", seen("t").alias("content"), *[
        F.lit(None).cast("string").alias(c) for c in ("title", "section", "clause_number")])
    path = str(tmp_path / "postings")
    search_index.write_postings(rows, path)
    found = sorted((r["gram"], r["id"]) for r in spark.read.parquet(path).collect())
    lows = [(i, t.lower()) for i, t in enumerate(texts) if t]
    assert found == sorted({(t[k:k + 3], i) for i, t in lows for k in range(len(t) - 2)})
    assert read.value == len(texts)


def test_only_the_clause_table_moves_clauses(spark):
    """Documents and versions of parsed rows are aggregated without the clause arrays."""
    text = "1.1 The first paragraph is long enough to be kept as a clause of its own here, as all can see at once.\n"
    rows = [(f"Guide {n % 3}", "v1", "EW", text * (n + 1)) for n in range(6)]
    parsed = split_rejects(parse_submissions(spark.createDataFrame(
        rows, "document_name string, version_label string, country_code string, text string").withColumn(
        "uploaded_at", F.lit("2024-01-01").cast("timestamp"))))[0]
    documents, versions, clauses = library_rows(parsed.localCheckpoint())
    moves = [any("clauses" in c or "c#" in c for c in f._jdf.queryExecution().optimizedPlan().toString().splitlines()
                 if "Aggregate" in c) for f in (documents, versions, clauses)]
    assert moves == [False, False, True]
    assert documents.count() == versions.count() == 3 and clauses.count() >= 3
