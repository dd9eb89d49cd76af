import pytest
from pyspark.sql import functions as F

from clauseloom.operators import parse

LONG = "This sentence is long enough to make a clause of its own, without any doubt at all."


def clauses(spark, text, profile):
    frame = spark.createDataFrame([(1, text, profile)], "doc_id int, text string, profile string")
    return parse.parse_documents(frame, "doc_id").orderBy("ordinal").collect()


@pytest.mark.parametrize("profile, heading, number, section", [
    ("approved_document", "Requirement B3 Internal spread", "Requirement B3", "Requirement B3 Internal spread"),
    ("approved_document", "B1 Means of warning", "B1", "B1 Means of warning"),
    ("technical_handbook", "Standard 2.9", "Standard 2.9", "Standard 2.9"),
    ("technical_handbook", "2 Fire", "Section 2", "Section 2"),
    ("technical_booklet", "Part E: Fire", "Part E", "Part E Fire"),
    ("technical_guidance", "Appendix A Methods", "Appendix A", "Appendix A Methods"),
    ("british_standard", "Foreword", "Foreword", "Foreword"),
    ("generic", "Article 4 Scope", "4", "4 Scope"),
])
def test_headings_of_each_grammar(spark, profile, heading, number, section):
    second = "A.1 " if profile == "british_standard" else "1.2 "
    got = clauses(spark, f"{heading}\n{LONG}\n{second}{LONG}", profile)
    assert [c["clause_number"] for c in got] == [number, second.strip()]
    assert [c["section"] for c in got] == [section, section]
    assert [c["level"] for c in got] == [1, 2]


def test_long_heading_is_prose(spark):
    text = f"Standard 2.1 Title\n{LONG}\nStandard 3.1 " + "opening prose that runs on " * 5 + "and ends."
    got = clauses(spark, text, "technical_handbook")
    assert [(c["clause_number"], c["level"], c["section"]) for c in got] == [
        ("Standard 2.1", 1, "Standard 2.1 Title"), ("Standard 3.1", 2, "Standard 2.1 Title")]


def test_number_alone_tables_and_noise(spark):
    text = f"Fire safety: Volume 1\n1.1\n{LONG}\ntable A1 {LONG}\nApproved Document B, Volume 2"
    got = clauses(spark, text, "approved_document")
    assert [(c["clause_number"], c["level"], c["content"]) for c in got] == [
        ("1.1", 2, LONG), ("Table A1", 3, LONG)]


def test_preamble_only_with_clauses_and_length(spark):
    got = clauses(spark, f"{LONG}\n1.1 {LONG}", "generic")
    assert [(c["clause_number"], c["title"], c["level"]) for c in got] == [
        ("0", "Preamble", 1), ("1.1", None, 2)]
    assert len(clauses(spark, f"Too short.\n1.1 {LONG}", "generic")) == 1


def test_fragments_vanish_with_a_dropped_heading(spark):
    text = f"Section 1 Contents\n1.1 Stub\n1.2 {LONG}\n1.3 Tail\n(a) an item\nSection 2 More"
    got = clauses(spark, text, "approved_document")
    assert [(c["clause_number"], c["section"]) for c in got] == [("1.2", "Section 1 Contents")]
    # the stub's first line had become its title, which a merge does not carry along
    assert got[0]["content"] == f"{LONG}\n1.3 (a) an item"


def test_title_from_first_line(spark):
    text = f"1.1 Escape routes\n(a) {LONG}"
    got = clauses(spark, text, "generic")
    assert (got[0]["title"], got[0]["content"]) == ("Escape routes", f"(a) {LONG}")


def test_stranded_punctuation(spark):
    got = clauses(spark, f"Requirement B1\n: – {LONG}", "approved_document")
    assert got[0]["content"] == LONG


def test_list_markers_then_whole_document(spark):
    got = clauses(spark, f"intro\n(a) {LONG}\nii) {LONG}\n2) short", "generic")
    assert [(c["clause_number"], c["level"]) for c in got] == [("a", 3), ("ii", 3)]
    assert got[1]["content"].endswith("\n2 short")
    whole = clauses(spark, f"no numbers.\n{LONG}", "generic")
    assert [(c["clause_number"], c["content"]) for c in whole] == [("1", f"no numbers.\n{LONG}")]
    assert clauses(spark, "  ", "generic") == []


def test_detection(spark):
    texts = [(1, "Technical Booklet E\n1.1 Text"), (2, "nothing at all"),
             (3, "department of finance and personnel"), (4, "1.1 Text only")]
    frame = spark.createDataFrame(texts, "id int, text string").select(
        "id", parse.detected(F.col("text")).alias("d")).select("id", "d.*")
    found = {r["id"]: (r["profile"], r["confidence"]) for r in frame.collect()}
    assert found[1] == ("technical_booklet", 0.84)        # 10.5 of 12.5
    assert found[2] == ("generic", 0.0)
    assert found[3] == ("technical_booklet", 1.0)      # both phrases count
    assert found[4] == ("approved_document", 0.2)      # a tie goes to the first
