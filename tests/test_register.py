from pyspark.sql import functions as F

from clauseloom.operators import register
from clauseloom.plans import evolution

BOOKLET = """Introduction. Replace nothing here.
Volume 1 – Dwellings
List of amendments
Section 7: Compartmentation
Page 59\t
Replace paragraph 7.4 with the following.
Flats with a storey (see Diagram D6) should comply, in accordance with paragraph 3.5.
Delete paragraphs B1 to B5.
Page 60 to 61
Amend Tables 3.1 and 3.2.
Substitute the whole of Appendix B: reaction to fire and
structures with the following.
Paragraph 10.14, delete the second note.
Replace paragraph 7.4 again.
Diagram to the following
Volume 2 – Buildings other than dwellings
List of amendments
After paragraph 15.12, insert the following.
Replace paragraphs 3.7 to 3.10 and so on.
Amend appendices C and D.
In Section 17, delete all.
"""


def amendments(spark, text=BOOKLET):
    return register.parse_booklets(spark.createDataFrame([("b", text)], "booklet string, text string"))


def test_booklet(spark):
    got = {(r["volume"], r["operation"], r["reference"]) for r in amendments(spark).collect()}
    assert got == {
        (1, "replace", "7.4"), *[(1, "delete", f"B{i}") for i in range(1, 6)],
        (1, "amend", "Table 3.1"), (1, "amend", "Table 3.2"), (1, "replace", "Appendix B"),
        (1, "delete", "10.14"), (2, "insert", "15.12"), (2, "replace", "3.7"),
        (2, "replace", "3.10"), (2, "amend", "Appendix C"), (2, "amend", "Appendix D"),
        (2, "delete", "Section 17")}


def test_first_mention_is_kept(spark):
    row = amendments(spark).filter("reference = '7.4'").collect()
    assert [r["instruction"] for r in row] == ["Replace paragraph 7.4 with the following."]
    assert row[0]["aliases"] == ["7.4", "Requirement 7.4", "Section 7.4"]


def test_a_sentence_goes_on_before_a_number(spark):
    got = amendments(spark, "Replace paragraph 7.4 with the following. 7.4 See Diagram D6.")
    assert {r["reference"] for r in got.collect()} == {"7.4", "Diagram D6"}


def test_no_heading_means_no_volume(spark):
    got = amendments(spark, "Delete Table B2.\nVolume 1 – Dwellings").collect()
    assert [(r["volume"], r["reference"], r["aliases"]) for r in got] == [
        (None, "Table B2", ["Table B2", "B2"])]
    frame = amendments(spark, "Delete Table B2.")
    assert register.of_volume(frame, 2).count() == 1


def test_long_instructions_and_ranges_are_whole(spark):
    assert amendments(spark, "Replace paragraph 1.1 " + "with words " * 40 + "today").count() == 1
    assert amendments(spark, "Delete paragraphs B1 to B60.").count() == 60


def test_covers(spark):
    numbers = spark.createDataFrame(
        [("17.1",), ("17",), ("171.2",), ("B3",), ("Table b4",), ("Section 17",), ("7.4",),
         ("requirement b2",), ("BB",)], "clause_number string")
    reached = register.covers(amendments(spark), numbers, ["reference"], ["clause_number"])
    got = {(r["reference"], r["clause_number"]) for r in reached.collect()}
    assert got == {
        ("Section 17", "17.1"), ("Section 17", "17"), ("Section 17", "Section 17"),
        ("Appendix B", "B3"), ("Appendix B", "Table b4"), ("B3", "B3"),
        ("7.4", "7.4"), ("B2", "requirement b2")}


def test_section_of(spark):
    frame = spark.createDataFrame([(x,) for x in (
        "3.4", "Requirement B1", "B2", "Appendix A", "Table 1", "Diagram 2", "Section 4", "Annex")],
        "n string").select(evolution.section_of(F.col("n")).alias("s"))
    assert [r["s"] for r in frame.collect()] == [
        "Section 3", "Requirements", "Requirements", "Appendix", "Table", "Diagram", "Section 4",
        "Other"]


def test_instructions_are_read_once_and_ranges_keep_their_prefix(spark):
    text = "List of amendments\nDelete paragraphs B1 to B3. Nothing here. In Table A1, insert this. After paragraph 4.2, add that."
    found = register.parse_booklets(spark.createDataFrame([(1, text)], "booklet long, text string"))
    rows = {(r.reference, r.operation, r.position._sentence, r.position._reference) for r in found.collect()}
    assert rows == {("B1", "delete", 0, 0), ("B2", "delete", 0, 1), ("B3", "delete", 0, 2),
                    ("Table A1", "insert", 2, 0), ("4.2", "insert", 3, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(replace|delete|insert|add|amend|substitute)") == 2  # of two patterns, each once
