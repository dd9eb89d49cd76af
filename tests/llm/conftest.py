import pytest

from clauseloom.llm.store import ship


@pytest.fixture(autouse=True, scope="session")
def _shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and odd characters."""
    base = "Alpha beta gamma delta. " * 30
    rows = [
        (1, "one two three four five six seven", "en", "a"), (2, "ONE two three four five six seven", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, base, "de", "b"), (6, "x" + base, "de", "c"),
        (7, base, "de", "c"), (7, base, "de", "c"), (8, "Éa ßb c\n\nd  e\t", "fr", "é"), (None, "no id", "fr", "é"),
        (None, None, None, None), (9, "line a\nline b\nline c\nline d\n" + base, "en", "a"),
        (10, "zz\nline a\nline b\nline c\nline d\n" + base.upper(), "en", "a"), (11, "word " * 5000, "en", "z"),
        (12, "ab" * 9000, "en", "z"), (13, "<|endoftext|> it's 12 <|startoftext|>", "en", "z"), (14, " lead", "en", "z"),
        (15, "trail ", "en", "z"), (16, "é a ́b Σας ΟΔΟΣ", "el", "z"), (17, "one two", "en", "z"),
    ]
    out = [(i, t, lang, s, len(t or ""), "extra", 1, 2) for i, t, lang, s in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, "
                                      "k1 string, times int, `odd.name` int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
