import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, doc string, failed long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text, source) rows, with extra columns whose names the operators use inside."""

    def build(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "own", 9) for i, t, s in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"wort{i % 977}x{i % 13}" for i in range(60_000))
    return [
        (1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "", "a"), (3, None, None), (None, "lone text without an id", "b"),
        (None, None, None), (4, long, "b"), (5, long + " end", None), (6, "  \n\t ", "c"), (7, "Ünïcode wörds — naïve café 東京 текст", "c"), (8, "one two three four five six", ""),
    ]
