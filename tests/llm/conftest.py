import pytest
from pyspark.sql import functions as F

#: Names that operators use inside themselves.
CLASHES = ["row", "id", "digest", "salt", "n", "kind", "node", "text_key", "tokens_", "words", "cell_source", "no_text"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with inner ones."""

    def frame(rows, extra=True):
        df = spark.createDataFrame(
            [(i, t, "en", "src", None) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long",
        )
        return df.withColumns({c: F.lit(7) for c in CLASHES}) if extra else df

    return frame


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a repeated id, a very long text, odd characters."""
    long_text = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
    return [
        (0, "one two three four five six"), (1, None), (2, ""), (3, "one two three four five six"),
        (3, "one two three four five six"), (None, "alpha beta gamma"), (None, None), (5, long_text),
        (6, long_text + " end"), (7, " \n\t "), (8, "short"), (9, "short"), (10, "Ünï cödé 日本  x"),
        (11, "same id"), (11, "other text"), (12, "\n\n"),
    ]
