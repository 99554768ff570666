from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns
    that clash with names the operators use."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    body = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    rows = [
        (1, body, "en", "a", 10), (2, body, "en", "a", 10), (2, body, "en", "a", 10), (3, "", None, None, None), (4, None, "de", "b", 0), (5, "   ", "de", "b", 3),
        (6, long, "en", "a", 1), (7, long + " end", "en", None, 1), (None, "no id here", "en", "b", 2), (8, "two words", "en", "b", 2), (9, "two words", "fr", "b", 2),
        (10, "password = Abcdef123456789", "en", "a", 4), (11, "é中文 ß", "zh", "c", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("h1", "sig", "key", "node", "score", "base", "rank", "bucket", "part", "stratum", "rid", "_p", "size", "label", "term"):
        import pyspark.sql.functions as F

        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
