import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, a clashing extra column."""
    long_text = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [
        (1, "", "en", "a", 0, "k"), (2, None, None, None, None, None), (3, " \n\t ", "en", "a", 3, "k"), (4, long_text, "en", "a", 1, "k"),
        (5, passage, "en", "a", 1, "k"), (6, "before " + passage + " after", "de", "a", 1, "k"), (6, "before " + passage + " after", "de", "a", 1, "k"),
        (None, passage, "en", None, 1, "k"), (7, "a " * 300, "fr", "b", 1, None), (8, "x" * 9000, "fr", "b", 1, "k"), (9, passage.upper(), "en", "b", 1, "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
