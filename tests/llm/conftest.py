import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and a column with a clashing name."""
    rows = [
        (1, "the cat sat on the mat and then the cat sat again", "en", "a", 1, "x"),
        (1, "the cat sat on the mat and then the cat sat again", "en", "a", 1, "x"),
        (1, "another text under the same id", "en", None, 1, "x"),
        (2, None, "en", "a", None, None),
        (3, "", None, "b", 0, "y"),
        (4, " \n\t ", None, None, 4, "y"),
        (None, "a row without an id", "en", "b", 5, None),
        (None, None, None, None, None, None),
        (5, "lorem ipsum dolor " * 40000, "en", "a", 1, "long"),
        (6, "12345 67890 !!! ###", "en", "c", 1, "x"),
        (7, "Ünïcödé wörds \U0001f600 and ıstanbul K", "de", "c", 1, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA + ", fingerprint string").repartition(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
