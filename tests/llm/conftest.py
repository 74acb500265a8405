import pytest
from pyspark.sql import functions as F


@pytest.fixture
def table(spark):
    """table(ddl, rows) -> DataFrame"""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)


@pytest.fixture
def awkward(table):
    """Documents with nulls in every column, empty and long texts, repeated rows, and a column of another name's case."""
    long_text = " ".join(f"word{i % 977} tail" for i in range(12_000))
    rows = [
        (1, "The cat sat on the mat and looked at the dog by the door.", "en", "a", 10, "x"),
        (1, "The cat sat on the mat and looked at the dog by the door.", "en", "a", 10, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, "a", 0, "y"),
        (None, "No id, yet a text with a number 42.", "de", "b", 5, "z"),
        (4, long_text, "fr", "a", len(long_text), "x"),
        (5, " \n\t ", "es", "b", 4, "x"),
        (6, "Ünïcödé 日本語 \U0001f600", None, None, None, None),
    ]
    return table("doc_id bigint, text string, lang string, source string, n_chars bigint, score string", rows)
