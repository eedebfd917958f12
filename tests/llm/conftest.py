from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and white texts, ties, repeated rows, and columns whose names the operators use inside.
ODD = [
    (None, None, None, None, None), (1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, " \n\t ", "en", "s", 1),
    (4, "one two three four five", "en", "s", 1), (4, "one two three four five", "en", "s", 1), (5, "one two three four five", "en", "s", 1),
    (6, "ab\nab\nab\nab", "en", "s", 1), (7, "é ß 日本 🙂 </s>[INST]", "en", "s", 1), (None, "a b c", "en", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, DOCS)
    for name in ("h", "fp", "node", "cell", "part", "key", "name", "first", "past", "n", "mask", "n_words", "toxic", "quality", "size", "at"):
        rows = rows.withColumn(name, F.lit("extra"))
    return rows


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
