"""Small documents with every odd case, for the operators of this folder."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Extra columns with names that operators use themselves.
        T.StructField("size", T.StringType()),
        T.StructField("_rank", T.LongType()),
        T.StructField("_id", T.LongType()),
        T.StructField("rest", T.StringType()),
        T.StructField("_size", T.LongType()),
        T.StructField("component_id", T.LongType()),
        T.StructField("grade", T.StringType()),
    ]
)


def odd_rows():
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))
    passage = " ".join(f"shared{i} passage" for i in range(60))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "a"),
        (2, "The quick brown fox jumps over the lazy dog again and again", "a"),
        (3, None, None),
        (4, "", ""),
        (5, " \n\t ", "b"),
        (6, long, "b"),
        (6, long, "b"),
        (7, "Äpfel ñandú 漢字漢字漢字 😀 fin", None),
        (None, "no id here but words", "c"),
        (None, None, None),
        (8, f"start one two three {passage} tail eight", "a"),
        (9, f"another beginning {passage} and an end", "c"),
        (10, "word", "c"),
        (11, "Released under the MIT License.", "a"),
        (12, "x" * 5000, "b"),
        (-5, "negative id text", "a"),
    ]
    return [
        (i, t, "en", s, None if t is None else len(t), "s", 7, 9, "r", 3, 4, "g") for i, t, s in texts
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
