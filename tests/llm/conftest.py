import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000

#: doc_id, text, lang: nulls, empty and very long texts, and a repeated row.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog by the river bank", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "a row without an id that has some words in it", "en"),
    (4, LONG, "la"),
    (5, "repeated row with the same words in every place of the table", "en"),
    (5, "repeated row with the same words in every place of the table", "en"),
    (6, "1234 !!! 5678", "en"),
    (7, "İstanbul ﬁne Kelvin ß 中文 \x00 \x1c<|endoftext|>", "tr"),
]

CLASHING = ["score", "labels", "node", "label", "digest", "key", "path", "spans", "start", "end", "length", "piece", "_id", "class_id", "chosen", "first", "salt", "rank", "held_out"]


@pytest.fixture
def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
