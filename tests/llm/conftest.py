import pytest


def make(spark, rows, schema):
    """Small tables in two partitions, so that partitions meet in every operator."""
    return spark.createDataFrame(rows, schema).repartition(2)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names could clash."""
    long_text = "a long line of words that goes on and on\n" * 3000
    rows = [
        (1, "Hello there, general  reader.\nSecond line of text here", "en", "s1", 7),
        (2, "Hello there, general reader.\n Second line of text here ", "en", "s1", 8),
        (3, None, None, None, None),
        (4, "", "en", "s2", 0),
        (5, long_text, "en", "s1", 9),
        (6, long_text + " ", "fr", "s2", 9),
        (7, "solo", None, "s3", 1),
        (7, "solo", None, "s3", 1),
        (None, "hello there, general reader.\nsomething else entirely", "en", "s1", 2),
        (8, "\t \n", "en", None, 3),
    ]
    return make(spark, rows, "doc_id long, text string, lang string, source string, kept long").selectExpr(
        "*", "doc_id AS id", "source AS raw", "lang AS `a.b`", "kept AS _drop", "text AS fp0", "kept AS epochs", "source AS _source", "kept AS _at", "kept AS _repeated_id"
    )


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
