import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    parts = ["ka", "lo", "mi", "ter", "su", "van", "el", "ri", "do", "pe"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, a very long text."""
    rng = random.Random(5)
    same = words(rng, 60)
    long = words(rng, 30_000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", "b", 3),
        (5, "one two three four", "en", None, 18), (6, same, "en", "b", 1), (7, same, None, "b", 1), (8, same.upper(), "de", "a", 1),
        (8, same.upper(), "de", "a", 1), (None, same, "en", "a", 1), (None, None, None, None, None), (9, long, "fr", "c", 1),
        (10, "12 34 ... !!", "fr", "c", 1), (11, "é à ü ñ — “x” y z", "fr", "c", 1), (12, same + " tail", "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def odd_extra(odd):
    """Extra columns whose names could clash with an operator's own."""
    from pyspark.sql import functions as F

    names = ["key", "rep", "comp", "h", "size", "score", "part", "shard", "spans", "start", "n_words", "blk", "total", "kind", "copies", "mult"]
    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
