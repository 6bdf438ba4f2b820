import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use for what they add or need inside.
CLASHING = ["ids", "n_ids", "round_trip", "language", "margin", "ambiguous", "n_copies", "n_removed", "n_tokens", "_h1", "_rest", "_order", "_salt", "_key", "_gone", "_bad_id", "id", "t", "node", "label"]


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text) or longer rows."""

    def make(rows, clashing=False):
        full = [tuple(r) + ("en", "s1", None)[len(r) - 2 :] if len(r) < 5 else tuple(r) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for c in CLASHING if clashing else []:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit(f"own {c}"))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Random prose: words(n) are n words."""
    r = random.Random(7)
    vocabulary = ["".join(r.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ß"], k=r.randrange(1, 5))) for _ in range(3000)]

    def words(n, seed):
        return random.Random(seed).choices(vocabulary, k=n)

    return words


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in every column, empty and very long texts, repeated rows."""
    long = " ".join(prose(60_000, 99))
    return [(None, "a text without an id", None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "s", 6), (4, long, "fr", "s", len(long)), (5, "twice the same row", "en", "s", 1), (5, "twice the same row", "en", "s", 1), (6, "x" * 50_000, "en", "s", 1), (7, "!!! ??? ###", "en", "s", 1)]
