import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("shard", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("cls", T.StringType()), T.StructField("start", T.StringType()), T.StructField("page", T.StringType()),
    ]
)


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("ba de ki lo mu na po ra si tu".split()) + rng.choice("ba de ki lo mu na po ra si tu".split()) + str(rng.randint(0, 30)) for _ in range(n)]


def edited(text, seed, share=0.02):
    rng = random.Random(seed)
    return " ".join("zz" + str(rng.randint(0, 10**6)) if rng.random() < share else w for w in text.split(" "))


def odd_rows():
    """(doc_id, text): nulls, empties, white space, repeated rows and ids, copies, near copies, a very long text."""
    base = " ".join(words(1, 200))
    rows = [(1, base), (2, base), (3, edited(base, 3)), (4, edited(base, 4)), (4, edited(base, 4)), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "one"), (9, "ONE"), (10, "two words"), (None, base), (None, None), (None, "stray text"), (11, "a\x00b é ñ 漢字 \U0001f600 x"), (6, "")]
    rows += [(12, " ".join(words(12, 30_000)))]
    rows += [(100 + i, " ".join(words(i, 60))) for i in range(40)]
    rows += [(200 + i, " ".join(words(500, 55)) + " " + " ".join(words(200 + i, 200))) for i in range(20)]  # a shared passage
    return rows


def as_table(spark, rows):
    full = [(i, t, "en", None if (i or 0) % 5 == 0 else f"src{(i or 0) % 3}", len(t or ""), "x", 1.0, 2, "y", "z", "p") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return as_table(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
