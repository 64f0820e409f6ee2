from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm import common
from panelloom.shipping import ship

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def byte_vocabulary():
    return common.vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_vocabulary():
    return common.vocabulary_path("word_bpe_49k.json")


def frame(spark, rows):
    """documents from (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdeiou", k=rng.randint(2, 7))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text."""
    rng = random.Random(5)
    base = " ".join(words(rng, 60))
    return [
        (1, base, "a"),
        (2, base, "a"),
        (2, base, "a"),
        (3, None, "b"),
        (4, "", "b"),
        (5, " \t\n ", None),
        (None, base, "a"),
        (None, None, None),
        (6, "x", "c"),
        (7, base + " and more", "c"),
        (8, " ".join(words(rng, 30_000)), "c"),
        (9, "Ünïcode   naïve 日本 🙂 <|endoftext|> x", "ä"),
        (10, "a" * 300, "b"),
        (11, "b" + "a" * 200, None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns that share names with what operators make."""
    df = frame(spark, odd_rows())
    for name in ("digest", "size", "kept", "bucket", "score", "block", "shard", "rep", "_row"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
