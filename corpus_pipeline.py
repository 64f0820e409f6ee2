"""A training corpus from the documents: five stages, each on all its predecessor kept.

Toxic documents go; of near duplicates (five-word shingles, similarity 0.8) one document
stays; passages that a document with a smaller id has too are cut out; sources are mixed to
weights 5, 2, 1 in turn with three repetitions at most; and what is left is packed into
sequences of at most 2048 tokens.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of
``documents``; the last returns pieces with their sequence and place.  ``run`` writes every
stage below the shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm.common import vocabulary_path
from panelloom.llm.genetic_packing import pack_documents
from panelloom.llm.mixing import mixed_documents
from panelloom.llm.near_dedup import first_of_each
from panelloom.llm.suffix_dedup import without_repeats
from panelloom.llm.toxicity import without_toxic
from panelloom.sources.shared import shared_folder

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEQUENCE_TOKENS = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not hold for toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return first_of_each(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents before them have."""
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs, WEIGHTS, MAX_EPOCHS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return pack_documents(docs, vocabulary_path(VOCABULARY), SEQUENCE_TOKENS, END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

# Compression, tokenizers and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
