"""Toxicity by held-out accuracy and on odd rows, and the pipeline without rows."""

from __future__ import annotations

import os

import corpus_pipeline
import pytest
from pyspark.sql import types as T

from panelloom.llm import toxicity

TABLES = "/root/testdata/sf0.01"
LABELS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]
)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    scored = toxicity.toxicity_scores(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 30
    assert all(0.0 <= r.score <= 1.0 and r.predicted == (r.score >= 0.5) for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right >= 0.9


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame(
        [(1, 0, 0), (2, 0, 1), (None, 0, 1), (3, 1, None), (6, None, 1), (6, None, 0)], LABELS
    )
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0.0 <= r.score <= 1.0 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity_scores(odd, none).collect()} == {0.0}


def test_run_over_an_empty_corpus(spark, nothing, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "source_mix", "packing"]
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
