"""Ids beyond 2^53 beside null ids, and rows that share an id, through all text operators."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import DOCUMENTS
from panelloom.llm import (
    bpe_counts, genetic_packing, licences, mixing, near_dedup, packed_ids, suffix_dedup, toxicity,
)

IDS = [2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1, 2**53 + 2, None]


def corpus():
    rows = [
        (i, " ".join(f"w{n}x{k}" for k in range(30)) + f" tail{n}", "en", "a", 0)
        for n, i in enumerate(IDS)
    ]
    return rows + [(2**53 + 1, "another text under the same id", "en", "b", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    # One batch, so that the null lies beside every id.
    return spark.createDataFrame(corpus(), DOCUMENTS).coalesce(1)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_operators_keep_ids(spark, docs, word_vocabulary, byte_vocabulary):
    wanted = Counter(r[0] for r in corpus())
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert ids(licences.licence_scan(docs)) == wanted
    assert ids(suffix_dedup.repeat_report(docs)) == wanted
    assert ids(bpe_counts.token_counts(docs, byte_vocabulary)) == wanted
    assert ids(mixing.mix(docs, (5, 2, 1), 3)) == wanted
    assert ids(near_dedup.near_duplicates(docs, 2, 80)) == wanted
    assert ids(packed_ids.packed_documents(docs, word_vocabulary, 2)) == wanted
    packed = genetic_packing.pack_documents(docs, word_vocabulary)
    assert ids(packed) == wanted
    scored = toxicity.toxicity_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in scored) == wanted
    for r in scored:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held


@pytest.mark.parametrize("stage", ["near_dedup", "suffix_dedup", "source_mix"])
def test_stages_keep_ids_texts_and_columns_of_any_name(spark, docs, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    names = ["_doc", "_digest", "_Whole", "_spans", "_place", "place", "row", "_size", "extra",
             "copy", "plan", "key", "part", "set", "text_key", "_mix_copies", "a.b"]
    wide = docs
    for name in names:
        wide = wide.withColumn(name, F.lit(f"own {name}"))
    out = function(spark, wide, "")
    assert out.columns == wide.columns
    rows = out.collect()
    assert all(r[name] == f"own {name}" for r in rows for name in names)
    # Nothing repeats but under the mix, which takes what there is several times.
    texts = {(r[0], r[1]) for r in corpus()}
    if stage == "source_mix":
        assert {r.doc_id for r in rows} <= set(IDS)
        assert all(any(r.doc_id == i and t.startswith(r.text) for i, t in texts) for r in rows)
    else:
        assert {(r.doc_id, r.text) for r in rows} == texts


def test_near_copies_go_and_other_texts_under_their_id_stay(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 0), (1, "something else entirely", "en", "a", 0),
        (1, base, "en", "a", 0), (2, base + " more", "en", "a", 0), (2, "kept for itself", "en", "b", 0),
        (3, "", "en", "a", 0), (3, None, "en", "a", 0), (None, base, "en", "a", 0),
    ]
    out = near_dedup.first_of_each(spark.createDataFrame(rows, DOCUMENTS), 5, 80)
    found = Counter((r.doc_id, r.text) for r in out.collect())
    assert found == Counter(
        {(1, base): 1, (1, "something else entirely"): 1, (2, "kept for itself"): 1,
         (3, ""): 1, (3, None): 1, (None, base): 1}
    )
