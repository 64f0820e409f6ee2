"""Every stage of the pipeline over planted rows, each compared with plain Python."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from llm_fixtures import words
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_texts import WORD, classes_by_hand, encoded, targets_by_hand


BIG = 2**53
COLUMNS = [
    ("doc_id", T.LongType()),
    ("text", T.StringType()),
    ("lang", T.StringType()),
    ("source", T.StringType()),
    ("n_chars", T.LongType()),
    # Names that stages use for columns of their own.
    ("_place", T.StringType()),
    ("_DOC", T.StringType()),
    ("_spans", T.StringType()),
    ("size", T.StringType()),
    ("score", T.StringType()),
    ("row", T.StringType()),
]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in COLUMNS])
LABELS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())]
)


def planted():
    """Rows (doc_id, text, source), labels, and the ids of the toxic documents."""
    rng = random.Random(21)
    known, insults = words(rng, 500), [w + "zq" for w in words(rng, 6)]

    def plain(n):
        return rng.choices(known, k=n)

    rows = [(i, " ".join(plain(rng.randint(30, 70))), rng.choice("abc")) for i in range(240)]
    toxic = set(range(400, 480))
    for i in toxic:
        text = plain(30)
        for at in range(0, 30, 4):
            text.insert(at, rng.choice(insults))
        rows.append((i, " ".join(text), rng.choice("abc")))
    labels = [(i, int(i in toxic)) for i, _, _ in rows] + [(None, 1), (9999, None)]
    # Near copies: one word changed, an exact copy, a chain of changes.
    base = plain(60)
    for k, i in enumerate((500, 501, 502, 503)):
        rows.append((i, " ".join([*base[: 60 - k], *words(rng, k)]), "a"))
    rows.append((504, rows[7][1], "b"))
    # A passage that documents share, and another that stands twice in one of them.
    passage = " ".join(plain(25))
    for i in range(510, 516):
        rows.append((i, " ".join([*plain(40), passage, *plain(20)]), "c"))
    rows.append((516, " ".join([*plain(30), "é", passage, passage, "日本"]), "c"))
    # Nulls, blanks, repeats, one id with two texts, ids beyond 2^53 beside null ids.
    rows += [(520, None, "a"), (521, "", None), (522, " \t\n", "b"), (None, None, None)]
    rows += [(None, " ".join(plain(33)), "a"), rows[3], rows[3]]
    rows += [(530, " ".join(plain(45)), "a"), (530, " ".join(plain(45)), "b")]
    rows += [(BIG + 1, " ".join(plain(40)), "b"), (BIG + 3, " ".join(plain(40)), "b")]
    rows += [(-(2**63), " ".join(plain(40)), None), (540, " ".join(plain(6000)), "c")]
    return rows, labels, toxic


def plain_rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def lowest_first(rows):
    """What stays of each class: one row for every (id, set) of the smallest id."""
    labels = {}
    for i, _, c, _ in classes_by_hand(rows, 5, 80):
        labels.setdefault(i, c)
    named = {r for r in rows if r[0] is not None and labels[r[0]] == r[0]}
    return Counter(named) + Counter(r for r in rows if r[0] is None)


def cut_by_hand(rows):
    seen, out = {}, Counter()
    for i, t, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 49):
            if i is not None and seen.setdefault(data[at : at + 50], i) < i:
                gone[at : at + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
        out[i, None if t is None else left, s] += 1
    return out


def mix_by_hand(rows, mixed):
    """Whether ``mixed`` takes whole repetitions and beginnings, near every target."""
    n = [len(WORD.findall((t or "").encode())) for _, t, _ in rows]
    sizes, taken = {}, {}
    for (_, _, s), size in zip(rows, n, strict=True):
        sizes[s] = sizes.get(s, 0) + size
    whole = Counter(rows)
    starts = {(i, s, tuple((t or "").split()[:k])) for i, t, s in rows for k in range(1, 90)}
    words_of = Counter()
    for i, t, s in mixed:
        size = len(WORD.findall(t.encode()))
        taken[s] = taken.get(s, 0) + size
        words_of[i, s] += size
        assert (i, t, s) in whole or (i, s, tuple(t.split())) in starts
    for s, target in targets_by_hand(sizes, (5, 2, 1), 3).items():
        assert abs(taken.get(s, 0) - target) <= 3
    most = Counter()
    for (i, _, s), size in zip(rows, n, strict=True):
        most[i, s] += 3 * size
    assert all(w <= most[key] for key, w in words_of.items())


def test_every_stage_over_planted_rows(spark, tmp_path, word_vocabulary):
    rows, labels, toxic = planted()
    full = [
        (i, t, "en", s, None if t is None else len(t), *["clash"] * 6) for i, t, s in rows
    ]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == [c for c, _ in COLUMNS]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = plain_rows(docs)
        assert docs.where(F.col("row") != "clash").count() == 0
        lengths = docs.select("text", "n_chars").where(F.col("text").isNotNull()).collect()
        assert all(r.n_chars == len(r.text) for r in lengths)

    clean = Counter(r for r in rows if r[0] not in toxic)
    assert Counter(held["toxicity"]) == clean
    assert Counter(held["near_dedup"]) == lowest_first(held["toxicity"])
    ids = {i for i, _, _ in held["near_dedup"]}
    assert 500 in ids and not ids & {501, 502, 503, 504}
    assert {BIG + 1, BIG + 3, -(2**63)} <= ids
    assert sum(i == 530 for i, _, _ in held["near_dedup"]) == 2
    assert Counter(held["suffix_dedup"]) == cut_by_hand(held["near_dedup"])
    assert sum(len(t or "") for _, t, _ in held["suffix_dedup"]) < sum(
        len(t or "") for _, t, _ in held["near_dedup"]
    )
    mix_by_hand(held["suffix_dedup"], held["source_mix"])

    packed = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    wanted = Counter()
    for (i, _, _), found in zip(
        held["source_mix"], encoded(word_vocabulary, [t for _, t, _ in held["source_mix"]]), strict=True
    ):
        found = np.array([*found, 0], "<u4")
        for k, start in enumerate(range(0, len(found), 2048)):
            part = found[start : start + 2048]
            wanted[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == wanted
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(k[3] * n for k, n in wanted.items())
    assert len(bins) <= math.ceil(total / 2048) + 1

    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32")
    assert Counter(map(tuple, whole.collect())) == Counter(
        (r.doc_id, r.piece, r.ids_crc32) for r in packed
    )


def test_stages_over_rows_without_words(spark, tmp_path):
    rows = [(1, None), (1, None), (None, None), (2, " \n")]
    full = [(i, t, None, None, None, *["clash"] * 6) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        counts.append(docs.count())
    # Of repeated rows one stays; the mix takes no words and so no rows.
    assert counts == [4, 3, 3, 0, 0]
