"""Source divergence against plain Python, word by word."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import DOCUMENTS, words
from panelloom.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = WORD.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [w for w, n in docs[lang].items() if n >= 3]

        def share(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}

        p = share(counts[lang, source])
        q = share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            o = share(counts[lang, other])
            pairs.append((-sum((p[w] - o[w]) ** 2 // o[w] for w in kept), other.encode()))
        terms = [
            (-((p[w] - q[w]) ** 2 // q[w]), w.encode())
            for w in kept
            if counts[lang, source][w] and p[w] > q[w]
        ]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found)[:most], 1):
                out.add((lang, source, part, item.decode(), -value, rank))
    return out


def corpus():
    rng = random.Random(8)
    pool = words(rng, 150) + ["Éa", "éa", "日本", "ÀB"]
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "fr", None, ""])
        # One source holds a third of the rows; some share no word with others.
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "ä", "z"])
        some = pool[:40] if source == "a" else pool
        text = " ".join(rng.choices(some, k=rng.randint(0, 60))).replace("a ", "A-")
        rows.append((i, text, lang, source, 0))
    rows += [rows[0]] * 3
    rows += [(900, None, "only", "x", 0), (901, "", "only", "y", 0), (None, None, None, None, None)]
    rows += [(902, "word word", "one", "x", 0), (903, "word 1 word2 word", "one", "x", 0),
             (904, "word", "one", "x", 0), (905, "3", "one", "z", 0)]
    return rows


@pytest.mark.parametrize("top,step", [(200, 1 << 15), (7, 16)])
def test_ranks_equal_those_of_plain_python(spark, monkeypatch, top, step):
    monkeypatch.setattr(divergence, "SKYBAND_ROWS", step)
    df = spark.createDataFrame(corpus(), DOCUMENTS).repartition(5)
    for name in ("g", "word", "n", "p", "value", "Item"):
        df = df.withColumn(name, F.lit("clash"))
    found = divergence.source_divergence(df, 3, top)
    assert {tuple(r) for r in found.collect()} == by_hand(corpus(), top)


def test_nothing_gives_nothing(nothing):
    assert divergence.source_divergence(nothing).collect() == []


def test_long_text_in_steps(monkeypatch):
    text = " ".join(words(random.Random(2), 5000)).encode() + " É1x,Y".encode()
    whole = [w for part in divergence.words_of(text) for w in part]
    monkeypatch.setattr(divergence, "TEXT_STEP", 97)
    assert [w for part in divergence.words_of(text) for w in part] == whole
    assert whole[-3:] == ["É".encode(), b"x", b"y"]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_skyband_keeps_words_with_fewer_dominators(k):
    rng = np.random.default_rng(k)
    n, all_n = rng.integers(1, 12, 700), rng.integers(1, 12, 700)
    spelling = rng.permutation(700)
    over = (n[None] >= n[:, None]) & (all_n[None] <= all_n[:, None])
    over &= spelling[None] < spelling[:, None]
    wanted = set(np.flatnonzero(over.sum(axis=1) < k))
    assert set(divergence.skyband(n, all_n, spelling, k)) == wanted
