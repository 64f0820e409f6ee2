"""Phrase collocations against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import DOCUMENTS, words
from panelloom.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top):
    f = defaultdict(Counter)
    for _, text, lang, _, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f[lang or "und" if lang is None else lang].update(
                    tuple(w[i : i + size]) for i in range(len(w) - size + 1)
                )
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        found = []
        for p, a in count.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(
                100 * c >= 50 * a for t, c in count.items()
                if len(t) == 3 and c >= least and p in (t[:2], t[1:])
            ):
                continue
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    pool = words(rng, 12) + ["É", "b\x00c", "\x1c", "\x85x"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "fr", None, ""])
        text = "".join(
            w + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "\r\n", ",", ":;"])
            for w in rng.choices(pool, k=rng.randint(0, 60))
        )
        rows.append((i, text.title() if i % 5 == 0 else text, lang, "s", 0))
    # One phrase that a third of all rows hold, often overlapping itself.
    rows += [(i, "very very very very common phrase", "en", "s", 0) for i in range(300, 430)]
    rows += [rows[3]] * 12
    rows += [(None, None, None, None, None), (600, "", "de", "s", 0), (601, " . , ", "de", "s", 0)]
    return rows


@pytest.mark.parametrize("budget", [1 << 21, 300, 20])
def test_phrases_equal_those_of_plain_python(spark, monkeypatch, budget):
    df = spark.createDataFrame(corpus(), DOCUMENTS).repartition(6)
    for name in ("a", "b", "word", "n", "block", "rank", "All"):
        df = df.withColumn(name, F.lit("clash"))
    found = collocations.collocations(df, 10, 50, 60, group_suffixes=budget)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(corpus(), 10, 60)


def test_nothing_gives_nothing(nothing):
    assert collocations.collocations(nothing).collect() == []


@pytest.mark.parametrize("step", [7, 40, 300])
def test_suffixes_of_long_texts_in_steps(monkeypatch, step):
    rng = random.Random(step)
    text = "".join(
        w + rng.choice([" ", " ", " ", "  ", ". ", "\n"]) for w in words(rng, 3000)
    ).encode()

    def suffixes():
        found = Counter()
        w = collocations.Words(list(collocations.tokens(text)))
        listed = [None, *w.words.to_pylist()[1:]]
        for a, b, c in zip(*w.suffixes(), strict=True):
            found[listed[a], listed[b], listed[c]] += 1
        return found

    whole = suffixes()
    monkeypatch.setattr(collocations, "TEXT_STEP", step)
    assert suffixes() == whole
    assert sum(whole.values()) == 3000
