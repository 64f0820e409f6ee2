"""Operators on texts against brute force, on odd and on small random tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_fixtures import frame, odd_rows, words
from tokenizers import Tokenizer

from panelloom.llm import (
    bpe_counts, genetic_packing, licences, mixing, near_dedup, packed_ids, suffix_dedup,
)

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def encoded(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- token counts -----------------------------------------------------------------------


def test_token_counts_equal_the_library(odd, byte_vocabulary):
    got = rows_of(
        bpe_counts.token_counts(odd, byte_vocabulary), "doc_id", "n_bytes", "n_tokens", "over_limit"
    )
    texts = [t or "" for _, t, _ in odd_rows()]
    want = [
        (i, len(t.encode()), len(ids), len(ids) > 1024)
        for (i, _, _), t, ids in zip(odd_rows(), texts, encoded(byte_vocabulary, texts), strict=True)
    ]
    assert got == sorted(want, key=repr)


def test_merging_runs_of_equal_symbols(byte_vocabulary):
    counter = bpe_counts.TokenCounter(byte_vocabulary)
    texts = ["a" * n for n in range(1, 40)] + ["!" * n for n in range(1, 40)] + ["abab" * 9]
    assert counter.counts(texts) == [len(x) for x in encoded(byte_vocabulary, texts)]


# -- packed ids -------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 11, 16, 17])
def test_packing_of_bits_round_trips(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 5000).astype(np.uint32)
    payload, offsets = packed_ids.pack(ids, width)
    assert len(payload) == -(-5000 * width // 8)
    for a, b in ((0, 5000), (1023, 1025), (4999, 5000), (2048, 2048), (7, 4000)):
        assert packed_ids.unpack(payload, width, 5000, offsets, a, b).tolist() == ids[a:b].tolist()


def test_files_hold_the_library_ids(odd, word_vocabulary):
    got = rows_of(
        packed_ids.packed_documents(odd, word_vocabulary, end_id=2),
        "start", "doc_id", "n_tokens", "ids_crc32",
    )
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    known = {}
    for (i, _, _), ids in zip(rows, encoded(word_vocabulary, [t or "" for _, t, _ in rows]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        known.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got.sort()
    at = 0
    for start, i, n, crc in got:
        assert start == at
        known[i].remove((n, crc))
        at += n
    assert not any(known.values())
    order = [i for _, i, _, _ in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


# -- packing ----------------------------------------------------------------------------


def test_packing_holds_every_piece(odd, word_vocabulary):
    got = genetic_packing.pack_documents(odd, word_vocabulary, size=2048, end_id=0).collect()
    want = []
    for (i, _, _), ids in zip(
        odd_rows(), encoded(word_vocabulary, [t or "" for _, t, _ in odd_rows()]), strict=True
    ):
        ids = np.array([*ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(
        ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr
    ) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(w[3] for w in want) / 2048) + 1


def test_evolution_is_no_worse_than_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(200, 900, 300).tolist()
    people = genetic_packing.first_population(lengths, 2048, rng)
    before = len(people[0].bins)
    after = genetic_packing.evolved(people, 6, rng)[0]
    assert len(after.bins) <= before
    assert sorted(i for b in after.bins for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in after.bins)


# -- mixing -----------------------------------------------------------------------------


def targets_by_hand(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if level * weight[s] > most * sizes[s]}
        if not new:
            break
        capped |= new
    return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}


@pytest.mark.parametrize("kind", ["odd", "random"])
def test_mix_meets_its_targets(spark, odd, kind):
    rng = random.Random(9)
    rows = odd_rows()
    df = odd
    if kind == "random":
        rows = [
            (i, " ".join(words(rng, rng.randint(0, 90))), f"s{rng.randint(0, 6)}") for i in range(300)
        ]
        df = frame(spark, rows)
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall((t or "").encode()))
    want = targets_by_hand(sizes, (5, 2, 1), 3)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= (3 if kind == "odd" else 1)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    out = {}
    for r in mixed.collect():
        out[r.source] = out.get(r.source, 0) + len(WORD.findall(r.text.encode()))
    assert {s: n for s, n in taken.items() if n} == out


# -- near duplicates --------------------------------------------------------------------


def classes_by_hand(rows, size, percent):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        span = min(size, len(w))
        sets.append({tuple(w[i : i + span]) for i in range(len(w) - span + 1)} if w else set())
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if None in (rows[a][0], rows[b][0]) or not sets[a] or not sets[b]:
                    continue
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low = min(label[a], label[b])
                    changed |= label[a] != low or label[b] != low
                    label[a] = label[b] = low
    return sorted(
        (
            (r[0], len(s), c, r[0] is None or r[0] == c)
            for r, s, c in zip(rows, sets, label, strict=True)
        ),
        key=repr,
    )


def near_rows():
    """A group of edited copies with all degrees of similarity, and unrelated texts."""
    rng = random.Random(2)
    base = words(rng, 120)
    rows = []
    for i in range(220):
        text = list(base) if i % 3 else words(rng, 40)
        for _ in range(rng.randint(0, 14) if i % 3 else 0):
            text[rng.randrange(len(text))] = words(rng, 1)[0]
        rows.append((i * 7 % 220, " ".join(text), "a"))
    return rows


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("kind", ["odd", "near"])
def test_near_duplicates_equal_all_pairs(spark, odd, kind, size):
    rows = odd_rows() if kind == "odd" else near_rows()
    df = odd if kind == "odd" else frame(spark, rows)
    got = rows_of(
        near_dedup.near_duplicates(df, words=size), "doc_id", "n_shingles", "component_id", "kept"
    )
    assert got == classes_by_hand(rows, size, 80)
    kept = near_dedup.first_of_each(df, words=size)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert sorted(named) == sorted({i for i, _, _, k in got if k and i is not None})
    assert ids.count(None) == sum(r[0] is None for r in rows)


def test_sketches_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    agree = []
    for n in (5, 30, 400):
        pool = rng.integers(0, 2**63, 3 * n, dtype=np.int64).view(np.uint64)
        a, b = pool[: 2 * n], pool[n:]
        x, y = near_dedup.sketch(a, 240), near_dedup.sketch(b, 240)
        assert not (x == near_dedup.EMPTY).any()
        agree.append((x == y).mean())
    assert np.mean(agree) == pytest.approx(1 / 3, abs=0.12)


# -- repeated passages ------------------------------------------------------------------


def removed_by_hand(rows):
    seen, out = {}, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 49):
            part = data[s : s + 50]
            if i is not None and seen.setdefault(part, i) < i:
                gone[s : s + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def passage_rows():
    """Passages shared in all places, shifted, overlapping, and one in every text."""
    rng = random.Random(8)
    shared = [" ".join(words(rng, 25)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(words(rng, rng.randint(1, 30))), shared[0]]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(60)
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randint(40, 120)])
        rows.append((i * 11 % 120, "é".join(parts), "a"))
    return rows


@pytest.mark.parametrize("kind", ["odd", "passages"])
def test_removed_bytes_equal_brute_force(spark, odd, kind):
    rows = odd_rows() if kind == "odd" else passage_rows()
    df = odd if kind == "odd" else frame(spark, rows)
    got = rows_of(
        suffix_dedup.repeat_report(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
    want = removed_by_hand(rows)
    assert got == want
    cut = suffix_dedup.without_repeats(df)
    assert cut.columns == df.columns
    texts = [(r.doc_id, r.text) for r in cut.collect()]
    assert len(texts) == len(rows)
    left = sum(len((t or "").encode()) for _, t in texts)
    assert 0 <= sum(w[1] - w[2] for w in want) - left <= 6 * len(rows)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    rng = random.Random(1)
    text = " ".join(words(rng, 3000)).encode()
    whole = suffix_dedup.anchors([text])
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1000)
    sliced = suffix_dedup.anchors([text])
    assert set(whole[2].tolist()) == set(sliced[2].tolist())
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(sliced[3], sliced[4], strict=True)])
    assert starts.tolist() == list(range(len(text) - 49))


def test_multikey_order_sorts_rows():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = suffix_dedup.multikey_order(rows)
    assert [tuple(r) for r in rows[order]] == sorted(map(tuple, rows.tolist()))


# -- licences ---------------------------------------------------------------------------


def test_licence_rules(spark, odd):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n"
        "of this software. The above copyright notice and this permission notice shall be\n"
        'included in all copies. THE SOFTWARE IS PROVIDED "AS IS", without warranty.'
    )
    rows = [
        (1, mit, "a"),
        (2, "Intro.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "a"),
        (3, "This work is licensed under the GNU General Public License, version 3.", "a"),
        (4, "// Licensed under the Apache\n// license, version 2.0. Go on.", "a"),
        (5, "The licence of this is not known to anyone.", "a"),
        (6, "No such thing here. Licensed under the GNU General Public Licence, Version 3 or any later version.", "a"),
        (7, None, "a"),
    ]
    got = {r.doc_id: r for r in licences.licence_scan(frame(spark, rows)).collect()}
    assert [got[i].licences for i in range(1, 8)] == [
        ["MIT"], ["MIT", "CC-BY-NC"], ["GPL-3.0"], ["Apache-2.0"], [], ["GPL-3.0-or-later"], [],
    ]
    assert got[1].sentences == ["mit_grant", "mit_notice", "as_is"]
    assert (got[5].n_known, got[5].n_unknown) == (0, 1)
    assert licences.licence_scan(odd).count() == len(odd_rows())


# -- empty tables -----------------------------------------------------------------------


def test_empty_tables_give_empty_results(nothing, byte_vocabulary, word_vocabulary):
    made = [
        bpe_counts.token_counts(nothing, byte_vocabulary),
        packed_ids.packed_documents(nothing, word_vocabulary, end_id=2),
        genetic_packing.pack_documents(nothing, word_vocabulary),
        mixing.mix(nothing),
        mixing.mixed_documents(nothing),
        near_dedup.near_duplicates(nothing),
        near_dedup.first_of_each(nothing),
        suffix_dedup.repeat_report(nothing),
        suffix_dedup.without_repeats(nothing),
        licences.licence_scan(nothing),
    ]
    assert [df.count() for df in made] == [0] * len(made)
