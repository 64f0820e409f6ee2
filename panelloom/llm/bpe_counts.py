"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie in one array of symbols with row boundaries.  In each round
every row looks up the ranks of its neighbouring pairs, and every occurrence of the row's
lowest-ranked pair is merged at once; rows without a known pair are finished.  The number
of symbols left in a row is the pre-token's number of tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import id_text, ragged_positions

# Fixed value: how byte-level BPE cuts a text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Distinct pre-tokens whose counts are kept; emptied at this size.
CACHE_TOKENS = 600_000
# Symbols merged in one array at most, unless one pre-token alone has more.
BATCH_SYMBOLS = 1 << 21
NONE = np.int64(1) << 40
# Hash table of the pairs: symbols are below 2^PAIR_BITS, slots many times the merges.
PAIR_BITS, SLOT_BITS = 24, 19
SLOT_MASK = (1 << SLOT_BITS) - 1


def _slot(keys: np.ndarray) -> np.ndarray:
    spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class MergeTable:
    """Ranks and results of a vocabulary's merges, by pair of symbol numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.made = made
        # Open addressing: rank r lies in the first free slot from its key's on.
        keys = (left << PAIR_BITS) | right
        slots = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_rank = np.zeros(1 << SLOT_BITS, np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), _slot(keys).tolist(), strict=True)):
            while slots[at] >= 0:
                at = (at + 1) & SLOT_MASK
            slots[at] = key
            self.slot_rank[at] = rank
        self.slots = slots
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it is no merge."""
        keys = (left << PAIR_BITS) | right
        at = _slot(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & SLOT_MASK
            held = self.slots[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def count_tokens(pieces: list[bytes], table: MergeTable) -> np.ndarray:
    """Tokens of each pre-token (bytes, not empty)."""
    counts = np.zeros(len(pieces), np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = table.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    rows = np.arange(len(pieces))
    owner = np.repeat(rows, lengths)
    ranks = np.full(len(symbols), NONE)
    same = owner[1:] == owner[:-1]
    at = np.flatnonzero(same)
    ranks[at] = table.ranks(symbols[at], symbols[at + 1])
    while len(symbols):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        low = np.minimum.reduceat(ranks, first)
        sizes = np.diff(np.append(first, len(symbols)))
        done = low == NONE
        counts[owner[first[done]]] = sizes[done]
        if done.all():
            break
        low = np.repeat(low, sizes)
        keep = low != NONE
        symbols, owner, ranks, low = symbols[keep], owner[keep], ranks[keep], low[keep]
        hit = ranks == low
        # Of overlapping occurrences (a run of equal symbols) every second one is merged.
        start = hit & ~np.append(False, hit[:-1])
        run = np.cumsum(start)[hit] - 1
        where = np.flatnonzero(hit)
        even = ((where - np.flatnonzero(start)[run]) & 1) == 0
        merged = where[even]
        symbols[merged] = table.made[low[merged]]
        stays = np.ones(len(symbols), bool)
        stays[merged + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[merged] = True
        symbols, owner, ranks, changed = (
            symbols[stays], owner[stays], ranks[stays], changed[stays]
        )
        # Ranks are looked up anew where a symbol or its right neighbour has changed.
        new = np.flatnonzero(changed | np.append(changed[1:], False))
        last = np.append(owner[1:] != owner[:-1], True)
        ranks[new] = NONE
        inner = new[~last[new]]
        ranks[inner] = table.ranks(symbols[inner], symbols[inner + 1])
    return counts


class TokenCounter:
    """Counts tokens of whole texts; special strings in a text are one token each."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        # \s as the library has it, which does not include the separators U+001C-U+001F.
        self.pattern = regex.compile(PRE_TOKEN, regex.V1)
        specials = sorted(self.table.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.known: dict[str, int] = {}

    def _learn(self, tokens: list[str]) -> None:
        batch, size = [], 0
        for token in [*tokens, None]:
            if batch and (token is None or size > BATCH_SYMBOLS):
                found = count_tokens([t.encode("utf-8", "replace") for t in batch], self.table)
                self.known.update(zip(batch, found.tolist(), strict=True))
                batch, size = [], 0
            if token is not None:
                batch.append(token)
                size += len(token)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text (null: none)."""
        if len(self.known) > CACHE_TOKENS:
            self.known.clear()
        out, pieces, unknown = [], [], {}
        for text in texts:
            n, parts = 0, [text or ""]
            if self.special is not None and self.special.search(text or ""):
                parts = self.special.split(text)
                n = len(parts) - 1
            tokens = [t for part in parts for t in self.pattern.findall(part)]
            unknown.update(dict.fromkeys(t for t in tokens if t not in self.known))
            out.append(n)
            pieces.append(tokens)
        self._learn(list(unknown))
        known = self.known
        return [n + sum([known[t] for t in tokens]) for n, tokens in zip(out, pieces, strict=True)]


_counters: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    """The counter of this Python worker; its cache serves one task after another."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens.  Rows are counted each for itself;
    null ids stay null; other columns are not read.  No shuffle.
    """
    slim = docs.select(
        id_text(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = token_counter(vocabulary)
        for batch in batches:
            texts = batch["text"].tolist()
            found: list[int] = []
            # Few texts at a time: their pre-tokens are Python objects.
            for i in range(0, len(texts), 256):
                found += counter.counts(texts[i : i + 256])
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": batch["n_bytes"],
                    "n_tokens": found,
                }
            )

    return slim.mapInPandas(count, "doc_id string, n_bytes long, n_tokens long").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
