"""Word shingles as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from panelloom.llm.common import mixed

# A word cache is emptied at this size; it saves hashing a word again, nothing else.
CACHE_WORDS = 500_000
STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct hashes of the shingles of ``size`` words of a text.

    A-Z are lower-cased; words are runs of anything but ASCII white space.  A text with
    fewer words than ``size`` has its whole sequence as the one shingle; a text without
    words has none.
    """

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            codes = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            codes = [known[w] for w in words]
        h = np.array(codes, dtype=np.uint64)
        span = min(self.size, len(h))
        n = len(h) - span + 1
        out = h[:n].copy()
        for i in range(1, span):
            out = mixed(out * STEP + h[i : i + n])
        # A short text must not equal a shingle of another length.
        out = mixed(out + np.uint64(span))
        return np.unique(out)
