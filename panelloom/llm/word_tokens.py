"""Token ids of whole texts by a tokenizer that drops white space between words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from panelloom.llm.bpe_counts import byte_letters

# Distinct words kept; emptied at this size.  It saves encoding a word again.
CACHE_WORDS = 500_000
# Words the library encodes in one call.
ENCODE_WORDS = 4_000
# Bytes of texts looked at in one step; longer texts are cut at white space.
GROUP_BYTES = 1 << 21
# Between a letter and the punctuation that ends a chunk the pre-tokeniser always cuts.
TAIL = re.compile(rb"(?<=[a-z])[!-/:-@\[-`{-~]+(?=\s|$)")
MARK = b"<|"
# Lower-case letters that the normaliser leaves alone and the pre-tokeniser keeps together.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
LETTERS = byte_letters()

# What a byte is: white space, part of another character, ASCII letter or digit, punctuation.
SPACE, OTHER, NAMING, POINT = range(4)
_KIND = np.array(
    [
        SPACE if b in b" \t\n\x0b\x0c\r" else NAMING if chr(b).isalnum() and b < 128
        else POINT if 33 <= b <= 126 else OTHER
        for b in range(256)
    ],
    np.uint8,
)

_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; its cache serves one task after another."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class WordTokenizer:
    """Encodes texts word by word.

    The tokenizer's pre-tokens never reach over white space, nor from an ASCII letter or digit
    to punctuation after it, and its normaliser, which makes letters small, looks at no
    neighbours over either.  So the ids of a text are those of the words between, one after
    another.  Words of many texts are found at once, in one array of bytes; each distinct word
    is encoded by the library once; texts are assembled with numpy.  Texts that may hold a
    special string are cut at white space only where it may be.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        # Where the ids of a word lie in flat, and how many they are.
        self.word_at = np.zeros((1024, 2), np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.number)
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.word_at = _room(self.word_at, n + len(words))
        self.word_at[n : n + len(words), 0] = self.used + np.cumsum(lengths) - lengths
        self.word_at[n : n + len(words), 1] = lengths
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(ids)

    def _learn(self, words: list[bytes]) -> None:
        # Words of plain letters are one pre-token as they are, and go to the model directly.
        plain, other, found = [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            if PLAIN(text):
                plain.append(w)
                letters = text if len(text) == len(w) else w.decode("latin-1").translate(LETTERS)
                found.append([t.id for t in self.model.tokenize(letters)])
            else:
                other.append(w)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._keep(plain, np.array(list(chain.from_iterable(found)), np.uint32), lengths)
        for i in range(0, len(other), ENCODE_WORDS):
            some = other[i : i + ENCODE_WORDS]
            texts = [w.decode("utf-8", "replace") for w in some]
            encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            begins = np.cumsum(sizes + 1) - sizes - 1
            at = np.array(encoding.offsets, np.int64).reshape(-1, 2)[:, 0]
            lengths = np.bincount(
                np.searchsorted(begins, at, side="right") - 1, minlength=len(texts)
            )
            self._keep(some, np.array(encoding.ids, np.uint32), lengths)

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null: empty) as unsigned 32-bit integers."""
        group: list[bytes] = []
        held = 0
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            if len(data) > GROUP_BYTES or MARK in data:
                yield from self._encode(group)
                yield self._alone(data)
                group, held = [], 0
                continue
            group.append(data)
            held += len(data)
            if held > GROUP_BYTES:
                yield from self._encode(group)
                group, held = [], 0
        yield from self._encode(group)

    def _alone(self, data: bytes) -> np.ndarray:
        """Ids of a text that is very long or may hold a special string."""
        parts, at = [], 0
        while at < len(data):
            end = at + GROUP_BYTES
            while end < len(data) and _KIND[data[end]] != SPACE:
                end += 1
            part = data[at:end]
            if MARK in part:
                words = split_words(part)
                parts.append(self._assembled(self._numbers(words))[0])
            else:
                parts += self._encode([part])
            at = end
        return np.concatenate(parts)

    def _encode(self, group: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join(group).lower(), np.uint8)
        kind = _KIND[data]
        before = np.append(np.uint8(SPACE), kind[:-1])
        inside = kind != SPACE
        begins = inside & ((before == SPACE) | ((kind == POINT) & (before == NAMING)))
        at = np.flatnonzero(begins)
        # Where each text's words begin.
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        first = np.searchsorted(at, np.cumsum(sizes + 1) - sizes - 1)
        packed = data[inside]
        offsets = np.append(np.flatnonzero(begins[inside]), len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
        ).dictionary_encode()
        numbers = self._numbers(words.dictionary.to_pylist())
        ids, ends = self._assembled(numbers[words.indices.to_numpy()])
        starts = np.append(0, ends)[np.append(first, len(at))]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield ids[a:b]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, learned where it is new."""
        if len(self.number) > CACHE_WORDS:
            self._reset()
        numbers = list(map(self.number.get, words))
        if None in numbers:
            new = {w: None for w, number in zip(words, numbers, strict=True) if number is None}
            self._learn(list(new))
            numbers = list(map(self.number.get, words))
        return np.array(numbers, np.int64)

    def _assembled(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and where those of each end."""
        runs = self.word_at[numbers]
        ends = np.cumsum(runs[:, 1])
        total = int(ends[-1]) if len(ends) else 0
        shift = runs[:, 0] - ends + runs[:, 1]
        return self.flat[np.repeat(shift, runs[:, 1]) + np.arange(total)], ends

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))


def split_words(text: bytes) -> list[bytes]:
    """Words and trailing punctuation of a text, in order."""
    if MARK not in text:
        return TAIL.sub(rb" \g<0>", text.lower()).split()
    out = []
    for chunk in text.split():
        out += [chunk] if MARK in chunk else split_words(chunk)
    return out


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, grown to twice its length until ``size`` rows fit."""
    while len(array) < size:
        array = np.concatenate([array, np.zeros_like(array)])
    return array
