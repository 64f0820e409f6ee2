"""Removal of repeated passages with a range-partitioned suffix array.

Every string of ``SPAN`` bytes holds an anchor: of the ``GRAM``-byte grams inside it, the
leftmost with the least hash.  Equal strings have their anchor at the same place, so it is
enough to sort the suffixes that begin at anchors, about one in seventeen.

1. Anchors are dealt by the hash of their gram; only those whose gram occurs in two
   different texts go on (copies of a whole text are settled by its digest alone).
2. Their suffixes, with the bytes to the left that belong to the anchor's strings, are
   range-partitioned by sampled splitters over the leading bytes.  A splitter is as long as
   a gram, and equal grams fall on one side of it, so equal strings never lie across a
   boundary between buckets.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes a key, and takes the
   common prefix with the neighbour.  Two strings of one anchor place are equal when their
   right parts are within one run of common prefixes and their left parts, sorted from the
   anchor leftwards, are too.  The smallest doc_id of each run keeps its string.

Rows that repeat inside a chunk of documents are settled before any shuffle, so a passage
that many documents share is sent once a chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import mixed, ragged_positions, stored

SPAN = 50
GRAM = 16
REACH = SPAN - GRAM + 1
# Bytes hashed in one array, and bytes of text gathered before rows are sent.
SLICE_BYTES = 1 << 22
CHUNK_BYTES = 1 << 25
PLACE_BITS = np.uint64(26)
PLACE_MASK = np.uint64((1 << 26) - 1)
# Bytes of text for each bucket.
BUCKET_BYTES = 1 << 24
# Documents whose anchors give the splitters, and anchors taken of each.
SAMPLE_DOCS, SAMPLE_ANCHORS = 1000, 64
# Odd multipliers of the gram hash.
MULTIPLIERS = [
    np.uint64(m)
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
]
KEY = ["doc_id", "digest"]
SENT = "bucket int, kind int, head binary, body binary, tail binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    h, width = data.astype(np.uint64), 1
    for m in MULTIPLIERS:
        h = h[:-width] * m + h[width:]
        width *= 2
    return mixed(h)


def _short(gram: np.ndarray) -> np.ndarray:
    """Half of a gram's hash, other bits than those that choose its bucket.  A bucket holds a
    bounded number of grams, so few of them are taken for equal at any size; such anchors go
    on with their suffixes, whose bytes are compared."""
    return (mixed(gram ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of each text: text number, hash of the gram, place of the anchor, first and
    last start of the strings it belongs to.  In text order; long texts in slices."""
    pieces, held = [], 0
    parts: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        if pieces:
            parts.append(_anchors(pieces))
            pieces.clear()

    for number, text in enumerate(texts):
        for begin in range(0, max(len(text) - SPAN + 1, 0), SLICE_BYTES):
            piece = text[begin : begin + SLICE_BYTES + SPAN - 1]
            if held + len(piece) > SLICE_BYTES:
                flush()
                held = 0
            pieces.append((number, begin, piece))
            held += len(piece)
    flush()
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def _anchors(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data)
    # The least (hash, place) of REACH grams, by doubling.
    least = (hashes & ~PLACE_MASK) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    # Strings that lie within one piece.
    counts = sizes - SPAN + 1
    starts = np.repeat(begins, counts) + ragged_positions(counts)
    places = (least[starts] & PLACE_MASK).astype(np.int64)
    new = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    first, place = starts[new], places[new]
    last = starts[np.append(new[1:], len(starts)) - 1]
    piece = np.searchsorted(begins, first, side="right") - 1
    shift = np.array([b for _, b, _ in pieces])[piece] - begins[piece]
    number = np.array([n for n, _, _ in pieces])[piece]
    return number, hashes[place], place + shift, first + shift, last + shift


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` by their columns: rows are parted by the first key,
    and only rows that are still equal are parted by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.append(False, np.diff(words[order, 0].view(np.int64)) != 0))
    for column in range(1, words.shape[1]):
        tied = np.append(group[1:] == group[:-1], False)
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = words[order[at], column]
        inner = np.lexsort((key, group[at]))
        order[at] = order[at][inner]
        key = words[order[at], column]
        split = np.zeros(len(order), bool)
        split[at[1:]] = (key[1:] != key[:-1]) & (at[1:] == at[:-1] + 1)
        border = np.append(True, group[1:] != group[:-1])
        group = np.cumsum(border | split) - 1
    return order


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Bytes each row of a sorted matrix has in common with the row before; first: 0."""
    differ = rows[1:] != rows[:-1]
    out = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.append(0, out)


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int, width: int):
    """Bytes from ``starts`` on, forwards or backwards, as rows padded with zeros."""
    out = np.zeros((len(starts), width), np.uint8)
    row = np.repeat(np.arange(len(starts)), sizes)
    column = ragged_positions(sizes)
    out[row, column] = data[starts[row] + step * column]
    return out


def repeated_strings(
    data: np.ndarray, begins: np.ndarray, left: np.ndarray, strings: np.ndarray, docs: np.ndarray
) -> np.ndarray:
    """Which strings of each row also occur in a row of a smaller document.

    Row r holds the bytes of its ``strings[r]`` strings from ``begins[r]`` on, the anchor
    standing ``left[r]`` bytes after the first.  Result: rows x REACH, by string.
    """
    n = len(begins)
    at = begins + left
    right = _matrix(data, at, strings - 1 + SPAN - left, 1, 56)
    behind = _matrix(data, at - 1, left, -1, 40)
    ranks = []
    for matrix in (right, behind):
        order = multikey_order(matrix.view(">u8").astype(np.uint64))
        ranks.append((order, common_prefix(matrix[order])))
    out = np.zeros((n, REACH), bool)
    for offset in range(REACH):
        # The string that begins ``offset`` bytes before the anchor.
        string = left - offset
        rows = np.flatnonzero((string >= 0) & (string < strings))
        if len(rows) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, prefix), size in zip(ranks, (SPAN - offset, offset), strict=True):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(prefix < size)
            key = key * (n + 1) + run
        key = key[rows]
        by = np.lexsort((docs[rows], key))
        rows, key = rows[by], key[by]
        border = np.append(True, key[1:] != key[:-1])
        least = docs[rows[border]][np.cumsum(border) - 1]
        later = docs[rows] > least
        out[rows[later], string[rows[later]]] = True
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(new[1:], True)
    return starts[new], ends[last]


def _row(bucket: int, kind: int, head: np.ndarray, body: np.ndarray, tail: np.ndarray):
    return bucket, kind, head.tobytes(), body.tobytes(), tail.tobytes()


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "head", "body", "tail"])


def _dealt(buckets: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Columns cut by bucket: (bucket, column, ..)."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(buckets[order]) != 0))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield (int(buckets[order[a]]), *(c[order[a:b]] for c in columns))


def _blocks(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each row of (doc_id, digest)."""
    return (mixed(keys[:, 0].view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _chunks(batches: Iterator[pd.DataFrame], more: bool) -> Iterator[tuple]:
    """Documents of a task in chunks, in doc_id order: keys, texts, and what else there is."""
    rows, held = [], 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            text = r.text.encode("utf-8", "replace")
            rows.append((r.doc_id, r.digest, text, r.found if more else None))
            held += len(text)
            if held >= CHUNK_BYTES:
                yield _chunk(rows)
                rows, held = [], 0
    if rows:
        yield _chunk(rows)


def _chunk(rows: list) -> tuple:
    rows.sort(key=lambda r: (r[0], r[1]))
    keys = np.array([r[:2] for r in rows], np.int64).reshape(-1, 2)
    return keys, [r[2] for r in rows], [r[3] for r in rows]


def _shared_anchors(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest, found: numbers of the anchors (in text order, unsigned 32-bit) whose
    gram also occurs in another text."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, texts, _ in _chunks(batches, more=False):
            # Copies inside the chunk: the first, with the smallest id, stands for them.
            _, first = np.unique(keys[:, 1], return_index=True)
            first.sort()
            keys, texts = keys[first], [texts[i] for i in first]
            doc, gram, _, _, _ = anchors(texts)
            if not len(doc):
                continue
            begins = np.searchsorted(doc, np.arange(len(texts)))
            number = (np.arange(len(doc)) - begins[doc]).astype(np.uint32)
            order = np.argsort(gram, kind="stable")
            border = np.append(True, np.diff(gram[order]) != 0)
            group = np.cumsum(border) - 1
            at = np.flatnonzero(border)
            low = np.minimum.reduceat(doc[order], at)
            high = np.maximum.reduceat(doc[order], at)
            many = np.zeros(len(doc), bool)
            many[order] = (low != high)[group]
            rows = []
            # Shared within the chunk: settled here.  Two of its texts stand for the gram.
            for bucket, d, m in _dealt(_blocks(keys[doc[many]], n), doc[many], number[many]):
                rows.append(_row(bucket, 1, keys[d], m, np.zeros(0)))
            pair = low != high
            told = gram[order[at[pair]]]
            short = _short(gram)
            ends = np.column_stack([low[pair], high[pair]])
            for bucket, g, e in _dealt(
                ((told >> np.uint64(8)) % np.uint64(n)).astype(np.int64), _short(told), ends
            ):
                rows.append(_row(bucket, 2, g, keys[e.ravel(), 1], np.zeros(0)))
            alone = ~many
            buckets = ((gram[alone] >> np.uint64(8)) % np.uint64(n)).astype(np.int64)
            for bucket, g, d, m in _dealt(buckets, short[alone], doc[alone], number[alone]):
                used, counts = np.unique(d, return_counts=True)
                tail = np.column_stack([keys[used], counts])
                rows.append(_row(bucket, 0, g, m, tail))
            yield _frame(rows)

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[pdf["kind"] == 1].itertuples(index=False)]
        grams, texts, owners, numbers = [], [], [], []
        for r in pdf[pdf["kind"] == 0].itertuples(index=False):
            tail = np.frombuffer(r.tail, np.int64).reshape(-1, 3)
            owner = np.repeat(tail[:, :2], tail[:, 2], axis=0)
            grams.append(np.frombuffer(r.head, np.uint32))
            owners.append(owner)
            numbers.append(np.frombuffer(r.body, np.uint32))
            texts.append(owner[:, 1])
        asked = sum(map(len, grams))
        for r in pdf[pdf["kind"] == 2].itertuples(index=False):
            grams.append(np.repeat(np.frombuffer(r.head, np.uint32), 2))
            texts.append(np.frombuffer(r.body, np.int64))
        if asked:
            gram, text = np.concatenate(grams), np.concatenate(texts)
            owner, number = np.concatenate(owners), np.concatenate(numbers)
            order = np.argsort(gram, kind="stable")
            border = np.append(True, np.diff(gram[order]) != 0)
            at = np.flatnonzero(border)
            differ = np.minimum.reduceat(text[order], at) != np.maximum.reduceat(text[order], at)
            many = np.zeros(len(gram), bool)
            many[order] = differ[np.cumsum(border) - 1]
            many = many[:asked]
            owner, number = owner[many], number[many]
            for bucket, o, m in _dealt(_blocks(owner, n), owner, number):
                rows.append(_row(bucket, 1, o, m, np.zeros(0)))
        return _frame(rows)

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        owner = np.concatenate([np.frombuffer(h, np.int64) for h in pdf["head"]]).reshape(-1, 2)
        number = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["body"]])
        order = np.lexsort((number, owner[:, 1], owner[:, 0]))
        owner, number = owner[order], number[order]
        cuts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]).any(axis=1)))
        return pd.DataFrame(
            {
                "doc_id": owner[cuts, 0],
                "digest": owner[cuts, 1],
                "found": [p.tobytes() for p in np.split(number, cuts[1:])],
            }
        )

    return (
        docs.mapInPandas(send, SENT)
        .groupBy("bucket")
        .applyInPandas(settle, SENT)
        .groupBy("bucket")
        .applyInPandas(gather, "doc_id long, digest long, found binary")
    )


def _splitters(docs: DataFrame, rows: int, buckets: int) -> np.ndarray:
    """Leading grams that cut the suffixes into even ranges, from a bounded sample."""
    every = max(1, rows // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("digest"), F.lit(every)) == 0)

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                data = text.encode("utf-8", "replace")
                _, gram, place, _, _ = anchors([data])
                pick = np.argsort(gram, kind="stable")[:SAMPLE_ANCHORS]
                yield pd.DataFrame({"lead": [data[p : p + GRAM] for p in place[pick]]})

    found = some.mapInPandas(lead, "lead binary").limit(4 * SAMPLE_DOCS * SAMPLE_ANCHORS)
    leads = np.sort(np.array([bytes(r[0]) for r in found.toLocalIterator()], f"S{GRAM}"))
    if not len(leads):
        return leads
    cuts = np.arange(1, buckets) * len(leads) // buckets
    return np.unique(leads[cuts])


def _repeats(docs: DataFrame, shared: DataFrame, splitters: np.ndarray, n: int) -> DataFrame:
    """doc_id, digest, spans: bytes to remove (pairs of signed 64-bit), maximal spans."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for keys, texts, found in _chunks(batches, more=True):
            seen: dict[tuple[bytes, int], int] = {}
            strings: list[tuple[bytes, int]] = []
            owner, begin, settled = [], [], []
            of: list[int] = []
            for number, (text, raw) in enumerate(zip(texts, found, strict=True)):
                _, _, place, first, last = anchors([text])
                pick = np.frombuffer(raw, np.uint32)
                place, first, last = place[pick], first[pick], last[pick]
                for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                    string = (text[a : b + SPAN], p - a)
                    known = seen.setdefault(string, len(strings))
                    if known == len(strings):
                        strings.append(string)
                        owner.append(number)
                    elif keys[owner[known], 0] < keys[number, 0]:
                        # A smaller document of this chunk has all these strings.
                        settled.append((number, a, b + SPAN))
                        continue
                    of.append(known)
                    begin.append((number, a))
            rows = []
            if settled:
                spans = np.array(settled, np.int64)
                k = keys[spans[:, 0]]
                for bucket, d, s in _dealt(_blocks(k, n), k, spans[:, 1:]):
                    rows.append(_row(bucket, 1, d, s, np.zeros(0)))
            if strings:
                lead = np.array([s[left : left + GRAM] for s, left in strings], f"S{GRAM}")
                bucket_of = np.searchsorted(splitters, lead, side="right")
                at = np.array(begin, np.int64)
                of_ = np.array(of)
                order = np.argsort(of_, kind="stable")
                at, of_ = at[order], of_[order]
                starts = np.searchsorted(of_, np.arange(len(strings)))
                counts = np.bincount(of_, minlength=len(strings))
                for bucket, some in _dealt(bucket_of, np.arange(len(strings))):
                    text = b"".join(strings[i][0] for i in some)
                    size = np.array([(len(strings[i][0]), strings[i][1]) for i in some], np.uint32)
                    places = at[np.repeat(starts[some], counts[some]) + ragged_positions(counts[some])]
                    head = np.column_stack([size, counts[some].astype(np.uint32)]).astype(np.uint32)
                    tail = np.column_stack([keys[places[:, 0]], places[:, 1]])
                    rows.append((bucket, 0, head.tobytes(), shrink(text), tail.tobytes()))
            if rows:
                yield _frame(rows)

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[pdf["kind"] == 1].itertuples(index=False)]
        sent = pdf[pdf["kind"] == 0]
        if len(sent):
            grow = zstandard.ZstdDecompressor().decompress
            data = np.frombuffer(b"".join(map(grow, sent["body"])), np.uint8)
            head = np.concatenate([np.frombuffer(h, np.uint32) for h in sent["head"]])
            tail = np.concatenate([np.frombuffer(t, np.int64) for t in sent["tail"]])
            size, left, count = head.reshape(-1, 3).astype(np.int64).T
            place = tail.reshape(-1, 3)
            first = np.cumsum(count) - count
            removed = repeated_strings(
                data, np.cumsum(size) - size, left, size - SPAN + 1, place[first, 0]
            )
            # Runs of removed strings, of each place of the row.
            edge = np.diff(np.pad(removed.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            times = count[row]
            at = np.repeat(first[row], times) + ragged_positions(times)
            spans = np.column_stack(
                [
                    place[at, 2] + np.repeat(begin, times),
                    place[at, 2] + np.repeat(end, times) + SPAN - 1,
                ]
            )
            for bucket, d, s in _dealt(_blocks(place[at, :2], n), place[at, :2], spans):
                rows.append(_row(bucket, 1, d, s, np.zeros(0)))
        return _frame(rows)

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        owner = np.concatenate([np.frombuffer(h, np.int64) for h in pdf["head"]]).reshape(-1, 2)
        spans = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["body"]]).reshape(-1, 2)
        order = np.lexsort((owner[:, 1], owner[:, 0]))
        owner, spans = owner[order], spans[order]
        cuts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]).any(axis=1)))
        parts = [
            np.column_stack(merged(s[:, 0], s[:, 1])).astype(np.int64).tobytes()
            for s in np.split(spans, cuts[1:])
        ]
        return pd.DataFrame(
            {"doc_id": owner[cuts, 0], "digest": owner[cuts, 1], "spans": parts}
        )

    return (
        docs.join(shared, KEY)
        .mapInPandas(send, SENT)
        .groupBy("bucket")
        .applyInPandas(settle, SENT)
        .groupBy("bucket")
        .applyInPandas(gather, "doc_id long, digest long, spans binary")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with an id and a text, as doc_id, digest, text."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text"
    )


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to remove from each document, in two frames.

    The first, stored: doc_id, digest, n_bytes, sha256, copy (a smaller doc_id has the same
    text) for every row with an id and a text.  The second: doc_id, digest, spans for
    documents that are no copies and lose something.
    """
    texts = keyed(docs)
    made = stored(
        texts.select(
            *KEY,
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.sha2("text", 256).alias("sha256"),
        ),
        "digests",
    )
    least = made.groupBy("sha256").agg(F.min("doc_id").alias("least"))
    digests = stored(
        made.join(least, "sha256").withColumn("copy", F.col("doc_id") > F.col("least")).drop("least"),
        "copies",
    )
    size = digests.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(math.ceil((size[0] or 0) / BUCKET_BYTES), parts)
    firsts = digests.where(~F.col("copy")).select(*KEY).distinct()
    shared = _shared_anchors(texts, n).join(firsts, KEY, "left_semi")
    splitters = _splitters(texts, size[1], n)
    return digests, _repeats(texts, shared, splitters, n)


def cut(data: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left of ``data``, bytes removed, spans removed."""
    if not spans:
        return data, 0, 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    kept, at = [], 0
    for a, b in pairs.tolist():
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs)


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when a string of ``SPAN`` bytes that covers it also starts in a
    document with a smaller doc_id; strings are judged on the input.  Null and empty texts,
    and texts shorter than ``SPAN`` bytes, lose nothing.  Rows without an id neither lose
    bytes nor take them from others.  Rows that share an id do not remove from each other;
    equal ones give equal rows.  Other columns are not read.
    """
    digests, spans = repeated_spans(docs)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                cut(t.encode("utf-8", "replace"), s)
                for t, s in zip(batch["text"], batch["spans"], strict=True)
            ]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "digest": batch["digest"],
                    "n_removed": [x[1] for x in out],
                    "n_spans": [x[2] for x in out],
                    "kept": [hashlib.sha256(x[0]).hexdigest() for x in out],
                }
            )

    lost = (
        keyed(docs)
        .join(spans, KEY)
        .mapInPandas(
            report, "doc_id long, digest long, n_removed long, n_spans long, kept string"
        )
        # Rows that repeat are reported once each, below.
        .dropDuplicates(KEY)
    )
    whole = F.col("copy") & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("long")
    told = digests.join(lost, KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", zero)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.coalesce("kept", "sha256"))
        .alias("kept_sha256"),
    )
    text = F.coalesce("text", F.lit(""))
    rest = docs.where(F.col("doc_id").isNull() | F.col("text").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
    return told.union(rest)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; a character that loses some
    of its bytes goes as a whole.  ``n_chars`` follows the text where there is such a
    column; all other columns and rows stay."""
    digests, spans = repeated_spans(docs)
    gone = digests.where(F.col("copy") & (F.col("n_bytes") >= SPAN)).select(
        *KEY, F.lit(True).alias("_whole"), F.lit(None).cast("binary").alias("_spans")
    )
    part = spans.select(*KEY, F.lit(False).alias("_whole"), F.col("spans").alias("_spans"))
    change = gone.dropDuplicates(KEY).union(part).select(
        F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "_whole", "_spans"
    )

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [
                cut(t.encode("utf-8", "replace"), s)[0].decode("utf-8", "ignore")
                for t, s in zip(text, spans, strict=True)
            ],
            dtype=object,
        )

    # The row goes along as a whole, so that no name of it meets those made here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_digest"),
    )
    joined = rows.join(change, ["_doc", "_digest"], "left")
    old = F.col("row").getField("text")
    text = (
        F.when(F.col("_whole"), F.lit(""))
        .when(F.col("_spans").isNotNull(), kept(F.coalesce(old, F.lit("")), F.col("_spans")))
        .otherwise(old)
    )
    joined = joined.select("row", text.alias("text"))
    return joined.select(*[_replaced(docs, c, F.col("text"), F.length("text")) for c in docs.columns])


def _replaced(docs: DataFrame, column: str, text: Column, n_chars: Column) -> Column:
    """``column`` of the row, or what takes its place."""
    if column == "text":
        return text.alias(column)
    if column == "n_chars":
        return n_chars.cast(docs.schema[column].dataType).alias(column)
    return F.col("row").getField(column).alias(column)
