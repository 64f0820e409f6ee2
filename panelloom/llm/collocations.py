"""Phrases whose words keep company, from depth-truncated suffix trees built in groups.

The suffixes of a language (every word with the words after it in its piece, as deep as the
longest phrase) are parted vertically: suffixes that begin alike go to one group.  Words with
more suffixes than a group's memory budget are extended to prefixes of two words, and prefixes
of two words beyond it to three, so that a group's expected number of suffixes stays within
the budget however common a word is.  Each group then builds the subtree of its prefixes alone:
equal suffixes are leaves, and totals of leaves give the counts of the nodes above them.

Suffixes travel in blocks, one per task and group: the words of the block once, and for every
different suffix its word numbers and its count.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import mixed, stored

DEPTH = 3
# Suffixes of a group, as expected; a subtree takes about 100 bytes for each at most.
GROUP_SUFFIXES = 1 << 21
# A prefix is extended at this share of all suffixes at the latest, which bounds the prefixes
# that every task must know: there are no more than this many words and twice as many pairs.
MOST_EXTENDED = 20_000
# Words a task looks at in one step, and bytes of a text.
TASK_WORDS = 1 << 20
TEXT_STEP = 1 << 22
STEP = np.uint64(0x9E3779B97F4A7C15)

# A byte that UTF-8 never has stands for the end of a piece.
END = b"\xff"
_TABLE = bytes(
    255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)


def tokens(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text and ends of its pieces, in lists of bounded size; with each how many
    words at its end are only there to complete suffixes that begin before them."""
    plain = text.translate(_TABLE)
    begin = 0
    while len(plain) - begin > TEXT_STEP:
        cut = begin + TEXT_STEP
        end, space = plain.find(END, cut, cut + TEXT_STEP), plain.find(b" ", cut)
        if end >= 0 and (space < 0 or end < space):
            yield plain[begin:end].replace(END, b" \xff ").split(b" "), 0
            begin = end
            continue
        if space < 0:
            break
        # Cut within a piece: the words that complete its last suffixes come along.
        ahead = space
        for _ in range(DEPTH - 1):
            ahead = _after_word(plain, ahead)
        more = plain[space:ahead].replace(END, b" \xff ").split(b" ")
        some = plain[begin:space].replace(END, b" \xff ").split(b" ")
        yield some + more, sum(map(bool, more))
        begin = space
    yield plain[begin:].replace(END, b" \xff ").split(b" "), 0


def _after_word(plain: bytes, at: int) -> int:
    """Place after the next word or end of a piece from ``at`` on."""
    while at < len(plain) and plain[at] == 32:
        at += 1
    if plain[at : at + 1] == END:
        return at + 1
    space, end = plain.find(b" ", at), plain.find(END, at)
    return min(p if p >= 0 else len(plain) for p in (space, end))


class Words:
    """Words of one language in one step: numbers from 1 in order of appearance, 0 for the end
    of a piece, and which words begin a suffix."""

    def __init__(self, parts: list[tuple[list[bytes], int]]):
        flat: list[bytes] = [END]
        spare: list[tuple[int, int]] = []
        for some, only_ahead in parts:
            flat.extend(filter(None, some))
            if only_ahead:
                spare.append((len(flat) - only_ahead, len(flat)))
            flat.append(END)
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary
        self.begins = self.codes > 0
        for a, b in spare:
            self.begins[a:b] = False

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first, second and third word of each suffix, 0 where it ends before."""
        padded = np.append(self.codes, [0, 0])
        at = np.flatnonzero(self.begins)
        first, second = padded[at], padded[at + 1]
        return first, second, np.where(second > 0, padded[at + 2], 0)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Languages with their words, some at a time, of rows (lang, text)."""
    held: dict[str, list[tuple[list[bytes], int]]] = {}
    size = 0
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang, text in zip(langs, texts, strict=True):
            for part in tokens(text.as_py()):
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                if size > TASK_WORDS:
                    yield from ((k, Words(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, Words(v)) for k, v in held.items())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words in _steps(batches):
        n = np.bincount(words.codes[words.begins], minlength=len(words.words))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(used), pa.string()),
                "word": words.words.take(pa.array(used)),
                "n": pa.array(n[used], pa.int64()),
            }
        )


def _known(words: Words, wanted: set[bytes]) -> np.ndarray:
    """Which of the words (by number) are in ``wanted``."""
    if not wanted:
        return np.zeros(len(words.words), bool)
    return np.fromiter((w in wanted for w in words.words.to_pylist()), bool, len(words.words))


def _count_pairs(common: dict[str, set[bytes]], share: float):
    """Counts of two-word prefixes that begin with a common word and are at least ``share`` of
    a step's suffixes.  What stays below it everywhere stays below it altogether."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _steps(batches):
            known = _known(words, common.get(lang, set()))
            first, second, _ = words.suffixes()
            some = known[first] & (second > 0)
            width = len(words.words)
            pair, n = np.unique(first[some] * width + second[some], return_counts=True)
            often = n >= share * len(first)
            pair, n = pair[often], n[often]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(pair), pa.string()),
                    "a": words.words.take(pa.array(pair // width)),
                    "b": words.words.take(pa.array(pair % width)),
                    "n": pa.array(n, pa.int64()),
                }
            )

    return count


def _packed(words: list[bytes], columns: list[np.ndarray]) -> bytes:
    text = b" ".join(words)
    body = b"".join(c.astype("<u4").tobytes() for c in columns)
    head = struct.pack("<II", len(text), len(columns[0]))
    return zstandard.ZstdCompressor(level=1).compress(head + text + body)


def _unpacked(block: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words, and rows (first, second, third, count) of a block."""
    data = zstandard.ZstdDecompressor().decompress(block)
    size, rows = struct.unpack_from("<II", data)
    words = data[8 : 8 + size].split(b" ")
    return words, np.frombuffer(data, "<u4", 4 * rows, 8 + size).reshape(4, rows)


def _suffix_blocks(
    groups: int, common: dict[str, set[bytes]], pairs: dict[str, set[tuple[bytes, bytes]]]
):
    """Blocks (prefix_group, lang, block) of the suffixes of a task, dealt by their prefix."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _steps(batches):
            found = _distinct(words)
            if not len(found[0]):
                continue
            first, second, third, n = found
            listed = words.words.to_pylist()
            salt = xxhash.xxh3_64_intdigest(lang.encode("utf-8"))
            h = np.array([xxhash.xxh3_64_intdigest(w, salt) for w in listed], np.uint64)
            two = _known(words, common.get(lang, set()))[first]
            three = np.zeros(len(first), bool)
            if pairs.get(lang):
                number = {w: i for i, w in enumerate(listed)}
                keys = [
                    number[a] * len(listed) + number[b]
                    for a, b in pairs[lang]
                    if a in number and b in number
                ]
                three = two & np.isin(first * len(listed) + second, np.array(keys, np.int64))
            key = mixed(h[first])
            key = np.where(two, mixed(key * STEP + h[second]), key)
            key = np.where(three, mixed(key * STEP + h[third]), key)
            group = (key % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
            blocks = []
            for begin, end in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                some = order[begin:end]
                used, code = np.unique(
                    np.concatenate([first[some], second[some], third[some]]), return_inverse=True
                )
                # Number 0 is no word.
                if used[0] != 0:
                    used, code = np.append(0, used), code + 1
                columns = [*code.reshape(3, -1), n[some]]
                blocks.append(_packed([listed[i] for i in used[1:]], columns))
            yield pa.RecordBatch.from_pydict(
                {
                    "prefix_group": pa.array(group[order[cuts]], pa.int64()),
                    "lang": pa.array([lang] * len(blocks), pa.string()),
                    "block": pa.array(blocks, pa.binary()),
                }
            )

    return make


def _distinct(words: Words) -> tuple[np.ndarray, ...]:
    """Different suffixes of a step in order, with their counts."""
    first, second, third = words.suffixes()
    return _leaves(first, second, third, np.ones(len(first), np.int64))


def _leaves(first, second, third, n) -> tuple[np.ndarray, ...]:
    """Equal suffixes summed, in the order of their words."""
    order = np.lexsort((third, second, first))
    first, second, third, n = first[order], second[order], third[order], n[order]
    new = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (third[1:] != third[:-1])
    at = np.flatnonzero(np.append(len(first) > 0, new))
    total = np.add.reduceat(n, at) if len(at) else n
    return first[at], second[at], third[at], total


def _subtrees(least: int, pairs: dict[str, set[tuple[bytes, bytes]]]):
    """Nodes (lang, a, b, c, n) of depth two (c null) and three of a group's subtree that have
    ``least`` leaves below them.  A node whose leaves several groups share is given whatever
    its part."""

    def build(blocks: pa.Table) -> pa.Table:
        found = []
        by_lang: dict[str, list[bytes]] = {}
        for lang, block in zip(
            blocks["lang"].to_pylist(), blocks["block"].to_pylist(), strict=True
        ):
            by_lang.setdefault(lang, []).append(block)
        for lang, some in by_lang.items():
            parts = [_unpacked(b) for b in some]
            lengths = [len(p[0]) for p in parts]
            coded = pa.array([w for p in parts for w in p[0]], pa.binary()).dictionary_encode()
            listed = coded.dictionary
            of = np.append(0, coded.indices.to_numpy().astype(np.int64) + 1)
            starts = np.cumsum([0, *lengths[:-1]])
            columns = [
                np.concatenate(
                    [of[np.where(p[1][i] > 0, p[1][i] + s, 0)] for p, s in zip(parts, starts)]
                )
                for i in range(3)
            ]
            n = np.concatenate([p[1][3] for p in parts]).astype(np.int64)
            a, b, c, n = _leaves(*columns, n)
            deep = (c > 0) & (n >= least)
            found.append(_rows(lang, listed, a[deep], b[deep], c[deep], n[deep]))
            # A node's leaves lie side by side.
            at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            total, a, b = np.add.reduceat(n, at), a[at], b[at]
            keep = total >= least
            if pairs.get(lang):
                number = {w: i + 1 for i, w in enumerate(listed.to_pylist())}
                width = len(listed) + 1
                keys = [
                    number[x] * width + number[y]
                    for x, y in pairs[lang]
                    if x in number and y in number
                ]
                keep |= np.isin(a * width + b, np.array(keys, np.int64))
            keep &= b > 0
            none = np.zeros(int(keep.sum()), np.int64)
            found.append(_rows(lang, listed, a[keep], b[keep], none, total[keep]))
        return pa.Table.from_batches(found)

    return build


def _rows(lang: str, listed: pa.Array, a, b, c, n) -> pa.RecordBatch:
    def text(codes: np.ndarray) -> pa.Array:
        return listed.take(pa.array(np.maximum(codes - 1, 0), mask=codes == 0))

    return pa.RecordBatch.from_pydict(
        {
            "lang": pa.array([lang] * len(n), pa.string()),
            "a": text(a), "b": text(b), "c": text(c), "n": pa.array(n, pa.int64()),
        }
    )


def _exact(name: str) -> str:
    return f"CAST({name} AS DECIMAL(16,0))"


def _score(left: str, right: str) -> Column:
    return F.expr(
        f"CAST((1000000 * ({_exact('n')} * {_exact('n')})) DIV ({_exact(left)} * {_exact(right)}) AS BIGINT)"
    )


def collocations(
    docs: DataFrame, least: int = 10, overlap_percent: int = 50, top: int = 2000,
    group_suffixes: int | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three
    words.

    A-Z are lower-cased; texts (null: empty) are cut at .,;:!? and line ends into pieces and
    those at blanks and tabs into words; a null lang is ``und``.  ``n`` counts the words of the
    language and ``a`` all occurrences of the phrase within pieces, ``least`` or more.  Of the
    cuts of a phrase in two parts, with counts l and r, the one with the smallest
    score floor(10^6 a^2 / (l r)) counts, ties to the shorter first part.  A phrase of two words
    goes if a phrase of three around it has ``overlap_percent`` % of its count.  Ranks go by
    score and ``a``, falling, then by spelling (UTF-8).  Counts to 10^16 are exact.  Repeated
    rows count each, whatever their ids; an empty table gives no rows; other columns are not
    read.
    """
    budget = group_suffixes or GROUP_SUFFIXES
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("binary").alias("text"),
    ).where(F.col("text").isNotNull())
    words = stored(
        rows.mapInArrow(_count_words, "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n")),
        "words",
    )
    langs = words.groupBy("lang").agg(F.sum("n").alias("all"))
    total = langs.agg(F.sum("all")).first()[0] or 0
    # Vertical parts: prefixes beyond the budget are extended by a word.
    limit = max(budget, total // MOST_EXTENDED)
    common: dict[str, set[bytes]] = {}
    for r in words.where(F.col("n") > limit).select("lang", "word").collect():
        common.setdefault(r.lang, set()).add(bytes(r.word))
    pairs: dict[str, set[tuple[bytes, bytes]]] = {}
    if common:
        often = (
            rows.mapInArrow(
                _count_pairs(common, limit / 2 / total), "lang string, a binary, b binary, n long"
            )
            .groupBy("lang", "a", "b")
            .agg(F.sum("n").alias("n"))
        )
        for r in often.where(F.col("n") * 2 > limit).collect():
            pairs.setdefault(r.lang, set()).add((bytes(r.a), bytes(r.b)))
    groups = max(1, -(-2 * total // budget))
    blocks = rows.mapInArrow(
        _suffix_blocks(groups, common, pairs), "prefix_group long, lang string, block binary"
    )
    nodes = stored(
        blocks.groupBy("prefix_group").applyInArrow(
            _subtrees(least, pairs), "lang string, a binary, b binary, c binary, n long"
        ),
        "nodes",
    )
    return _best(nodes, words.where(F.col("n") >= least), langs, overlap_percent, top, least)


def _best(
    nodes: DataFrame, words: DataFrame, langs: DataFrame, percent: int, top: int, least: int
) -> DataFrame:
    def part(df: DataFrame, *names: str) -> DataFrame:
        return df.select("lang", *[F.col(c).alias(n) for c, n in zip(df.columns[1:], names)])

    # Only a node whose leaves several groups share has several rows.
    two = stored(
        nodes.where(F.col("c").isNull())
        .groupBy("lang", "a", "b")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .join(part(words, "a", "n_a"), ["lang", "a"])
        .join(part(words, "b", "n_b"), ["lang", "b"]),
        "pairs",
    ).select("lang", "a", "b", "n", "n_a", "n_b")
    three = stored(
        nodes.where(F.col("c").isNotNull())
        .join(two.select("lang", "a", "b", F.col("n").alias("n_ab"), "n_a"), ["lang", "a", "b"])
        .join(
            two.select(
                "lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_bc"),
                F.col("n_b").alias("n_c"),
            ),
            ["lang", "b", "c"],
        ),
        "triples",
    )
    around = (
        three.select("lang", "a", "b", "n")
        .union(three.select("lang", "b", "c", "n"))
        .groupBy("lang", "a", "b")
        .agg(F.max("n").alias("around"))
    )
    pair = (
        two.join(around, ["lang", "a", "b"], "left")
        .where(F.coalesce(100 * F.col("around") < percent * F.col("n"), F.lit(True)))
        .select(
            "lang", F.concat("a", F.lit(b" "), "b").alias("phrase"), F.col("n").alias("a"),
            F.col("n_a").alias("l"), F.col("n_b").alias("r"), _score("n_a", "n_b").alias("score"),
        )
    )
    first, second = _score("n_a", "n_bc"), _score("n_ab", "n_c")
    cut = F.col("_second") < F.col("_first")
    triple = three.withColumns({"_first": first, "_second": second}).select(
        "lang", F.concat("a", F.lit(b" "), "b", F.lit(b" "), "c").alias("phrase"),
        F.col("n").alias("a"),
        F.when(cut, F.col("n_ab")).otherwise(F.col("n_a")).alias("l"),
        F.when(cut, F.col("n_c")).otherwise(F.col("n_bc")).alias("r"),
        F.least("_first", "_second").alias("score"),
    )
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (
        pair.union(triple)
        .withColumn("rank", F.row_number().over(by).cast("long"))
        .where(F.col("rank") <= top)
        .join(langs, "lang")
        .select(
            "lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r",
            F.col("all").alias("n"), "score",
        )
    )


def collocations_sql(least: int = 10, overlap_percent: int = 50, top: int = 2000) -> str:
    """The same for DuckDB."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
words AS (SELECT lang, w[i] AS p, count(*) AS f FROM places GROUP BY ALL),
twos AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS f FROM places WHERE i + 1 <= len(w)
  GROUP BY ALL HAVING f >= {least}
),
threes AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f FROM places
  WHERE i + 2 <= len(w) GROUP BY ALL HAVING f >= {least}
),
around AS (
  SELECT lang, a, b, max(f) AS f
  FROM (SELECT lang, a, b, f FROM threes UNION ALL SELECT lang, b, c, f FROM threes)
  GROUP BY lang, a, b
),
cuts AS (
  SELECT t.lang, t.a || ' ' || t.b AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
  FROM twos t JOIN words x ON x.lang = t.lang AND x.p = t.a
  JOIN words y ON y.lang = t.lang AND y.p = t.b
  LEFT JOIN around o ON o.lang = t.lang AND o.a = t.a AND o.b = t.b
  WHERE o.f IS NULL OR 100 * o.f < {overlap_percent} * t.f
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, 1, t.f, x.f, y.f
  FROM threes t JOIN words x ON x.lang = t.lang AND x.p = t.a
  JOIN twos y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, 2, t.f, x.f, y.f
  FROM threes t JOIN twos x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b
  JOIN words y ON y.lang = t.lang AND y.p = t.c
),
scored AS (
  SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
),
chosen AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM chosen
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score
FROM ranked r JOIN (SELECT lang, sum(f) AS n FROM words GROUP BY lang) t ON t.lang = r.lang
WHERE r.rank <= {top}"""
