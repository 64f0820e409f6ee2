"""Divergence of the sources of a language: word shares compared, source against source.

Words are counted once per task and summed; what the comparison needs of a source is its
share of every word its language keeps.  Two sources differ on the words both have, on the
words one of them has, and on the rest, where both shares are the same everywhere:

* words both have: sums over pairs of a word's sources, taken inside tasks;
* words one has: sums over the different counts of that source, of which there are few;
* the rest: a product.

The words that set a source apart are found by a dominance skyband.  A word is dominated by
one with at least its count in the source, at most its count in the language, and an earlier
spelling: whatever the totals, that one ranks before it.  So partitions keep only words with
fewer than k dominators, their skybands are merged, and what is left is ranked exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import gathered, stored

# Different words a task holds before it hands on its counts.
TASK_WORDS = 400_000
# Bytes of a text looked at in one step.
TEXT_STEP = 1 << 22
# Pairs of sources of a word looked at in one step.
PAIR_STEP = 1 << 20
# Sums of pairs of sources a task holds before it hands them on.
TASK_PAIRS = 1 << 20
# Words of a group a task collects before it reduces them to their skyband.
SKYBAND_ROWS = 1 << 15
# Partial skybands that meet in one task when they are merged.
MERGE_FAN_IN = 16
SCALE = 1_000_000_000

# Letters, in lower case for A-Z, and all bytes of other characters stay; the rest parts words.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in lists of bounded size."""
    spaced = text.translate(_LETTERS)
    begin = 0
    while len(spaced) - begin > TEXT_STEP:
        end = spaced.find(b" ", begin + TEXT_STEP)
        if end < 0:
            break
        yield spaced[begin:end].split()
        begin = end
    yield spaced[begin:].split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, word, n (occurrences) and docs, summed within the task."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            words = list(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(words), pa.string()),
                    "source": pa.array([source] * len(words), pa.string()),
                    "word": pa.array(words, pa.binary()),
                    "n": pa.array([n[w] for w in words], pa.int64()),
                    "docs": pa.array([docs[w] for w in words], pa.int64()),
                }
            )
        counts.clear()

    held = 0
    for batch in batches:
        langs, sources, texts = (batch.column(i).to_pylist() for i in range(3))
        for lang, source, text in zip(langs, sources, texts, strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            seen: set[bytes] = set()
            for words in words_of(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
            if held > TASK_WORDS:
                yield from handed_on()
                held = 0
    yield from handed_on()


def _share(count: str, total: str, words: str) -> str:
    """1 + floor(SCALE (count + 1) / (total + words)) in exact arithmetic."""
    return (
        f"1 + ({SCALE} * (CAST({count} AS DECIMAL(20,0)) + 1)) "
        f"DIV nullif(CAST({total} AS DECIMAL(20,0)) + {words}, 0)"
    )


def _apart(p: str, q: str) -> str:
    """floor((p - q)^2 / q); shares are below 2^30 or so, so longs hold it."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) DIV ({q})"


def _apart_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _summed(keys: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(keys[::-1])
    a, b, values = keys[0][order], keys[1][order], values[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new], np.add.reduceat(values, new)


def _shared_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For words with their sources (arrays g, p, base): g, other, value summed in the task.

    ``value`` is what a word both sources have adds over three sums that take it for absent
    in one or both of them.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def merged() -> tuple[np.ndarray, ...]:
        a, b, v = (np.concatenate(part) for part in zip(*held, strict=True))
        return _summed((a, b), v)

    def batch_of(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(s, pa.int64()) for s in sums], ["g", "other", "value"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(0)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        g, p, base = (
            batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(3)
        )
        known, code = np.unique(g, return_inverse=True)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = np.repeat(sizes, sizes)
        # One source after another meets the other sources of its words.
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
        for begin, end in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            mine = order[begin:end]
            totals = np.zeros(len(known), np.int64)
            met = np.zeros(len(known), bool)
            step = np.cumsum(width[mine]) // PAIR_STEP
            for s in np.unique(step):
                some = mine[step == s]
                left = np.repeat(some, width[some])
                right = gathered(starts[some], width[some])
                apart = left != right
                left, right = left[apart], right[apart]
                a, b, a0, b0 = p[left], p[right], base[left], base[right]
                value = (
                    _apart_of(a, b) - _apart_of(a, b0) - _apart_of(a0, b) + _apart_of(a0, b0)
                )
                np.add.at(totals, code[right], value)
                met[code[right]] = True
            others = np.flatnonzero(met)
            held.append((np.full(len(others), g[mine[0]]), known[others], totals[others]))
            size += len(others)
        if size > TASK_PAIRS:
            held = [merged()]
            size = len(held[0][0])
            if size > TASK_PAIRS // 2:
                yield batch_of(held[0])
                held, size = [], 0
    if held:
        yield batch_of(merged())


def skyband(n: np.ndarray, all_n: np.ndarray, spelling: np.ndarray, k: int) -> np.ndarray:
    """Positions of the words that fewer than ``k`` others dominate; ``spelling`` are ranks.

    In the order of falling ``n``, then rising ``all_n``, then spelling, dominators come
    first.  Of the dominators of a word with k or more the first k are in the skyband
    themselves, so comparing with the words kept so far is enough.
    """
    order = np.lexsort((spelling, all_n, -n))
    kept = np.zeros(0, np.int64)
    step = 256
    for begin in range(0, len(order), step):
        block = order[begin : begin + step]
        over = all_n[kept][None, :] <= all_n[block][:, None]
        over &= spelling[kept][None, :] < spelling[block][:, None]
        dominators = over.sum(axis=1)
        alive = block[dominators < k]
        if not len(alive):
            continue
        # Within the block every word before counts, kept or not: one that is not kept has
        # k dominators, which then dominate too.
        inside = all_n[block][None, :] <= all_n[alive][:, None]
        inside &= spelling[block][None, :] < spelling[alive][:, None]
        place = np.arange(len(block))
        inside &= place[None, :] < place[dominators < k][:, None]
        total = dominators[dominators < k] + inside.sum(axis=1)
        kept = np.concatenate([kept, alive[total < k]])
    return kept


def _skybands(k: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, word, n, all_n, ..) of the skyband of each group in this partition."""
        held: dict[int, list[pa.Table]] = {}
        rows: dict[int, int] = {}
        limit: dict[int, int] = {}

        def reduced(g: int) -> pa.Table:
            table = pa.concat_tables(held[g])
            spelling = np.empty(table.num_rows, np.int64)
            spelling[pc.sort_indices(table["word"].combine_chunks()).to_numpy()] = np.arange(
                table.num_rows
            )
            keep = skyband(
                table["n"].to_numpy(), table["all_n"].to_numpy(), spelling, k
            )
            return table.take(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            of = table["g"].to_numpy()
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
            for begin, end in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                g = int(of[order[begin]])
                held.setdefault(g, []).append(table.take(pa.array(order[begin:end])))
                rows[g] = rows.get(g, 0) + int(end - begin)
                if rows[g] > limit.get(g, SKYBAND_ROWS):
                    held[g] = [reduced(g)]
                    rows[g] = held[g][0].num_rows
                    limit[g] = rows[g] + SKYBAND_ROWS
        for g in held:
            yield from reduced(g).to_batches(max_chunksize=10_000)

    return reduce


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language lie apart.

    Null text, lang and source are ''.  Words are runs of letters and non-ASCII characters,
    A-Z lower-cased.  A language keeps the words that ``min_docs`` of its documents (rows)
    have; every source of it gives each of them the share
    p = 1 + floor(10^9 (count + 1) / (N + V)), N its occurrences of kept words and V their
    number, and so does the language.  For shares p and q, f = floor((p - q)^2 / q).

    Part ``pair``: each other source of the language with the sum of f over all kept words
    (0 if there is none), every rank.  Part ``term``: the kept words that the source has and
    uses more than the language does, with f against the language's share, ranks to ``top``.
    Ranks go by falling value, ties by spelling (UTF-8).  Sources without words take part.
    Repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        _text("lang").alias("lang"), _text("source").alias("source"),
        F.coalesce(F.col("text").cast("binary"), F.lit(bytearray())).alias("text"),
    )
    counted = rows.mapInArrow(
        _count_words, "lang string, source string, word binary, n long, docs long"
    )
    # One exchange by word serves both sums.  Tasks have summed before it, so that a very
    # common word brings a row per task and source.
    by_source = (
        counted.repartition("lang", "word")
        .groupBy("lang", "source", "word")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    kept = stored(
        by_source.groupBy("lang", "word")
        .agg(
            F.sum("n").alias("all_n"),
            F.sum("docs").alias("docs"),
            F.collect_list(F.struct("source", "n")).alias("sources"),
        )
        .where(F.col("docs") >= min_docs)
        .select("lang", "word", "all_n", "sources"),
        "words",
    )
    groups = stored(_groups(rows, kept), "groups")
    scored = stored(_scored(kept, groups), "shares")
    pairs = _pairs(scored, groups)
    words = _words(scored, top)
    names = groups.select("g", "lang", "source")
    out = pairs.unionByName(words).join(names, "g")
    return out.select("lang", "source", "part", "item", "value", "rank")


def _groups(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per source of a language: g, lang, source, total, words, all_total, base."""
    langs = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("words"), F.sum("all_n").alias("all_total")
    )
    totals = (
        kept.select("lang", F.explode("sources").alias("s"))
        .groupBy("lang", F.col("s.source").alias("source"))
        .agg(F.sum("s.n").alias("total"))
    )
    zero = F.lit(0).cast("long")
    return (
        rows.select("lang", "source")
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            F.monotonically_increasing_id().alias("g"),
            "lang",
            "source",
            *[F.coalesce(c, zero).alias(c) for c in ("total", "words", "all_total")],
        )
        # The share of a word that the source does not have; null without kept words.
        .withColumn("base", F.expr(_share("0", "total", "words")))
    )


def _scored(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """g, lang, word, n, all_n, p (share in the source), q (in the language), base, held (by how
    many sources)."""
    flat = kept.select(
        "lang", "word", "all_n", F.size("sources").alias("held"), F.explode("sources").alias("s")
    ).select("lang", "word", "all_n", "held", F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    return flat.join(groups, ["lang", "source"]).select(
        "g", "lang", "word", "n", "all_n", "held",
        F.expr(_share("n", "total", "words")).alias("p"),
        F.expr(_share("all_n", "all_total", "words")).alias("q"),
        "base",
    )


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    both = (
        scored.where("held > 1")
        .groupBy("lang", "word")
        .agg(F.collect_list(F.struct("g", "p", "base")).alias("s"))
        .select(*[F.col(f"s.{c}").alias(c) for c in ("g", "p", "base")])
        .mapInArrow(_shared_words, "g long, other long, value long")
        .groupBy("g", "other")
        .agg(F.sum("value").alias("shared"))
    )
    # A source has few different counts, whatever the number of its words.
    levels = (
        scored.groupBy("g", "p")
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("g")
        .agg(F.collect_list(F.struct("p", "m")).alias("levels"))
    )
    sides = groups.join(levels, "g", "left").select(
        "g", "lang", "source", "words", "base",
        F.coalesce("levels", F.expr("array()").cast("array<struct<p:bigint,m:bigint>>")).alias("levels"),
    )
    other = sides.select(
        "lang", F.col("g").alias("other"), F.col("source").alias("item"),
        F.col("base").alias("other_base"), F.col("levels").alias("other_levels"),
    )
    rest = _apart("base", "other_base")
    mine = f"aggregate(levels, 0L, (t, e) -> t + e.m * ({_apart('e.p', 'other_base')} - {rest}))"
    its = f"aggregate(other_levels, 0L, (t, e) -> t + e.m * ({_apart('base', 'e.p')} - {rest}))"
    # Every pair of sources of a language is a row of the result.
    pairs = sides.join(other, "lang").where("g <> other").join(both, ["g", "other"], "left")
    value = F.when(
        F.col("words") > 0,
        F.expr(f"words * ({rest}) + {mine} + {its}") + F.coalesce("shared", F.lit(0)),
    ).otherwise(F.lit(0))
    return _ranked(pairs.select("g", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")))


def _words(scored: DataFrame, top: int) -> DataFrame:
    schema = "g long, word binary, n long, all_n long, p long, q long, part int"
    near = scored.where("p > q").select(
        "g", "word", "n", "all_n", "p", "q", F.spark_partition_id().alias("part")
    )
    first = near.mapInArrow(_skybands(top), schema)
    fan_in = (F.col("part") / MERGE_FAN_IN).cast("int")
    merged = first.repartition("g", fan_in).mapInArrow(_skybands(top), schema)
    found = merged.select(
        "g", F.lit("term").alias("part"), F.col("word").cast("string").alias("item"),
        F.expr(_apart("p", "q")).alias("value"),
    )
    return _ranked(found).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("g").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(by).cast("int"))


def divergence_sql(min_docs: int = 3, top: int = 200) -> str:
    """The same for DuckDB."""
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
flat AS (SELECT id, lang, source, unnest(words) AS word FROM rows),
kept AS (
  SELECT lang, word, count(*) AS n FROM flat
  GROUP BY lang, word HAVING count(DISTINCT id) >= {min_docs}
),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
had AS (
  SELECT lang, source, word, count(*) AS n FROM flat SEMI JOIN kept USING (lang, word)
  GROUP BY lang, source, word
),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(h.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM rows) g
  LEFT JOIN had h ON h.lang = g.lang AND h.source = g.source GROUP BY ALL
),
shares AS (
  SELECT g.lang, g.source, k.word, coalesce(h.n, 0) AS n,
         1 + {SCALE}::HUGEINT * (coalesce(h.n, 0) + 1) // (g.total + l.v) AS p,
         1 + {SCALE}::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k ON k.lang = g.lang
  LEFT JOIN had h ON h.lang = g.lang AND h.source = g.source AND h.word = k.word
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.word = b.word AND a.source <> b.source
  GROUP BY ALL
),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL
  SELECT lang, source, 'term', word, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {top}"""
