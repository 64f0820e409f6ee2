"""Packing documents into fixed-length sequences with a grouping genetic algorithm.

Pieces are dealt to shards of bounded size.  A shard is evolved on several islands, each a
task of its own with a population: an individual is a list of bins, crossover injects the
best-filled bins of one parent into another, bins that share a piece with them are
dissolved, and displaced pieces go back by best fit.  Between epochs the best individual of
each island moves to the next island of its shard through a shuffle.  At last the poorly
filled bins of all shards are opened and packed once more together, in shards of their own.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import id_text, ragged_positions, stored
from panelloom.llm.word_tokens import word_tokenizer

SHARD_PIECES = 2000
ISLANDS = 2
TASK_ISLANDS = 8
EPOCHS = 2
GENERATIONS = 3
POPULATION = 4
# Bins filled less than this are opened for the last round.
FULL = 0.98
SEED = 11


def token_pieces(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int | None = 0
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole texts as ids with ``end_id`` after
    them; only what is longer than ``size`` is cut.  A text without ids and no ``end_id``
    gives no piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_tokenizer(vocabulary)
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            encoded = tokenizer.encode_all(batch["text"].tolist())
            for d, ids in zip(batch["doc_id"], encoded, strict=True):
                ids = np.concatenate([ids, tail]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    rows.append((d, piece, start, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(
                rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return (
        docs.select(id_text("doc_id").alias("doc_id"), "text")
        .mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


class Bins:
    """An individual: pieces in bins that hold ``size``."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.bins: list[list[int]] = []
        self.left: list[int] = []

    def add(self, members: list[int]) -> None:
        self.bins.append(members)
        self.left.append(self.size - sum([self.lengths[i] for i in members]))

    def best_fit(self, pieces: list[int]) -> None:
        """Each piece into the bin it fills up most, else into a new bin."""
        room = sorted((left, b) for b, left in enumerate(self.left) if left > 0)
        for i in pieces:
            n = self.lengths[i]
            at = bisect.bisect_left(room, (n, -1))
            if at < len(room):
                left, b = room.pop(at)
                self.bins[b].append(i)
            else:
                left, b = self.size, len(self.bins)
                self.bins.append([i])
                self.left.append(0)
            self.left[b] = left - n
            if left > n:
                bisect.insort(room, (left - n, b))

    def fitness(self) -> float:
        """Few bins first, then uneven ones: full bins are worth keeping."""
        used = (self.size - np.array(self.left, float)) / self.size
        return float((used**2).mean()) if len(used) else 1.0

    def owners(self) -> np.ndarray:
        """Bin number of each piece."""
        out = np.zeros(len(self.lengths), np.int32)
        for b, members in enumerate(self.bins):
            out[members] = b
        return out

    @classmethod
    def of(cls, owners: np.ndarray, lengths: list[int], size: int) -> Bins:
        out = cls(lengths, size)
        order = np.argsort(owners, kind="stable")
        cuts = np.flatnonzero(np.diff(owners[order])) + 1
        for members in np.split(order, cuts):
            out.add(members.tolist())
        return out


def crossover(one: Bins, two: Bins, rng: np.random.Generator) -> Bins:
    """The best-filled bins of ``two`` go whole into ``one``."""
    order = np.argsort(two.left, kind="stable")
    share = int(rng.integers(1, max(2, len(order) // 2 + 1)))
    injected = [two.bins[b] for b in order[:share]]
    taken = {i for members in injected for i in members}
    child = Bins(one.lengths, one.size)
    displaced: list[int] = []
    for members in injected:
        child.add(list(members))
    for members in one.bins:
        if taken.isdisjoint(members):
            child.add(list(members))
        else:
            displaced += [i for i in members if i not in taken]
    displaced.sort(key=lambda i: -one.lengths[i])
    child.best_fit(displaced)
    return child


def mutated(one: Bins, rng: np.random.Generator) -> Bins:
    """Some of the emptier bins are opened and their pieces packed anew."""
    order = np.argsort(one.left, kind="stable")[::-1]
    opened = order[: max(2, len(order) // 20)]
    opened = set(opened.tolist()) | set(rng.integers(0, len(order), 2).tolist())
    child = Bins(one.lengths, one.size)
    loose: list[int] = []
    for b, members in enumerate(one.bins):
        if b in opened:
            loose += members
        else:
            child.add(list(members))
    noise = rng.random(len(loose)) * 0.3 + 0.85
    loose = [i for _, i in sorted(zip((-one.lengths[i] * z for i, z in zip(loose, noise)), loose))]
    child.best_fit(loose)
    return child


def first_population(lengths: list[int], size: int, rng: np.random.Generator) -> list[Bins]:
    """Best fit by falling length, and by falling length with some noise."""
    out = []
    for k in range(POPULATION):
        noise = np.ones(len(lengths)) if k == 0 else rng.random(len(lengths)) * 0.2 * k + 1
        one = Bins(lengths, size)
        one.best_fit(np.argsort(-np.array(lengths) * noise, kind="stable").tolist())
        out.append(one)
    return out


def evolved(population: list[Bins], generations: int, rng: np.random.Generator) -> list[Bins]:
    """The population after some generations, best first.  It ends early where no packing
    can have fewer bins."""
    lengths, size = population[0].lengths, population[0].size
    least = math.ceil(sum(lengths) / size)
    population.sort(key=lambda p: (len(p.bins), -p.fitness()))
    for _ in range(generations):
        if len(population[0].bins) <= least:
            break
        a, b = rng.integers(0, len(population), 2)
        children = [
            crossover(population[0], population[int(a)], rng),
            crossover(population[int(b)], population[0], rng),
            mutated(population[0], rng),
        ]
        population = sorted(
            population + children, key=lambda p: (len(p.bins), -p.fitness())
        )[: len(population)]
    return population


POPULATION_SCHEMA = (
    "shard long, island int, lengths array<int>, people array<array<int>>"
)
SHARD_SCHEMA = (
    "shard long, doc_id array<string>, piece array<int>, start array<long>, "
    "length array<int>, ids_crc32 array<long>"
)
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _sharded(pieces: DataFrame, shard_pieces: int, base: int) -> DataFrame:
    """Pieces in shards, one row each, stored."""
    n = max(1, math.ceil(pieces.count() / shard_pieces))
    # By place, so that repeated rows spread; the pieces are stored, so places are fixed.
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = pieces.withColumn("shard", F.pmod(place, F.lit(n)) + F.lit(base)).withColumn(
        "doc_id", id_text("doc_id")
    )

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(COLUMNS, kind="stable")
        return pd.DataFrame({"shard": [key[0]], **{c: [pdf[c].tolist()] for c in COLUMNS}})

    return stored(dealt.groupBy("shard").applyInPandas(pack, SHARD_SCHEMA), "shards")


def _packed(shards: DataFrame, size: int) -> DataFrame:
    """The best bins of every shard: shard, owners (bin number of each piece)."""
    # An island costs its task seconds, whatever its bytes, so tasks are set by islands.
    tasks = max(1, math.ceil(shards.count() * ISLANDS / TASK_ISLANDS))
    islands = shards.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.col("length").alias("lengths"),
        F.array().cast("array<array<int>>").alias("people"),
    )

    def epoch(number: int):
        def evolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    lengths = np.asarray(r.lengths).tolist()
                    rng = np.random.default_rng([SEED, number, int(r.shard), int(r.island)])
                    if len(r.people):
                        people = [Bins.of(np.asarray(p), lengths, size) for p in r.people]
                    else:
                        people = first_population(lengths, size, rng)
                    people = evolved(people, GENERATIONS, rng)
                    out.append((r.shard, r.island, lengths, [p.owners() for p in people]))
                yield pd.DataFrame(out, columns=["shard", "island", "lengths", "people"])

        return evolve

    now = islands.repartition(tasks, "shard", "island").mapInPandas(epoch(0), POPULATION_SCHEMA)
    for number in range(1, EPOCHS):
        now = stored(now, f"epoch{number}")
        # The best of an island replaces the worst of the next.
        movers = now.select(
            "shard",
            F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"),
            F.slice("people", 1, 1).alias("elite"),
        )
        now = (
            now.join(movers, ["shard", "island"])
            .select(
                "shard", "island", "lengths",
                F.concat(
                    "elite", F.slice("people", 1, F.greatest(F.size("people") - 1, F.lit(1)))
                ).alias("people"),
            )
            .repartition(tasks, "shard", "island")
            .mapInPandas(epoch(number), POPULATION_SCHEMA)
        )
    best = F.struct(
        F.array_max(F.get("people", F.lit(0))).alias("bins"), "island",
        F.get("people", F.lit(0)).alias("owners"),
    )
    return now.groupBy("shard").agg(F.min(best)["owners"].alias("owners"))


PLACED = (
    "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, "
    "offset long, fill double"
)


def _places(shards: DataFrame, owners: DataFrame, size: int) -> DataFrame:
    """A row per piece with its sequence, its place there and how full the sequence is."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                owner = np.asarray(r.owners, np.int64)
                order = np.argsort(owner, kind="stable")
                length = np.asarray(r.length, np.int64)[order]
                owner = owner[order]
                before = np.cumsum(length) - length
                first = np.flatnonzero(np.append(True, np.diff(owner) != 0))
                counts = np.diff(np.append(first, len(owner)))
                fill = np.add.reduceat(length, first) / size
                yield pd.DataFrame(
                    {
                        "doc_id": [r.doc_id[i] for i in order],
                        "piece": np.asarray(r.piece, np.int64)[order],
                        "start": np.asarray(r.start, np.int64)[order],
                        "length": length,
                        "ids_crc32": np.asarray(r.ids_crc32, np.int64)[order],
                        "sequence_id": int(r.shard) * (1 << 22) + owner,
                        "offset": before - np.repeat(before[first], counts),
                        "fill": np.repeat(fill, counts),
                    }
                )

    placed = shards.join(owners, "shard").mapInPandas(place, PLACED)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_pieces(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Every piece stands in one sequence; offsets leave no gap; no sequence is longer than
    ``size``.  Repeated rows are packed each.
    """
    kept = stored(pieces, "pieces")
    shards = _sharded(kept, SHARD_PIECES, 0)
    first = stored(_places(shards, _packed(shards, size), size), "packed")
    # The bins that stayed poorly filled, a bounded few of each shard, once more together.
    again = first.where(F.col("fill") < FULL).select(COLUMNS)
    base = shards.agg(F.max("shard")).first()[0]
    done = first.where(F.col("fill") >= FULL)
    if base is not None:
        left = _sharded(again, SHARD_PIECES, int(base) + 1)
        done = done.union(_places(left, _packed(left, size), size))
    return done.drop("fill")


def pack_documents(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int | None = 0
) -> DataFrame:
    """Documents as pieces of token ids, packed into few sequences of at most ``size``:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are ``end_id`` alone.  Null ids stay null.  Rows that repeat are
    packed each.  An empty table gives no rows.  Other columns are not read.
    """
    return pack_pieces(token_pieces(docs, vocabulary, size, end_id), size)
