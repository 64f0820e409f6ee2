"""Near duplicates among vectors by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample (principal components, then alternating between the
signs and the rotation that fits them best) turn each vector into a code of balanced bits.
Vectors near each other differ in few bits, so that among the tables, each on its own part
of the code, some table is likely to hold them in entries that differ in one bit at most.
The length of a part grows with the logarithm of the number of vectors, which keeps entries
small; the number of tables then follows from the wanted recall at the threshold.

Codes alone travel to the tables.  An entry's codes propose pairs, each pair in the first
table where it meets; vectors follow only for members of a proposed pair, and their exact
cosines decide.  Pairs stay inside tasks: what leaves them is a count for every vector and a
spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stored
from panelloom.llm.connected import components
from panelloom.llm.near_dedup import spanning

# The sample that rotations are learned on: vectors, and bytes of them at most.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
ROUNDS = 40
# Vectors at the threshold are missed by all tables with about this probability, and by the
# bound on the distance of whole codes with that.
TABLE_MISS, BOUND_MISS = 0.002, 0.002
# Vectors per possible entry of a table, as a power of two, and the least part of a code.
ENTRY_BITS, LEAST_BITS = 6, 8
# Rows of an entry that are looked at together; larger entries are split into blocks.
BLOCK = 4096
BLOCK_BYTES = 16 << 20
PAIR_STEP = 1 << 18


class Coder(NamedTuple):
    """Centre and directions of all bits (dimensions x bits), and how tables use the code."""

    centre: np.ndarray
    directions: np.ndarray
    part: int
    tables: int
    bound: int

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.centre) @ self.directions > 0

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words."""
        bits = self.bits(unit)
        width = -(-bits.shape[1] // 64) * 64
        padded = np.zeros((len(bits), width), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def rotation(centred: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Directions (dimensions x bits) by iterative quantisation of the centred sample."""
    _, vectors = np.linalg.eigh(centred.T @ centred)
    chosen = vectors[:, ::-1][:, :64]
    flat = centred @ chosen
    turn, _ = np.linalg.qr(rng.normal(size=(chosen.shape[1], chosen.shape[1])))
    for _ in range(ROUNDS):
        signs = np.where(flat @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ flat)
        turn = (left @ right).T
    return chosen @ turn


def learned(sample: np.ndarray, n: int, cosine: float, seed: int = 1) -> Coder:
    """A coder for ``n`` vectors from a sample of unit vectors.

    How many bits differ at the threshold is measured on the sample's vectors and random
    ones at just that cosine to them.
    """
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    centred = sample - centre
    some = sample[:2048]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
    moved = cosine * some + math.sqrt(1 - cosine * cosine) * aside

    part = max(LEAST_BITS, math.ceil(math.log2(max(n, 2))) - ENTRY_BITS)
    turns = [rotation(centred, rng)]
    coder = Coder(centre, turns[0], part, 0, 0)
    flip = float((coder.bits(some) != coder.bits(moved)).mean())
    flip = min(max(flip, 0.01), 0.45)
    meet = (1 - flip) ** part + part * flip * (1 - flip) ** (part - 1)
    tables = max(2, math.ceil(math.log(TABLE_MISS) / math.log(1 - meet)))
    while sum(t.shape[1] for t in turns) < part * tables:
        turns.append(rotation(centred, rng))
    coder = Coder(centre, np.concatenate(turns, axis=1), part, tables, 0)
    far = np.sort((coder.bits(some) != coder.bits(moved)).sum(axis=1))
    bound = int(far[min(len(far) - 1, math.ceil(len(far) * (1 - BOUND_MISS)))]) + 1
    return coder._replace(bound=bound)


def _parts(codes: np.ndarray, part: int, tables: int) -> np.ndarray:
    """Parts of the codes as numbers, rows x tables."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")[:, : part * tables]
    powers = np.int64(1) << np.arange(part, dtype=np.int64)
    return bits.reshape(len(codes), tables, part).astype(np.int64) @ powers


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles and as unit vectors."""
    raw = np.stack(vectors.to_numpy()).astype(np.float64)
    # Scaled first, so that squares of very large or small components stay in range.
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _entries(coders: dict[int, Coder]):
    """Rows of the tables: entry, node, probe, code.  A vector stands in its own entry and asks
    in those that one bit set in its part leads down to; the pair meets once that way."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim", sort=False):
                coder = coders[dim]
                for begin in range(0, len(rows), 2048):
                    some = rows.iloc[begin : begin + 2048]
                    codes = coder.codes(_units(some["vector"])[1])
                    parts = _parts(codes, coder.part, coder.tables)
                    node = some["node"].to_numpy(np.int64)
                    data = np.array([c.tobytes() for c in codes], object)
                    at = [np.repeat(np.arange(len(some)), coder.tables)]
                    table = [np.tile(np.arange(coder.tables), len(some))]
                    value = [parts.ravel()]
                    for bit in range(coder.part):
                        i, t = np.nonzero(parts >> bit & 1)
                        at.append(i)
                        table.append(t)
                        value.append(parts[i, t] ^ (1 << bit))
                    probe = np.arange(sum(map(len, at))) >= len(at[0])
                    at, table = np.concatenate(at), np.concatenate(table)
                    yield pd.DataFrame(
                        {
                            "dim": dim,
                            "entry": table << 40 | np.concatenate(value),
                            "node": node[at],
                            "probe": probe,
                            "code": data[at],
                        }
                    )

    return make


def _met(coder: Coder, entry: int, codes: np.ndarray, probe: np.ndarray, side: np.ndarray):
    """Pairs (i, j) of rows that this entry proposes: one of them its own, near as codes, and
    in no table before within a bit.  ``side`` parts the rows into two blocks, of which only
    pairs across count, or is None."""
    table = entry >> 40
    own = np.flatnonzero(~probe)
    parts = _parts(codes, coder.part, max(table, 1))
    for begin in range(0, len(own), max(1, PAIR_STEP // max(len(codes), 1))):
        left = own[begin : begin + max(1, PAIR_STEP // max(len(codes), 1))]
        far = np.zeros((len(left), len(codes)), np.int64)
        for w in range(codes.shape[1]):
            far += np.bitwise_count(codes[left, w][:, None] ^ codes[None, :, w])
        good = far <= coder.bound
        # Two rows of the entry itself are a pair once.
        good &= probe[None, :] | (np.arange(len(codes))[None, :] > left[:, None])
        if side is not None:
            good &= side[left][:, None] != side[None, :]
        i, j = np.nonzero(good)
        i = left[i]
        if table:
            apart = np.bitwise_count(parts[i] ^ parts[j])
            new = (apart > 1).all(axis=1)
            i, j = i[new], j[new]
        if len(i):
            yield i, j


def _sides(key: tuple, rows: pd.DataFrame) -> np.ndarray | None:
    """Which rows lie in the second block, where two different blocks meet."""
    if key[2] == key[3]:
        return None
    return rows["block"].to_numpy() == key[3]


def _codes_of(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["code"]), "<u8").reshape(len(rows), -1)


def _proposed(coders: dict[int, Coder]):
    def members(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "probe"], kind="stable", ignore_index=True)
        probe = rows["probe"].to_numpy(bool)
        in_pair = np.zeros(len(rows), bool)
        found = _met(coders[key[0]], int(key[1]), _codes_of(rows), probe, _sides(key, rows))
        for i, j in found:
            in_pair[i] = in_pair[j] = True
        return rows.loc[in_pair, ["dim", "entry", "i", "j", "block", "node", "probe", "code"]]

    return members


def _confirmed(coders: dict[int, Coder], cosine: float):
    """For every member of proposed pairs: node, links (weighed by copies) and a linked node."""

    def confirm(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "probe"], kind="stable", ignore_index=True)
        node = rows["node"].to_numpy(np.int64)
        copies = rows["copies"].to_numpy(np.int64)
        vectors, _ = _units(rows["vector"])
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        links = np.zeros(len(rows), np.int64)
        # Links of a node with a larger number come as a forest, one parent at a time.
        edges = []
        probe = rows["probe"].to_numpy(bool)
        found = _met(coders[key[0]], int(key[1]), _codes_of(rows), probe, _sides(key, rows))
        for i, j in found:
            dots = np.einsum("ij,ij->i", vectors[i], vectors[j])
            near = dots / (length[i] * length[j]) >= cosine
            i, j = i[near], j[near]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges.append(np.stack([i, j], axis=1))
            if sum(map(len, edges)) > PAIR_STEP:
                edges = [_forest(edges, len(rows))]
        parent = np.arange(len(rows))
        if edges:
            parent = spanning(np.concatenate(edges), len(rows))
        return pd.DataFrame({"node": node, "links": links, "other": node[parent]})

    return confirm


def _forest(edges: list[np.ndarray], n: int) -> np.ndarray:
    parent = spanning(np.concatenate(edges), n)
    child = np.flatnonzero(parent != np.arange(n))
    return np.stack([child, parent[child]], axis=1)


def _coders(reps: DataFrame, cosine: float) -> dict[int, Coder]:
    """A coder for each dimension there is, from its sample."""
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    coders = {}
    for dim, n in sizes.items():
        rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        sample = (
            reps.where(F.col("dim") == dim).orderBy(F.xxhash64("vector"), "node").limit(rows)
        )
        coders[dim] = learned(_units(sample.select("vector").toPandas()["vector"])[1], n, cosine)
    return coders


def near_vectors(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked by a cosine of ``cosine`` or more.

    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id
    that links reach, the vector's own included, and ``kept`` marks the vector with that id.
    Every link found is exact; pairs near the threshold are missed with a small probability
    (``TABLE_MISS``, ``BOUND_MISS``), equal vectors never.

    Vectors that are null, empty, all zero or hold null or non-finite components link with
    nothing, neither do rows without an id (component null, kept).  Only vectors of equal
    dimension are compared.  Repeated rows are one vector with one result each; two vectors
    under one id count as two.  An empty table gives no rows; other columns are not read.
    """
    v = F.col(vector_col)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    usable = F.col(id_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(F.coalesce(usable, F.lit(False)), v).alias("vector"),
    )
    # Equal vectors are one node, whatever their number.
    reps = stored(
        rows.where(F.col("vector").isNotNull())
        .groupBy("vec_id", "vector")
        .agg(F.lit(1).alias("_one"))
        .groupBy("vector")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .select(
            F.monotonically_increasing_id().alias("node"), F.size("vector").alias("dim"),
            "vector", "least", "copies",
        ),
        "vectors",
    )
    coders = _coders(reps, cosine)
    # Like texts in all operators: a probe of an entry too large for a task goes to its blocks.
    tables = stored(
        reps.select("node", "dim", "vector").mapInPandas(
            _entries(coders), "dim int, entry long, node long, probe boolean, code binary"
        ),
        "tables",
    )
    large = tables.groupBy("dim", "entry").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    ).where("blocks > 1")
    # Each block of an entry meets every block of it, itself too, once.
    blocked = (
        tables.join(large, ["dim", "entry"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
        .select(
            "dim", "entry", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"),
            "block", "node", "probe", "code",
        )
    )
    members = stored(
        blocked.groupBy("dim", "entry", "i", "j").applyInPandas(
            _proposed(coders),
            "dim int, entry long, i int, j int, block int, node long, probe boolean, code binary",
        ),
        "members",
    )
    found = stored(
        members.join(reps.select("node", "vector", "copies"), "node")
        .groupBy("dim", "entry", "i", "j")
        .applyInPandas(_confirmed(coders, cosine), "node long, links long, other long"),
        "links",
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(
        found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    )
    named = reps.select("node", "least", "copies", "vector").join(
        labels.select("node", "label"), "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    nodes = (
        named.join(least, "label")
        .join(counts, "node", "left")
        .select(
            "vector",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            "component_id",
        )
    )
    return rows.join(nodes, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


NEAR_VECTORS_SQL = """
WITH RECURSIVE good AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
),
reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links,
       coalesce(least(l.b, e.vec_id), e.vec_id) AS component_id,
       coalesce(e.vec_id <= l.b, true) AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id"""
