"""Near-duplicate classes by MinHash sketches, banding and exact verification.

Sketches place the hashed shingles of a set into bins, round by round: in the first rounds
each shingle falls into a random bin, in later rounds all shingles go to one bin after
another, so every coordinate fills; a coordinate keeps the least (round, value).  Sets agree
in a coordinate with the probability of their similarity, and one round is enough for sets
of some size.

Bands of coordinates only propose: documents that share a band, directly or through
others, form a cluster.  All pairs of a cluster are compared on their full sets, block
against block inside tasks, and only a spanning forest of the links leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import id_text, mixed, stored
from panelloom.llm.connected import components
from panelloom.llm.shingles import Shingler

# With similarity s a pair shares no band with probability (1 - s^BAND_ROWS)^BANDS:
# 5e-6 at 0.8, and 0.003 of the pairs at 0.2 share one.
BANDS, BAND_ROWS = 40, 6
# Members of a cluster compared with each other in one task are two blocks of this size.
BLOCK = 128
# Their sets take about so many bytes at most, but for single sets that are larger.
BLOCK_BYTES = 8 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
ROUND_STEP = np.uint64(0x9E3779B97F4A7C15)
# Columns of the membership matrix at a time.
COLUMNS = 4096


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a set of 64-bit hashes (not empty); ``bins`` coordinates."""
    n = len(shingles)
    out = np.full(bins, EMPTY)
    begin = 0
    # Rounds are independent, so as many as are likely to be needed run in one step; a
    # round too many changes nothing, as later rounds lose against earlier ones.
    step = max(1, min(bins, math.ceil(bins * (math.log(bins) + 1) / n)))
    while begin < 2 * bins:
        rounds = np.arange(begin, min(begin + step, 2 * bins), dtype=np.uint64)
        h = mixed(shingles[None, :] ^ mixed((rounds + np.uint64(1)) * ROUND_STEP)[:, None])
        place = np.where(
            (rounds < bins)[:, None],
            h % np.uint64(bins),
            np.maximum(rounds, np.uint64(bins))[:, None] - np.uint64(bins),
        )
        value = (rounds[:, None] << np.uint64(52)) | (h >> np.uint64(12))
        np.minimum.at(out, place.astype(np.int64).ravel(), value.ravel())
        if not (out == EMPTY).any():
            break
        begin += step
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band; equal bands at different places differ."""
    rows = coordinates.reshape(BANDS, BAND_ROWS)
    key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * ROUND_STEP)
    for i in range(BAND_ROWS):
        key = mixed((key ^ rows[:, i]) * ROUND_STEP)
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of the whole set), bands; the last two null for
    empty sets.  ``docs`` has columns doc_id, text and text_key, which goes along as it is."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            counts, keys, bands = [], [], []
            for text in batch["text"]:
                found = shingler.hashes(text)
                counts.append(len(found))
                if len(found):
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(band_keys(sketch(found, BANDS * BAND_ROWS)))
                else:
                    keys.append(None)
                    bands.append(None)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_key": batch["text_key"],
                    "n_shingles": counts,
                    "set_key": keys,
                    "bands": bands,
                }
            )

    schema = "doc_id string, text_key string, n_shingles long, set_key binary, bands array<long>"
    return (
        docs.select(id_text("doc_id").alias("doc_id"), "text", "text_key")
        .mapInPandas(make, schema)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def linked_pairs(sets: list[np.ndarray], split: int, percent: int) -> np.ndarray:
    """Pairs (i, j), i < j, of the sets whose similarity is at least ``percent`` / 100.

    With ``split`` > 0 only pairs of a set before it and one from it on count.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, symbol, times = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True
    )
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Shingles of one set only are in no intersection.
    shared = times[symbol] > 1
    symbol, owner = symbol[shared], owner[shared]
    order = np.argsort(symbol, kind="stable")
    symbol, owner = symbol[order], owner[order]
    symbol = np.cumsum(np.append(False, symbol[1:] != symbol[:-1])) if len(symbol) else symbol
    both = np.zeros((len(sets), len(sets)), np.float64)
    if len(symbol):
        width = int(symbol[-1]) + 1
        for begin in range(0, width, COLUMNS):
            low, high = np.searchsorted(symbol, [begin, begin + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, width - begin)), np.float32)
            part[owner[low:high], symbol[low:high] - begin] = 1
            both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    hit = np.triu(100 * both >= percent * union, 1)
    if split:
        hit[:split, :split] = False
        hit[split:, split:] = False
    return np.argwhere(hit)


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Parent of each of ``n`` nodes: the least node it is connected with."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], dtype=np.int64)


def _clusters(reps: DataFrame) -> DataFrame:
    """node, cluster: sets that share a band, directly or through others."""
    bands = reps.select("node", F.explode("bands").alias("band"))
    heads = (
        bands.groupBy("band")
        .agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    shared = bands.join(heads.select("band", "head"), "band").where("node <> head")
    edges = shared.select(F.col("node").alias("a"), F.col("head").alias("b"))
    return components(edges).select("node", F.col("label").alias("cluster"))


def once_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, text) without those the same task has had before."""
    seen: set[tuple[int, bytes]] = set()
    for batch in batches:
        new = []
        for i, text in zip(batch["doc_id"], batch["text"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            key = (i, xxhash.xxh3_128_digest(data))
            new.append(key not in seen)
            seen.add(key)
        yield batch[np.array(new, dtype=bool)]


def _verified(
    docs: DataFrame, reps: DataFrame, clusters: DataFrame, words: int, percent: int
) -> DataFrame:
    """Edges (a, b) that span the linked sets of every cluster."""
    weighed = clusters.join(
        reps.select("node", "rep", "set_key", (8 * F.col("n_shingles")).alias("bytes")), "node"
    )
    sizes = weighed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )
    placed = (
        weighed.drop("bytes").join(sizes, "cluster")
        .withColumn(
            "blocks",
            F.least(
                F.col("n"),
                F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)),
            ).cast("int"),
        )
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select(F.col("rep").alias("doc_id"), "node", "set_key", "cluster", "blocks", "block")
    )
    # Repeated rows go before the exchange, so that what meets is one row a task at most.
    slim = docs.select("doc_id", "text").mapInPandas(once_each, "doc_id long, text string")
    # Texts are dealt by id at every size: a plan that only small inputs get tells nothing.
    texts = slim.join(placed.hint("merge"), "doc_id")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in once_each(batches):
            out = batch[["node", "cluster", "blocks", "block"]].copy()
            out["shingles"] = [shingler.hashes(t).tobytes() for t in batch["text"]]
            # Another text under the id of the set is not the set.
            keys = [xxhash.xxh3_128_digest(s) for s in out["shingles"]]
            yield out[np.array([k == w for k, w in zip(keys, batch["set_key"], strict=True)], bool)]

    with_sets = texts.mapInPandas(
        sets, "node long, cluster long, blocks int, block int, shingles binary"
    )
    # Each block meets every block of its cluster, itself too, once.
    met = with_sets.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "cluster",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "node",
        "shingles",
    )

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # A set is here once, even where tasks before had a repeated row each.
        pdf = pdf.drop_duplicates("node")
        pdf = pdf.sort_values(["block", "node"], kind="stable")
        found = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        ids = pdf["node"].to_numpy(np.int64)
        split = 0 if key[1] == key[2] else int((pdf["block"] == key[1]).sum())
        parent = spanning(linked_pairs(found, split, percent), len(ids))
        child = np.flatnonzero(parent != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[child], "b": ids[parent[child]]})

    return met.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``words``-word shingles have a similarity (intersection over
    union) of at least ``percent`` / 100 are linked; a class is what links connect, and
    ``component_id`` its smallest doc_id; ``kept`` marks the document with that id.

    Null, empty and blank texts have empty sets and are linked with nothing.  Rows without
    an id take no part: component_id null, kept.  Rows that share an id and a text are one
    document with one result each; different texts under one id have a class each.  Other columns are not read.
    """
    slim = docs.select("doc_id", "text", F.lit(None).cast("string").alias("text_key"))
    return _classes(slim, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, component_id, kept of rows (doc_id, text,
    text_key)."""
    slim = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    made = stored(sketches(slim, words), "sketches")
    named = made.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # Equal sets are one: each is represented by its smallest id, and by a number of its own,
    # as one id may have several sets.
    reps = stored(
        named.groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.min("bands").alias("bands"),
            F.min("n_shingles").alias("n_shingles"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "sets",
    )
    clusters = stored(_clusters(reps), "clusters")
    links = _verified(slim.select("doc_id", "text").where(F.col("doc_id").isNotNull()), reps, clusters, words, percent)
    classes = components(links)
    named = reps.select("set_key", "rep", "node").join(classes, "node", "left").select(
        "set_key", "rep", F.coalesce("label", "node").alias("class")
    )
    least = named.groupBy("class").agg(F.min("rep").alias("label"))
    labels = named.join(least, "class").select("set_key", "label")
    rows = made.select("doc_id", "text_key", "n_shingles", "set_key")
    return (
        rows.join(labels, "set_key", "left")
        .select(
            "doc_id",
            "text_key",
            "n_shingles",
            "set_key",
            F.when(
                F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")
            ).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, the one with the
    smallest doc_id; all columns stay.

    Of rows that share an id one stays for every set of shingles there is under it, so that
    different texts never go for each other's sake; of repeated rows one stays.  Rows without
    an id all stay, and so do empty and blank texts (one row of each under an id).
    """
    # The row goes along as a whole, so that no name of it meets those made here.
    text_key = F.when(F.col("text").isNotNull(), F.sha2(F.col("text"), 256)).otherwise("null")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), "text", text_key.alias("text_key"),
    )
    classes = _classes(rows.select("doc_id", "text", "text_key"), words, percent)
    chosen = (
        classes.where(F.col("kept") & F.col("doc_id").isNotNull())
        .groupBy("doc_id", F.coalesce(F.hex("set_key"), "text_key").alias("set"))
        .agg(F.min("text_key").alias("text_key"))
        .select("doc_id", "text_key")
    )
    by = Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64("row"))
    first = (
        rows.where(F.col("doc_id").isNotNull())
        .join(chosen, ["doc_id", "text_key"], "left_semi")
        .select("doc_id", "text_key", "row", F.row_number().over(by).alias("place"))
        .where(F.col("place") == 1)
    )
    return first.select("row").union(
        rows.where(F.col("doc_id").isNull()).select("row")
    ).select("row.*")
