"""Bootstrap intervals of means.

A replicate draws n of n values with replacement: multinomial counts.  Drawn independently,
Poisson counts of one mean for every value are multinomial too, given their total.  So every
value first gets a Poisson count whose mean is a little below one, such that the total stays
below n, and the draws that are missing to n (about 8 sqrt(n)) are then made one by one.  That
is exact at every size, and what travels is sums per block and replicate, and the few draws.

Values stand in the order of their size, as positions 0 .. n - 1, in blocks of bounded length;
equal values are one run.  Every draw is a function of group, replicate and position alone, so
results do not depend on how the rows are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.resampling import Draws, poisson_mean, poisson_weights, positions
from panelloom.plans.order_stats import COUNT, VALUE, running_totals, value_counts

BLOCK = 4096
# Weights in one array, so few that the arithmetic stays in a core's cache.
_STEP = 1 << 15
# Draws in one batch.
_BATCH = 1 << 18


def _blocks(counts: DataFrame, min_n: int) -> DataFrame:
    """Runs of equal values inside a block: g, g_no, n, block, x, start (in the group), size."""
    scan = running_totals(counts, ["g"])
    first, last = F.col("start"), F.col("start") + F.col(COUNT) - 1
    runs = scan.where(F.col(f"{COUNT}_total") >= min_n).select(
        "g",
        F.conv(F.substring(F.md5(F.col("g").cast("string").cast("binary")), 1, 7), 16, 10)
        .cast("long")
        .alias("g_no"),
        F.col(f"{COUNT}_total").alias("n"),
        F.col(VALUE).alias("x"),
        F.col(f"{COUNT}_below").alias("start"),
        COUNT,
    )
    cut = runs.withColumn(
        "block",
        F.explode(
            F.sequence(F.floor(first / BLOCK).cast("long"), F.floor(last / BLOCK).cast("long"))
        ),
    )
    begin = F.greatest(first, F.col("block") * BLOCK)
    end = F.least(last + 1, (F.col("block") + 1) * BLOCK)
    return cut.select(
        "g", "g_no", "n", "block", "x", begin.alias("start"), (end - begin).alias("size")
    )


def _values(runs: pd.DataFrame) -> np.ndarray:
    runs = runs.sort_values("start")
    return np.repeat(runs["x"].to_numpy(float), runs["size"].to_numpy(np.int64))


def _weighted(n_boot: int, seed: int):
    def sums(runs: pd.DataFrame) -> pd.DataFrame:
        """Sums of weights and weighted values of a block, per replicate.  A group of one block
        has all its draws here."""
        x = _values(runs)
        g_no, n = int(runs["g_no"].iloc[0]), int(runs["n"].iloc[0])
        place = int(runs["start"].min()) + np.arange(len(x))
        mean = poisson_mean(n)
        draws, ones = Draws(seed, g_no, place[None, :]), np.ones(len(x))
        w, wx = np.zeros(n_boot, np.int64), np.zeros(n_boot)
        step = max(1, _STEP // len(x))
        for begin in range(0, n_boot, step):
            r = np.arange(begin, min(begin + step, n_boot))
            some = slice(begin, begin + len(r))
            if mean > 0:
                weights = poisson_weights(draws.unreduced(r[:, None]), mean).astype(np.float64)
                w[some] = weights @ ones
                wx[some] = weights @ x
            if n == len(x):
                missing = np.maximum(n - w[some], 0)
                for i in range(0, len(r), max(1, _STEP // (int(missing.max()) + 1))):
                    part = slice(i, i + max(1, _STEP // (int(missing.max()) + 1)))
                    j = np.arange(int(missing[part].max()))
                    at = positions(seed, g_no, r[part, None], j[None, :], n)
                    taken = np.where(j[None, :] < missing[part, None], x[at.astype(np.int64)], 0.0)
                    wx[r[part]] += taken.sum(axis=1)
                w[some] += missing
        g = runs["g"].iloc[0]
        return pd.DataFrame(
            {"g": [g] * n_boot, "g_no": g_no, "n": n, "r": np.arange(n_boot), "w": w, "wx": wx}
        )

    return sums


def _draws(seed: int, block: int):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The missing draws of replicates (g, g_no, n, r, w, ..), one row for those of a block
        that are made together: g, block, rs and places."""
        for batch in batches:
            names = batch.column(0)
            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            held: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
            size = 0
            for row, (g_no, n, r, w) in enumerate(zip(*columns, strict=True)):
                for begin in range(0, n - w, _BATCH):
                    j = np.arange(begin, min(begin + _BATCH, n - w))
                    at = positions(seed, g_no, np.uint64(r), j, n).astype(np.int64)
                    held.setdefault((g_no, n), []).append((row, np.full(len(j), r), at))
                    size += len(j)
                    if size > _BATCH:
                        yield from _by_block(names, held, block)
                        held, size = {}, 0
            yield from _by_block(names, held, block)

    return draw


def _by_block(names: pa.Array, held: dict, block: int) -> Iterator[pa.RecordBatch]:
    for parts in held.values():
        # Groups of one number and size are told apart by their first row's name.
        by_name: dict[object, list] = {}
        for part in parts:
            by_name.setdefault(names[part[0]].as_py(), []).append(part)
        for some in by_name.values():
            r = np.concatenate([p[1] for p in some])
            at = np.concatenate([p[2] for p in some])
            order = np.argsort(at // block, kind="stable")
            r, at = r[order], at[order]
            cuts = np.flatnonzero(np.append(True, np.diff(at // block) != 0))
            offsets = pa.array(np.append(cuts, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {
                    "g": names.take(pa.array([some[0][0]] * len(cuts))),
                    "block": pa.array(at[cuts] // block),
                    "rs": pa.ListArray.from_arrays(offsets, pa.array(r.astype(np.int32))),
                    "places": pa.ListArray.from_arrays(
                        offsets, pa.array((at % block).astype(np.int32))
                    ),
                }
            )


def _looked_up(draws: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Values at the drawn places of a block, summed per replicate."""
    if not len(draws) or not len(runs):
        # Without columns, since Arrow makes no array of an empty column of texts.
        return pd.DataFrame()
    taken = _values(runs)[np.concatenate(draws["places"].to_numpy())]
    r, code = np.unique(np.concatenate(draws["rs"].to_numpy()), return_inverse=True)
    return pd.DataFrame(
        {"g": [draws["g"].iloc[0]] * len(r), "r": r, "wx": np.bincount(code, taken)}
    )


def bootstrap_means(
    df: DataFrame,
    metric: str,
    group: str,
    n_boot: int = 2000,
    seed: int = 42,
    min_n: int = 3,
    alpha: float = 0.05,
) -> DataFrame:
    """Rows (group, mean, ci_low, ci_high, n, error_plus, error_minus), highest mean
    first, of the groups with ``min_n`` finite values; other values and NULL groups are left
    out.  One rule holds for groups of every size."""
    rows = df.where(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), F.col(metric).cast("double").alias("x")
    )
    kind = rows.schema["g"].dataType

    def schema(*fields: str) -> T.StructType:
        numbers_of = T.ArrayType(T.IntegerType())
        kinds = {"wx": T.DoubleType(), "g": kind, "rs": numbers_of, "places": numbers_of}
        return T.StructType(
            [T.StructField(f, kinds.get(f, T.LongType()), f in kinds) for f in fields]
        )

    counts = value_counts(rows, ["g"], "x")
    blocks = _blocks(counts, min_n)
    # A block costs its task work for every replicate, whatever its bytes, so the number of
    # tasks is given.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(tasks, "g", "block")
    sums = (
        dealt.groupBy("g", "block")
        .applyInPandas(_weighted(n_boot, seed), schema("g", "g_no", "n", "r", "w", "wx"))
        .where(F.col("g").isNotNull())
        .groupBy("g", "g_no", "n", "r")
        .agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))
    )
    # The weights are drawn once: both uses take all columns of the sums, whose numbers are not
    # nullable and whose groups are filtered above, so that no null filter of one use comes below
    # their exchange and Spark reuses it.
    short = sums.where("w < n").select("g", "g_no", "n", "r", "w", "wx")
    draws = short.repartition(tasks, "g", "r").mapInArrow(
        _draws(seed, BLOCK), schema("g", "block", "rs", "places")
    )
    # A block meets about 8 BLOCK / sqrt(n) draws of a replicate, 512 at most.
    added = (
        draws.repartition(tasks, "g", "block")
        .groupBy("g", "block")
        .cogroup(dealt.groupBy("g", "block"))
        .applyInPandas(_looked_up, schema("g", "r", "wx"))
    )
    none = F.lit(None).cast("long")
    means = (
        sums.select("g", "n", "r", "w", "wx")
        .unionByName(added.select("g", none.alias("n"), "r", none.alias("w"), "wx"))
        .groupBy("g", "r")
        .agg(F.when(F.max("w") >= 0, F.sum("wx") / F.max("n")).alias("m"))
    )
    # A group has n_boot means, so the in-memory percentile is bounded.
    cuts = F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    intervals = means.groupBy("g").agg(cuts.alias("cut"))
    sizes = (
        counts.groupBy("g")
        .agg(
            F.sum(COUNT).alias("n"),
            (F.sum(F.col(VALUE) * F.col(COUNT)) / F.sum(COUNT)).alias("mean"),
        )
        .where(F.col("n") >= min_n)
    )
    low, high = F.col("cut")[0], F.col("cut")[1]
    return (
        sizes.join(intervals, "g")
        .select(
            F.col("g").alias(group),
            "mean",
            low.alias("ci_low"),
            high.alias("ci_high"),
            "n",
            (high - F.col("mean")).alias("error_plus"),
            (F.col("mean") - low).alias("error_minus"),
        )
        .orderBy(F.col("mean").desc(), group)
    )


def bootstrap_ci(
    df: DataFrame,
    metric: str,
    n_boot: int = 1000,
    seed: int = 42,
    alpha: float = 0.05,
) -> DataFrame:
    """One row (mean, ci_low, ci_high): NULLs without values, the value three times
    for a single one."""
    rows = df.select(F.lit("all").alias("g"), F.col(metric).alias("x"))
    found = bootstrap_means(rows, "x", "g", n_boot, seed, 1, alpha)
    return found.agg(
        F.max("mean").alias("mean"),
        F.max("ci_low").alias("ci_low"),
        F.max("ci_high").alias("ci_high"),
    )
