"""Principal components of standardised features.

One aggregation over the rows yields means, deviations and all correlations; the
eigenvectors of that features-by-features matrix are found on the driver, and the
scores are plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import flag


@dataclass(frozen=True)
class Components:
    scores: DataFrame
    loadings: DataFrame
    variance: DataFrame
    explained_variance_ratio: list[float]
    cumulative_variance: list[float]
    selected_k: int
    variance_threshold: float
    n: int
    imputed_rows_excluded: int
    features: list[str]


def imputed_in_any(df: DataFrame, features: Sequence[str]) -> Column:
    marked = F.lit(False)
    for f in features:
        if f"{f}_imputed" in df.columns:
            marked = marked | flag(F.col(f"{f}_imputed"))
    return marked


def complete_rows(df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Observed rows without a missing feature or id."""
    rows = df.where(~imputed_in_any(df, features)).dropna(subset=[*features, *ids])
    return rows.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])


def moment_row(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: n, mean and covariance (population) of every feature pair."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    aggregates += [F.avg(f).alias(f"mean_{i}") for i, f in enumerate(features)]
    for i, j in combinations_with_replacement(range(len(features)), 2):
        cell = F.covar_pop(features[i], features[j])
        aggregates.append(cell.alias(f"cov_{i}_{j}"))
    return rows.agg(*aggregates)


def fit_components(
    df: DataFrame,
    features: Sequence[str],
    ids: Sequence[str],
    n_components: int = 2,
    variance_threshold: float = 0.80,
) -> Components:
    """Fit on the rows with all features observed and present.

    Loadings are correlations of features with components (eigenvector times the
    root of the component's sample variance); each component's largest loading is
    positive.  A constant feature contributes nothing.
    """
    features = list(features)
    rows = complete_rows(df, features, ids)
    excluded = df.agg(F.count_if(imputed_in_any(df, features)).alias("x")).first()["x"]
    row = moment_row(rows, features).first()
    n, size = row["n"], len(features)
    if n < n_components + 5:
        raise ValueError(f"too few complete observations ({n}) for principal components")
    covariance = np.zeros((size, size))
    for i, j in combinations_with_replacement(range(size), 2):
        covariance[i, j] = covariance[j, i] = row[f"cov_{i}_{j}"]
    means = np.array([row[f"mean_{i}"] for i in range(size)])
    scale = np.sqrt(np.diag(covariance))
    scale[scale == 0.0] = 1.0
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    order = np.argsort(values)[::-1][: min(size, n)]
    values, vectors = np.clip(values[order], 0.0, None), vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(order))])
    ratios = values / values.sum()
    cumulative = np.cumsum(ratios)
    selected = int(min(np.searchsorted(cumulative, variance_threshold) + 1, len(ratios)))

    def score(c: int) -> Column:
        total = F.lit(0.0)
        for i, f in enumerate(features):
            weight = float(vectors[i, c] / scale[i])
            total = total + (F.col(f) - F.lit(float(means[i]))) * F.lit(weight)
        return total.alias(f"PC{c + 1}")

    scores = rows.select(*ids, *[score(c) for c in range(n_components)])
    loading = vectors * np.sqrt(values * n / (n - 1))
    spark = df.sparkSession
    names = [f"PC{c + 1}" for c in range(n_components)]
    loadings = spark.createDataFrame(
        [(f, *map(float, loading[i, :n_components])) for i, f in enumerate(features)],
        "feature string, " + ", ".join(f"{name} double" for name in names),
    )
    variance = spark.createDataFrame(
        [
            (c + 1, f"PC{c + 1}", float(r * 100), float(t * 100))
            for c, (r, t) in enumerate(zip(ratios, cumulative, strict=True))
        ],
        "component_no int, component string, variance_pct double, cumulative_pct double",
    )
    return Components(
        scores=scores,
        loadings=loadings,
        variance=variance,
        explained_variance_ratio=[float(r) for r in ratios],
        cumulative_variance=[float(c) for c in cumulative],
        selected_k=selected,
        variance_threshold=float(variance_threshold),
        n=n,
        imputed_rows_excluded=excluded,
        features=features,
    )
