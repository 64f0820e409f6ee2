"""Facts behind generated conclusions, as codes and numbers instead of prose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.describe import group_medians
from panelloom.operators.ranking import top_list, top_names
from panelloom.plans.order_stats import as_scalar, column_medians


@dataclass(frozen=True)
class PressureColumns:
    """Measures that the facts are about."""

    name: str = "country_name"
    group: str = "region"
    rate: str = "food_inflation_pct"
    growth: str = "income_growth_pct"
    gap: str = "food_affordability_gap_pct"
    share: str = "food_share_budget_pct"
    deprivation: str = "meal_deprivation_pct"
    income: str = "median_income_eur"
    cumulative: str = "cumulative_affordability_gap_pct"


def pressure_drivers(
    df: DataFrame, reference: DataFrame, names: PressureColumns, ids: Sequence[str]
) -> DataFrame:
    """Rows (*ids, fact, amount) for every entity at once.

    Facts compare a row with the medians of the reference frame; an entity
    without any fact gets ``no_single_driver``.
    """
    medians = as_scalar(column_medians(reference, [names.share, names.deprivation, names.income]))
    rows = df.withColumn("_med", medians)
    gap, share = F.col(names.gap), F.col(names.share)
    deprivation, income = F.col(names.deprivation), F.col(names.income)

    def fact(condition, code, amount):
        cell = F.struct(F.lit(code).alias("fact"), amount.cast("double").alias("amount"))
        return F.when(condition, cell)

    found = F.array_compact(
        F.array(
            fact(gap > 0, "gap_widened", gap),
            fact(gap <= 0, "gap_narrowed", F.abs(gap)),
            fact(share > F.col("_med")[names.share], "share_above_median", share),
            fact(
                deprivation > F.col("_med")[names.deprivation],
                "deprivation_above_median",
                deprivation,
            ),
            fact(income < F.col("_med")[names.income], "income_below_median", income),
        )
    )
    default = F.array(
        F.struct(
            F.lit("no_single_driver").alias("fact"), F.lit(None).cast("double").alias("amount")
        )
    )
    facts = F.when(F.size(found) > 0, found).otherwise(default)
    return rows.select(*ids, F.inline(facts))


def driver_measures(df: DataFrame, names: PressureColumns, ids: Sequence[str]) -> DataFrame:
    """Rows (*ids, metric, value, effect) of five measures, NULL values left out."""
    measures = [names.rate, names.growth, names.gap, names.share, names.deprivation]
    present = [m for m in measures if m in df.columns]
    values = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in present])
    long = values.unpivot(list(ids), present, "metric", "value")
    relief = ((F.col("metric") == names.growth) & (F.col("value") >= 0)) | (
        (F.col("metric") == names.gap) & (F.col("value") <= 0)
    )
    effect = F.when(relief, "relief").otherwise("pressure")
    return long.where(F.col("value").isNotNull()).withColumn("effect", effect)


def current_facts(df: DataFrame, names: PressureColumns) -> DataFrame:
    """One row about a cross-section: entities with a gap, how many positive, medians
    and the leading entities."""
    complete = df.where(F.col(names.gap).isNotNull())
    positive = complete.where(F.col(names.gap) > 0)
    medians = as_scalar(column_medians(complete, [names.gap, names.rate, names.growth]))
    row = complete.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(F.col(names.gap) > 0).alias("n_positive"),
    )
    return row.withColumns(
        {
            "median_gap": medians[names.gap],
            "median_rate": medians[names.rate],
            "median_growth": medians[names.growth],
            "top_gaps": top_list(positive, names.gap, names.name).scalar(),
            "top_deprivation": top_names(df, names.deprivation, names.name).scalar(),
            "top_share": top_names(df, names.share, names.name).scalar(),
        }
    )


def synthesis_code(current: DataFrame, cumulative: DataFrame, names: PressureColumns) -> DataFrame:
    """One row: 1 few positive gaps but a positive cumulative median, 2 few positive
    gaps, 3 broad pressure."""
    median = column_medians(cumulative, [names.cumulative]).scalar()
    row = current.where(F.col(names.gap).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(F.col(names.gap) > 0).alias("n_positive"),
    )
    row = row.withColumn("cumulative_median", median)
    quarter = F.floor(F.col("n_entities") * 0.25)
    few = (F.col("n_entities") > 0) & (
        F.col("n_positive") <= F.greatest(F.lit(3).cast("long"), quarter)
    )
    burdened = F.coalesce(F.col("cumulative_median") > 0, F.lit(False))
    code = F.when(few & burdened, 1).when(few, 2).otherwise(3)
    return row.withColumn("synthesis", code)


def cumulative_facts(df: DataFrame, names: PressureColumns) -> DataFrame:
    """One row about the endpoint comparison: median, extremes, extreme groups."""
    by_group = group_medians(df, names.group, names.cumulative)
    row = by_group.agg(
        F.min(F.struct((-F.col("median")).alias("o"), F.col(names.group).alias("g")))["g"].alias(
            "highest_group"
        ),
        F.min(F.struct(F.col("median").alias("o"), F.col(names.group).alias("g")))["g"].alias(
            "lowest_group"
        ),
    )
    return row.withColumns(
        {
            "median_gap": column_medians(df, [names.cumulative]).scalar(),
            "top_gaps": top_list(df, names.cumulative, names.name).scalar(),
            "bottom_gaps": top_list(
                df, names.cumulative, names.name, ascending=True
            ).scalar(),
        }
    )
