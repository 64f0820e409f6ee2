"""Growth rates, gaps between rates, and chained indices along an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.cells import flag, ratio
from panelloom.plans.segments import OrderedPanel
from panelloom.spec import PanelSpec


def add_growth(df: DataFrame, spec: PanelSpec, level: str, growth: str) -> DataFrame:
    """Percent change against the entity's previous row (not previous period).

    With a ``<level>_imputed`` flag present, ``<growth>_imputed`` is set where
    either row was imputed.
    """
    level_flag = f"{level}_imputed"
    has_flag = level_flag in df.columns
    marked = flag(F.col(level_flag)) if has_flag else F.lit(False)
    cell = F.struct(F.col(level).cast("double").alias("value"), marked.alias("imputed"))
    panel = OrderedPanel(df, spec)
    nothing = F.lit(None).cast("struct<value:double,imputed:boolean>")

    def scan(earlier, _later, _all):
        return {"_carry": F.last("_final").over(earlier)}

    rows = panel.with_carries(
        panel.rows, [F.max_by(cell, spec.period).alias("_final")], scan, {"_carry": nothing}
    )
    rows = rows.withColumn("_prev", F.coalesce(F.lag(cell).over(panel.window), F.col("_carry")))
    prev = F.col("_prev")
    current = F.col(level).cast("double")
    rows = rows.withColumn(
        growth,
        F.when(
            current.isNotNull() & prev["value"].isNotNull(),
            ratio(current - prev["value"], prev["value"]) * 100,
        ),
    )
    if has_flag:
        rows = rows.withColumn(
            f"{growth}_imputed", marked | F.coalesce(prev["imputed"], F.lit(False))
        )
    added = [growth, f"{growth}_imputed"] if has_flag else [growth]
    return panel.finish(rows, [*df.columns, *added])


def add_gap(df: DataFrame, rate: str, growth: str, gap: str) -> DataFrame:
    """``rate - growth``, flagged where either side was imputed."""
    out = df.withColumn(gap, F.col(rate).cast("double") - F.col(growth).cast("double"))
    flags = [f"{rate}_imputed", f"{growth}_imputed"]
    if set(flags) <= set(df.columns):
        out = out.withColumn(f"{gap}_imputed", flag(F.col(flags[0])) | flag(F.col(flags[1])))
    return out


def add_category_gap(df: DataFrame, rate: str, growth: str, gap: str) -> DataFrame:
    """Category rate minus context growth; only the growth can be imputed."""
    out = df.withColumn(gap, F.col(rate) - F.col(growth))
    if f"{growth}_imputed" in df.columns:
        out = out.withColumn(f"{gap}_imputed", flag(F.col(f"{growth}_imputed")))
    return out


def add_chained_index(
    df: DataFrame, spec: PanelSpec, rate: str, index: str, base_period: int
) -> DataFrame:
    """Compound the rate from the first row on and scale the base period to 100.

    NULL rates count as zero.  Entities without a base row, or with base value
    zero, get NULL.
    """
    panel = OrderedPanel(df, spec)
    factor = F.lit(1.0) + F.coalesce(F.col(rate).cast("double"), F.lit(0.0)) / 100
    local = "_chain"
    rows = panel.rows.withColumn(local, F.product(factor).over(panel.up_to_row))
    at_base = F.max(F.when(F.col(spec.period) == base_period, F.col(local)))

    def scan(earlier, _later, entity):
        prefix = F.coalesce(F.product("_whole").over(earlier), F.lit(1.0))
        return {
            "_prefix": prefix,
            "_base": F.max(F.col("_prefix") * F.col("_base_here")).over(entity),
        }

    alone = {
        "_prefix": F.lit(1.0),
        "_base": at_base.over(Window.partitionBy(spec.entity)),
    }
    rows = panel.with_carries(
        rows,
        [F.product(factor).alias("_whole"), at_base.alias("_base_here")],
        scan,
        alone,
    )
    base: Column = F.when(F.col("_base") != 0, F.col("_base"))
    rows = rows.withColumn(index, F.col("_prefix") * F.col(local) / base * 100)
    return panel.finish(rows, [*df.columns, index])


def period_change(df: DataFrame, spec: PanelSpec, metric: str, name: str = "change") -> DataFrame:
    """Difference to the same entity at exactly one period earlier.

    Rows without such a partner, or with a NULL side, get NULL.  The earlier
    rows arrive by an equi-join on the shifted key.
    """
    earlier = df.select(
        spec.entity,
        (F.col(spec.period) + 1).cast(df.schema[spec.period].dataType).alias(spec.period),
        F.col(metric).alias("_earlier"),
    )
    joined = df.join(earlier, spec.key, "left")
    return joined.withColumn(name, F.col(metric) - F.col("_earlier")).drop("_earlier")


def compare_endpoints(
    df: DataFrame,
    spec: PanelSpec,
    index: str,
    level: str,
    start: int,
    end: int,
    carry: tuple[str, ...] = (),
    names: tuple[str, str, str] = ("index_growth_pct", "level_growth_pct", "cumulative_gap_pct"),
) -> DataFrame:
    """Growth of an index and of a level between two periods, and their difference.

    One conditional aggregation instead of a self-join; entities with a missing
    value or a base not above zero are left out.  ``carry`` columns are taken
    from the start row.
    """
    index_growth, level_growth, gap = names

    def at(period: int, c: str) -> Column:
        return F.max(F.when(F.col(spec.period) == period, F.col(c)))

    def start_row(c: str) -> Column:
        return F.first(F.when(F.col(spec.period) == start, F.col(c)), ignorenulls=True)

    rows = df.where(F.col(spec.period).isin(start, end))
    wide = rows.groupBy(spec.entity).agg(
        *[start_row(c).alias(c) for c in carry],
        at(start, index).alias("index_start"),
        at(end, index).alias("index_end"),
        at(start, level).alias("level_start"),
        at(end, level).alias("level_end"),
    )
    wide = wide.dropna(subset=["index_start", "index_end", "level_start", "level_end"])
    wide = wide.where((F.col("index_start") > 0) & (F.col("level_start") > 0))
    return wide.withColumns(
        {
            index_growth: (F.col("index_end") / F.col("index_start") - 1) * 100,
            level_growth: (F.col("level_end") / F.col("level_start") - 1) * 100,
        }
    ).withColumn(gap, F.col(index_growth) - F.col(level_growth))


def covers(period_range: tuple[int, int], start: int, end: int) -> bool:
    """Endpoint comparison is only meant for slices that hold both endpoints."""
    return period_range[0] <= start and period_range[1] >= end
