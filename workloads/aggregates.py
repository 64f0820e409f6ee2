"""Aggregates, profiles and chart data (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators.combine import stack
from panelloom.operators.describe import (
    box_points,
    box_stats,
    category_funnel,
    cross_section,
    describe_columns,
    endpoint_medians,
    grain_size,
    group_means,
    group_medians,
    histogram,
    histogram_bins,
    key_figures,
    period_pivot,
    run_summary,
    scale_range,
    scatter_rows,
    trend_line,
)
from panelloom.operators.gaps import exclude_incomplete, fill_gaps
from panelloom.operators.growth import compare_endpoints
from panelloom.operators.quality import profile_columns
from workloads.registry import query
from workloads.tables import (
    GAPPY_SQL,
    GRID_SQL,
    GROWN_SQL,
    HOLED_SQL,
    KEPT_SQL,
    NATION,
    USER_DAYS_SQL,
    YEARS,
    analytic_panel,
)


@query(
    "a1_group_means",
    f"WITH {GAPPY_SQL} SELECT grp, avg(level) AS mean FROM gappy GROUP BY grp",
    "mean",
    5,
)
def means_by_group(t):
    return group_means(t.gappy, "grp", "level")


@query(
    "a1_group_medians",
    "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1",
    "median",
)
def medians_by_group(t):
    return group_medians(t.read("lineitem"), "l_returnflag", "l_extendedprice")


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a2_descriptive_statistics",
    f"WITH {HOLED_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", avg({c}) AS mean,
       median({c}) AS median, stddev_samp({c}) AS std, quantile_cont({c}, 0.25) AS q1,
       quantile_cont({c}, 0.75) AS q3, min({c}) AS "min", max({c}) AS "max" FROM holed"""
        for c in DESCRIBED
    ),
    "mean median std q1 q3 min max",
    5,
)
def descriptive_statistics(t):
    return describe_columns(t.holed_items, NATION, DESCRIBED)


def profile_sql(source: str, columns: dict[str, str], view: str, stage: str) -> str:
    """Profile of ``source``; ``columns`` maps names to Spark type names."""
    parts = []
    for c, dtype in columns.items():
        flag = f"{c}_imputed"
        imputed = f"count(*) FILTER (WHERE {flag})" if flag in columns else "0::BIGINT"
        parts.append(
            f"""SELECT '{view}' AS view, '{stage}' AS stage, '{c}' AS "column",
  '{dtype}' AS dtype, count(*) AS row_count, count(*) - count("{c}") AS missing_count,
  (count(*) - count("{c}")) / CAST(count(*) AS DOUBLE) * 100 AS missing_pct,
  count(DISTINCT "{c}") AS unique_count, {imputed} AS imputed_count FROM {source}"""
        )
    return "\nUNION ALL ".join(parts)


FILLED_TYPES = {
    "entity": "string",
    "period": "int",
    "level": "double",
    "share": "double",
    "level_imputed": "boolean",
    "share_imputed": "boolean",
}
GAPPY_TYPES = {"entity": "string", "period": "int", "level": "double", "share": "double"}
GRID_TYPES = {
    "entity": "string",
    "period": "int",
    "category": "string",
    "category_level": "double",
}


@query(
    "a3_quality_profile",
    f"WITH {GROWN_SQL}, narrow AS (SELECT {', '.join(FILLED_TYPES)} FROM indexed) "
    + profile_sql("narrow", FILLED_TYPES, "nation_year", "after_etl"),
    "missing_pct",
)
def quality_profile(t):
    return profile_columns(analytic_panel(t).select(*FILLED_TYPES), "nation_year", "after_etl")


ITEM_TYPES = {
    "l_orderkey": "bigint",
    "l_linenumber": "int",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
}


@query(
    "a3_quality_profile_items",
    f"WITH {HOLED_SQL} " + profile_sql("holed", ITEM_TYPES, "items", "raw"),
    "missing_pct",
)
def quality_profile_items(t):
    return profile_columns(t.holed_items.select(*ITEM_TYPES), "items", "raw")


@query(
    "a3_profile_of_empty_table",
    """SELECT 'items' AS view, 'empty' AS stage, unnest(['l_orderkey', 'l_returnflag']) AS "column",
       unnest(['bigint', 'string']) AS dtype, 0::BIGINT AS row_count, 0::BIGINT AS missing_count,
       NULL::DOUBLE AS missing_pct, 0::BIGINT AS unique_count, 0::BIGINT AS imputed_count""",
    "missing_pct",
)
def profile_of_empty_table(t):
    nothing = t.read("lineitem").where(F.col("l_quantity") < 0)
    return profile_columns(nothing.select("l_orderkey", "l_returnflag"), "items", "empty")


@query(
    "a4_profiles_of_all_stages",
    f"WITH {GROWN_SQL}, {GRID_SQL}, narrow AS (SELECT {', '.join(FILLED_TYPES)} FROM indexed) "
    + profile_sql("gappy", GAPPY_TYPES, "nation_year", "before_missing_policy")
    + "\nUNION ALL "
    + profile_sql("narrow", FILLED_TYPES, "nation_year", "after_etl")
    + "\nUNION ALL "
    + profile_sql("grid", GRID_TYPES, "nation_year_category", "raw_grid_before_etl"),
    "missing_pct",
)
def profiles_of_all_stages(t):
    return stack(
        [
            profile_columns(
                t.gappy.select(*GAPPY_TYPES), "nation_year", "before_missing_policy"
            ),
            profile_columns(
                analytic_panel(t).select(*FILLED_TYPES), "nation_year", "after_etl"
            ),
            profile_columns(
                t.grid.select(*GRID_TYPES), "nation_year_category", "raw_grid_before_etl"
            ),
        ]
    )


@query(
    "a5_period_pivot",
    f"""WITH {GAPPY_SQL}
SELECT entity, {', '.join(f'avg(share) FILTER (WHERE period = {y}) AS "{y}"' for y in YEARS)},
       avg(share) AS row_mean
FROM gappy GROUP BY entity HAVING count(share) > 0""",
    " ".join(map(str, YEARS)) + " row_mean",
)
def pivot_by_period(t):
    return period_pivot(t.gappy, NATION, "entity", "share", YEARS)


@query(
    "a6_key_figures",
    f"""WITH {GROWN_SQL}
SELECT arg_max(entity, (gap, -nk)) FILTER (WHERE gap IS NOT NULL) AS top_gap_entity,
       max(gap) AS top_gap, avg(rate) AS mean_rate, avg(share) AS mean_reference_rate,
       arg_max(entity, (share, -nk)) FILTER (WHERE share IS NOT NULL) AS top_share_entity,
       max(share) AS top_share, avg(rate) - avg(share) AS rate_difference,
       median(gap) AS median_gap
FROM indexed WHERE period = 2000""",
    "top_gap mean_rate mean_reference_rate top_share rate_difference median_gap",
)
def key_figure_row(t):
    latest = t.stored_analytic_panel.where(F.col("period") == 2000)
    return key_figures(latest, "entity", "gap", "share", "rate", "share")


@query(
    "a7_grain_size",
    f"""WITH {GROWN_SQL}, {GRID_SQL}
SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities,
       count(DISTINCT category) AS n_categories FROM grid""",
)
def grain_sizes(t):
    return grain_size(t.grid, {"n_entities": "entity", "n_categories": "category"})


@query(
    "a7_category_funnel",
    f"""WITH {GROWN_SQL}, {GRID_SQL}
SELECT count(*) AS raw_rows, count(*) - count(category_level) AS missing,
       count(category_level) AS observed,
       (SELECT count(*) FROM grid JOIN grown USING (entity, period)
        WHERE category_level IS NOT NULL) AS final_rows
FROM grid""",
)
def funnel(t):
    final = t.grid.where(F.col("category_level").isNotNull()).join(
        analytic_panel(t).select("entity", "period"), ["entity", "period"]
    )
    return category_funnel(t.grid, "category_level", final)


@query(
    "a8_run_summary",
    f"""WITH {KEPT_SQL}
SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, min(period) AS min_period,
       max(period) AS max_period, (SELECT count(*) FROM excluded) AS removed_rows FROM kept""",
)
def summary_of_run(t):
    filled = fill_gaps(t.gappy, NATION, strict=["level", "rate"])
    kept, excluded = exclude_incomplete(filled, NATION, ["level", "rate"])
    return run_summary(kept, NATION, excluded)


@query(
    "a9_robust_scale_range",
    f"""WITH {GROWN_SQL}, q AS (
  SELECT quantile_cont(growth, 0.05) AS lo, quantile_cont(growth, 0.95) AS hi FROM indexed)
SELECT CASE WHEN lo < 0 AND hi > 0 THEN -greatest(abs(lo), abs(hi)) ELSE lo END AS low,
       CASE WHEN lo < 0 AND hi > 0 THEN greatest(abs(lo), abs(hi)) ELSE hi END AS high FROM q""",
    "low high",
)
def robust_scale_range(t):
    return scale_range(t.stored_analytic_panel, "growth", robust=True, diverging=True)


@query(
    "a9_full_scale_range",
    "SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem",
    "low high",
)
def full_scale_range(t):
    return scale_range(t.read("lineitem"), "l_extendedprice")


@query(
    "a9_single_value_range",
    """SELECT x - abs(x) * 0.05::DOUBLE AS low, x + abs(x) * 0.05::DOUBLE AS high
FROM (SELECT DISTINCT l_quantity AS x FROM lineitem WHERE l_quantity = 7)""",
    "low high",
)
def single_value_range(t):
    return scale_range(t.read("lineitem").where(F.col("l_quantity") == 7), "l_quantity")


BINS_SQL = """SELECT count(*) AS n, min(x) AS low, max(x) AS high,
  CAST(ceil((max(x) - min(x)) / (2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25))
    / cbrt(count(*)::DOUBLE))) AS BIGINT) AS bins"""


@query(
    "a10_histogram_bins",
    f"{BINS_SQL} FROM (SELECT l_extendedprice AS x FROM lineitem)",
    "low high",
)
def bins_of_prices(t):
    return histogram_bins(t.read("lineitem"), "l_extendedprice")


@query(
    "a10_sturges_bins",
    """SELECT count(*) AS n, 5.0::DOUBLE AS low, 5.0::DOUBLE AS high,
  CAST(ceil(log2(count(*)) + 1) AS BIGINT) AS bins FROM lineitem WHERE l_quantity = 5""",
    "low high",
)
def sturges_bins(t):
    return histogram_bins(t.read("lineitem").where(F.col("l_quantity") == 5), "l_quantity")


@query(
    "a11_histogram",
    f"""WITH s AS ({BINS_SQL} FROM (SELECT value AS x FROM events))
SELECT CAST(least(floor((value - low) / (high - low) * bins) + 1, bins) AS BIGINT) AS bin,
       event_type, count(*) AS n_rows
FROM events, s GROUP BY ALL""",
)
def histogram_by_type(t):
    return histogram(t.read("events"), "value", "event_type")


@query(
    "a12_trend_line",
    """SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
       regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem""",
    "slope intercept",
    4,
)
def trend_of_price(t):
    return trend_line(t.read("lineitem"), "l_quantity", "l_extendedprice")


@query(
    "a13_scatter_rows",
    f"""WITH {GAPPY_SQL},
pairs AS (SELECT * FROM gappy WHERE level IS NOT NULL AND rate IS NOT NULL),
m AS (SELECT median(share) AS med FROM pairs)
SELECT entity, period, level, rate,
       round_even(greatest(coalesce(share, CASE WHEN med > 0 THEN med ELSE 1 END), 0.1::DOUBLE), 1)
         AS point_size
FROM pairs, m""",
    "level rate point_size",
    7,
)
def scatter(t):
    return scatter_rows(t.gappy, ["entity", "period"], "level", "rate", "share")


@query(
    "a14_valued_and_missing",
    f"""WITH {GAPPY_SQL} SELECT entity, share, share IS NOT NULL AS has_value
FROM gappy WHERE period = 1999""",
    "share",
    7,
)
def valued_and_missing(t):
    rows = cross_section(t.gappy, NATION, 1999, "share", "entity")
    return rows.select("entity", "share", "has_value")


@query(
    "a15_endpoint_medians",
    f"""WITH {GROWN_SQL},
ends AS (
  SELECT entity,
    (max(idx) FILTER (WHERE period = 2001) / max(idx) FILTER (WHERE period = 1998) - 1) * 100 AS a,
    (max(level) FILTER (WHERE period = 2001) / max(level) FILTER (WHERE period = 1998) - 1) * 100
      AS b
  FROM indexed GROUP BY entity)
SELECT median(a) AS index_growth_pct, median(b) AS level_growth_pct,
       median(a - b) AS cumulative_gap_pct
FROM ends WHERE a IS NOT NULL AND b IS NOT NULL""",
    "index_growth_pct level_growth_pct cumulative_gap_pct",
)
def medians_of_endpoints(t):
    summary = compare_endpoints(t.stored_analytic_panel, NATION, "idx", "level", 1998, 2001)
    return endpoint_medians(
        summary, ["index_growth_pct", "level_growth_pct", "cumulative_gap_pct"]
    )


@query(
    "a16_box_statistics",
    """SELECT event_type, count(*) AS n, min(value) AS low, quantile_cont(value, 0.25) AS q1,
       median(value) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high
FROM events GROUP BY event_type""",
    "low q1 median q3 high",
)
def box_statistics(t):
    return box_stats(t.read("events"), "event_type", "value")


@query(
    "a16_box_points",
    f"""WITH {USER_DAYS_SQL} SELECT period, entity, clicks FROM user_days
WHERE clicks IS NOT NULL""",
    "clicks",
    9,
)
def box_point_rows(t):
    return box_points(t.user_days, "period", "clicks", ["entity"])
