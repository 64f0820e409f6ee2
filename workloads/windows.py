"""Ordered-series operators (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators.combine import (
    attach_context,
    attach_lookup,
    label_interpolated,
    pick_by_priority,
)
from panelloom.operators.gaps import complete_periods, exclude_incomplete, fill_gaps
from panelloom.operators.growth import (
    add_category_gap,
    add_chained_index,
    add_gap,
    add_growth,
    compare_endpoints,
)
from panelloom.plans.order_stats import average_ranks
from workloads.registry import query
from workloads.tables import (
    FILLED_SQL,
    GRID_SQL,
    GROWN_SQL,
    KEPT_SQL,
    NATION,
    USER_DAY,
    USER_DAYS_SQL,
    analytic_panel,
    fill_sql,
)


@query(
    "w1_strict_gap_fill",
    f"WITH {FILLED_SQL} SELECT entity, period, level, rate, level_imputed, rate_imputed "
    "FROM filled",
    "level rate",
    7,
)
def strict_gap_fill(t):
    filled = fill_gaps(t.gappy, NATION, strict=["level", "rate"])
    return filled.select("entity", "period", "level", "rate", "level_imputed", "rate_imputed")


@query(
    "w1_strict_gap_fill_segmented",
    f"WITH {USER_DAYS_SQL}, {fill_sql('user_days', ('clicks',), (), 'filled')} "
    "SELECT entity, period, clicks, clicks_imputed FROM filled",
    "clicks",
    9,
)
def strict_gap_fill_segmented(t):
    filled = fill_gaps(t.user_days, USER_DAY, strict=["clicks"])
    return filled.select("entity", "period", "clicks", "clicks_imputed")


@query(
    "w2_soft_gap_fill",
    f"WITH {FILLED_SQL} SELECT entity, period, balance, share, balance_imputed, share_imputed "
    "FROM filled",
    "balance share",
    7,
)
def soft_gap_fill(t):
    filled = fill_gaps(t.gappy, NATION, soft=["balance", "share"])
    return filled.select(
        "entity", "period", "balance", "share", "balance_imputed", "share_imputed"
    )


@query(
    "w2_soft_gap_fill_segmented",
    f"WITH {USER_DAYS_SQL}, {fill_sql('user_days', (), ('clicks',), 'filled')} "
    "SELECT entity, period, clicks, clicks_imputed FROM filled",
    "clicks",
    9,
)
def soft_gap_fill_segmented(t):
    filled = fill_gaps(t.user_days, USER_DAY, soft=["clicks"])
    return filled.select("entity", "period", "clicks", "clicks_imputed")


@query(
    "w2_fill_completed_calendar",
    f"""WITH {USER_DAYS_SQL},
calendar AS (
  SELECT entity, CAST(unnest(generate_series(min(period), max(period))) AS INTEGER) AS period
  FROM user_days GROUP BY entity
),
completed AS (
  SELECT entity, period, clicks FROM calendar LEFT JOIN user_days USING (entity, period)
),
{fill_sql('completed', (), ('clicks',), 'filled')}
SELECT entity, period, clicks, clicks_imputed FROM filled""",
    "clicks",
    9,
)
def fill_completed_calendar(t):
    completed = complete_periods(t.user_days.select("entity", "period", "clicks"), USER_DAY)
    return fill_gaps(completed, USER_DAY, soft=["clicks"])


@query(
    "w3_incomplete_row_exclusion",
    f"""WITH {KEPT_SQL}
SELECT entity, period,
       concat_ws(';', CASE WHEN level IS NULL THEN 'level' END,
                 CASE WHEN rate IS NULL THEN 'rate' END) AS missing_columns
FROM excluded""",
)
def incomplete_row_exclusion(t):
    filled = fill_gaps(t.gappy, NATION, strict=["level", "rate"])
    return exclude_incomplete(filled, NATION, ["level", "rate"])[1]


@query(
    "w3_complete_rows_kept",
    f"WITH {KEPT_SQL} SELECT entity, period, level, rate FROM kept",
    "level rate",
    7,
)
def complete_rows_kept(t):
    filled = fill_gaps(t.gappy, NATION, strict=["level", "rate"])
    kept, _ = exclude_incomplete(filled, NATION, ["level", "rate"])
    return kept.select("entity", "period", "level", "rate")


@query(
    "w4_growth_rate",
    f"WITH {GROWN_SQL} SELECT entity, period, growth FROM grown",
    "growth",
)
def growth_rate(t):
    filled = fill_gaps(t.gappy, NATION, strict=["level", "rate"])
    kept, _ = exclude_incomplete(filled, NATION, ["level", "rate"])
    return add_growth(kept, NATION, "level", "growth").select("entity", "period", "growth")


@query(
    "w4_growth_rate_segmented",
    f"""WITH {USER_DAYS_SQL}
SELECT entity, period, CASE WHEN prev <> 0 THEN (clicks - prev) / prev * 100
                            WHEN prev = 0 AND clicks > 0 THEN 'Infinity'::DOUBLE END AS growth
FROM (SELECT *, lag(clicks) OVER (PARTITION BY entity ORDER BY period) AS prev FROM user_days)""",
    "growth",
)
def growth_rate_segmented(t):
    return add_growth(t.user_days, USER_DAY, "clicks", "growth").select(
        "entity", "period", "growth"
    )


@query(
    "w5_growth_flag",
    f"WITH {GROWN_SQL} SELECT entity, period, level_imputed, growth_imputed FROM grown",
)
def growth_flag(t):
    filled = fill_gaps(t.gappy, NATION, strict=["level", "rate"])
    kept, _ = exclude_incomplete(filled, NATION, ["level", "rate"])
    return add_growth(kept, NATION, "level", "growth").select(
        "entity", "period", "level_imputed", "growth_imputed"
    )


@query(
    "w6_rate_gap",
    f"WITH {GROWN_SQL} SELECT entity, period, rate, growth, gap, gap_imputed FROM gapped",
    "rate growth gap",
)
def rate_gap(t):
    filled = fill_gaps(t.gappy, NATION, strict=["level", "rate"])
    kept, _ = exclude_incomplete(filled, NATION, ["level", "rate"])
    grown = add_growth(kept, NATION, "level", "growth")
    return add_gap(grown, "rate", "growth", "gap").select(
        "entity", "period", "rate", "growth", "gap", "gap_imputed"
    )


@query(
    "w7_chained_index",
    f"WITH {GROWN_SQL} SELECT entity, period, idx FROM indexed",
    "idx",
)
def chained_index(t):
    return analytic_panel(t).select("entity", "period", "idx")


@query(
    "w7_chained_index_segmented",
    f"""WITH {USER_DAYS_SQL},
chained AS (
  SELECT entity, period, product(1 + coalesce(clicks, 0) / 1000 / 100) OVER (
    PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM user_days
)
SELECT entity, period,
       c / max(CASE WHEN period = 15 THEN c END) OVER (PARTITION BY entity) * 100 AS idx
FROM chained""",
    "idx",
)
def chained_index_segmented(t):
    rates = t.user_days.withColumn("rate", F.col("clicks") / 1000)
    return add_chained_index(rates, USER_DAY, "rate", "idx", 15).select("entity", "period", "idx")


@query(
    "w8_category_gap",
    f"""WITH {GROWN_SQL}, {GRID_SQL}
SELECT entity, period, category, category_level, category_level - growth AS category_gap,
       growth_imputed AS category_gap_imputed
FROM grid JOIN grown USING (entity, period) WHERE category_level IS NOT NULL""",
    "category_level category_gap",
    7,
)
def category_gap(t):
    context = analytic_panel(t).select("entity", "period", "growth", "growth_imputed")
    observed = t.grid.where(F.col("category_level").isNotNull()).drop("nk")
    joined = attach_context(observed, context, ["entity", "period"])
    out = add_category_gap(joined, "category_level", "growth", "category_gap")
    return out.select(
        "entity", "period", "category", "category_level", "category_gap", "category_gap_imputed"
    )


PRIORITY_SQL = """parts AS (
  SELECT entity, period, level AS value, 'new' AS source, 0 AS priority FROM gappy
  WHERE period >= 1997
  UNION ALL
  SELECT entity, period, CASE WHEN nk % 4 <> 0 THEN balance END, 'old', 1 FROM gappy
)"""


def priority_parts(t):
    new = t.gappy.where(F.col("period") >= 1997).select(
        "entity",
        "period",
        F.col("level").alias("value"),
        F.lit("new").alias("source"),
        F.lit(0).alias("priority"),
    )
    old = t.gappy.select(
        "entity",
        "period",
        F.when(F.col("nk") % 4 != 0, F.col("balance")).alias("value"),
        F.lit("old").alias("source"),
        F.lit(1).alias("priority"),
    )
    return [new, old]


@query(
    "w9_source_priority",
    f"""WITH {FILLED_SQL}, {PRIORITY_SQL}
SELECT entity, period, value, CASE WHEN value IS NOT NULL THEN source END AS source
FROM (SELECT *, row_number() OVER (PARTITION BY entity, period
        ORDER BY (value IS NULL), priority) AS rn FROM parts) WHERE rn = 1""",
    "value",
    7,
)
def source_priority(t):
    return pick_by_priority(priority_parts(t), NATION, "value", "source", "priority")


@query(
    "w10_provenance_label",
    f"""WITH {FILLED_SQL}, {PRIORITY_SQL},
picked AS (
  SELECT entity, period, value, CASE WHEN value IS NOT NULL THEN source END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY entity, period
          ORDER BY (value IS NULL), priority) AS rn FROM parts) WHERE rn = 1
),
{fill_sql('picked', (), ('value',), 'labelled')}
SELECT entity, period, value, value_imputed,
       CASE WHEN value IS NOT NULL AND source IS NULL THEN 'interpolated' ELSE source END AS source
FROM labelled""",
    "value",
    7,
)
def provenance_label(t):
    picked = pick_by_priority(priority_parts(t), NATION, "value", "source", "priority")
    filled = fill_gaps(picked, NATION, soft=["value"])
    return label_interpolated(filled, "value", "source")


@query(
    "w11_endpoint_comparison",
    f"""WITH {GROWN_SQL},
ends AS (
  SELECT entity, max(grp) AS grp,
         max(idx) FILTER (WHERE period = 1998) AS index_start,
         max(idx) FILTER (WHERE period = 2001) AS index_end,
         max(level) FILTER (WHERE period = 1998) AS level_start,
         max(level) FILTER (WHERE period = 2001) AS level_end
  FROM indexed GROUP BY entity
)
SELECT *, (index_end / index_start - 1) * 100 AS index_growth_pct,
       (level_end / level_start - 1) * 100 AS level_growth_pct,
       (index_end / index_start - 1) * 100 - (level_end / level_start - 1) * 100
         AS cumulative_gap_pct
FROM ends
WHERE index_start > 0 AND level_start > 0 AND index_end IS NOT NULL AND level_end IS NOT NULL""",
    "index_start index_end level_start level_end index_growth_pct level_growth_pct "
    "cumulative_gap_pct",
    7,
)
def endpoint_comparison(t):
    return compare_endpoints(
        analytic_panel(t), NATION, "idx", "level", 1998, 2001, carry=("grp",)
    )


@query(
    "w12_average_ranks",
    """SELECT doc_id, lang, n_chars,
       rank() OVER (PARTITION BY lang ORDER BY n_chars)
         + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS avg_rank
FROM documents""",
    "avg_rank",
)
def average_ranks_by_language(t):
    docs = t.read("documents").select("doc_id", "lang", "n_chars")
    return average_ranks(docs, ["lang"], "n_chars", "avg_rank")


@query(
    "flagship_panel",
    f"""WITH {GROWN_SQL}
SELECT entity, grp, period, level, level_imputed, rate, rate_imputed, growth, growth_imputed,
       balance, balance_imputed, share, share_imputed, gap, gap_imputed, idx
FROM indexed ORDER BY entity, period""",
    "level rate growth balance share gap idx",
    7,
)
def flagship_panel(t):
    panel = analytic_panel(t).drop("grp", "nk")
    named = attach_lookup(panel, t.lookup.select("entity", "grp"), "entity")
    return named.select(
        "entity", "grp", "period", "level", "level_imputed", "rate", "rate_imputed", "growth",
        "growth_imputed", "balance", "balance_imputed", "share", "share_imputed", "gap",
        "gap_imputed", "idx",
    ).orderBy("entity", "period")
