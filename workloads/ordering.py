"""Sorts, top-k and rankings (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators.ranking import (
    category_ranking,
    sorted_by,
    top_k,
    top_list,
    top_names,
    trend_rows,
)
from workloads.registry import query
from workloads.tables import GAPPY_SQL, GRID_SQL, NATION, PANEL_SQL


@query(
    "l1_total_sort",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_orderkey",
    "o_totalprice",
)
def total_sort(t):
    rows = t.read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sorted_by(rows, ["o_orderstatus", "o_orderkey"])


@query(
    "l2_top_one",
    f"""WITH {GAPPY_SQL} SELECT entity, level FROM gappy WHERE period = 2000
AND level IS NOT NULL ORDER BY level DESC, entity LIMIT 1""",
    "level",
    7,
)
def top_one(t):
    rows = t.gappy.where(F.col("period") == 2000).select("entity", "level")
    return top_k(rows, "level", 1, "entity")


@query(
    "l3_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "o_totalprice",
)
def top_orders(t):
    return top_k(t.read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15,
                 "o_orderkey")


@query(
    "l3_bottom_k",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 12",
    "c_acctbal",
)
def bottom_customers(t):
    rows = t.read("customer").select("c_custkey", "c_acctbal")
    return top_k(rows, "c_acctbal", 12, "c_custkey", ascending=True)


@query(
    "l3_preview",
    f"""WITH {PANEL_SQL}, {GRID_SQL}
SELECT period, category, entity, category_level FROM grid
ORDER BY period, category, entity LIMIT 500""",
    "category_level",
    7,
)
def preview(t):
    rows = t.grid.select("period", "category", "entity", "category_level")
    return sorted_by(rows, ["period", "category", "entity"]).limit(500)


@query(
    "l4_top_listing",
    f"""WITH {GAPPY_SQL}, best AS (
  SELECT entity, share FROM gappy WHERE period = 2000 AND share IS NOT NULL
  ORDER BY share DESC, entity LIMIT 3)
SELECT string_agg(printf('%s (%+.1f)', entity, share), ', ' ORDER BY share DESC, entity) AS listing
FROM best""",
)
def top_listing(t):
    return top_list(t.gappy.where(F.col("period") == 2000), "share", "entity", 3)


@query(
    "l4_bottom_names",
    f"""WITH {GAPPY_SQL}, best AS (
  SELECT entity, share FROM gappy WHERE period = 2000 AND share IS NOT NULL
  ORDER BY share, entity LIMIT 3)
SELECT string_agg(entity, ', ' ORDER BY share, entity) AS names FROM best""",
)
def bottom_names(t):
    rows = t.gappy.where(F.col("period") == 2000)
    return top_names(rows, "share", "entity", 3, ascending=True)


@query(
    "l5_category_ranking",
    f"""WITH {PANEL_SQL}, {GRID_SQL} SELECT entity, category_level FROM grid
WHERE period = 1999 AND category = 'BUILDING' AND category_level IS NOT NULL
ORDER BY category_level, entity""",
    "category_level",
    7,
)
def rank_category(t):
    rows = category_ranking(
        t.grid, NATION, 1999, "category", "BUILDING", "category_level", "entity"
    )
    return rows.select("entity", "category_level")


@query(
    "l6_trend_rows",
    f"""WITH {GAPPY_SQL} SELECT entity, period, rate FROM gappy
WHERE entity IN ('NATION_1', 'NATION_5', 'NATION_24')""",
    "rate",
    7,
)
def trend(t):
    return trend_rows(t.gappy, NATION, "rate", "entity", ["NATION_1", "NATION_5", "NATION_24"])
