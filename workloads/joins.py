"""Joins and set operations (J, U)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelloom.operators.combine import (
    attach_context,
    attach_lookup,
    first_per_key,
    keep_listed,
    merge_measures,
    merge_measures_by_join,
    stack,
    with_frame_statistics,
)
from panelloom.operators.group_tests import unordered_pairs
from panelloom.operators.growth import period_change
from panelloom.operators.slicing import listed
from panelloom.plans.order_stats import column_medians
from workloads.registry import query
from workloads.tables import GAPPY_SQL, GRID_SQL, NATION, PANEL_SQL

MERGE_SQL = f"""WITH {GAPPY_SQL},
a AS (SELECT entity, period, level FROM gappy WHERE level IS NOT NULL),
b AS (SELECT entity, period, rate FROM gappy WHERE rate IS NOT NULL AND period > 1995),
c AS (SELECT entity, period, share FROM gappy WHERE share IS NOT NULL)
SELECT entity, period, level, rate, share
FROM a FULL JOIN b USING (entity, period) FULL JOIN c USING (entity, period)"""


def merge_parts(t):
    return [
        t.gappy.select("entity", "period", m).where(F.col(m).isNotNull() & keep)
        for m, keep in (
            ("level", F.lit(True)),
            ("rate", F.col("period") > 1995),
            ("share", F.lit(True)),
        )
    ]


@query("j1_full_outer_merge", MERGE_SQL, "level rate share", 7)
def full_outer_merge(t):
    return merge_measures(merge_parts(t), NATION.key)


@query("j1_full_outer_join_chain", MERGE_SQL, "level rate share", 7)
def full_outer_join_chain(t):
    return merge_measures_by_join(merge_parts(t), NATION.key)


@query(
    "j2_left_lookup",
    f"""WITH {PANEL_SQL},
few AS (SELECT n_name AS entity, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name <> 'ASIA')
SELECT p.entity, p.period, p.level, few.grp FROM panel p LEFT JOIN few USING (entity)""",
    "level",
    7,
)
def left_lookup(t):
    few = t.lookup.where(F.col("grp") != "ASIA").select("entity", "grp")
    return attach_lookup(t.panel.select("entity", "period", "level"), few, "entity")


@query(
    "j3_many_to_one_inner",
    f"""WITH {PANEL_SQL}, {GRID_SQL}
SELECT entity, period, category, category_level, rate FROM grid
JOIN panel USING (entity, period) WHERE category_level IS NOT NULL""",
    "category_level rate",
    7,
)
def many_to_one_inner(t):
    observed = t.grid.where(F.col("category_level").isNotNull()).drop("nk")
    return attach_context(observed, t.panel.select("entity", "period", "rate"), NATION.key)


@query(
    "j4_period_self_join",
    f"""WITH {PANEL_SQL}
SELECT a.entity, a.level AS level_1996, b.level AS level_2000
FROM panel a JOIN panel b ON a.entity = b.entity AND a.period = 1996 AND b.period = 2000""",
    "level_1996 level_2000",
    7,
)
def period_self_join(t):
    rows = t.panel.where(F.col("period").isin(1996, 2000))
    wide = rows.groupBy("entity").agg(
        *[
            F.max(F.when(F.col("period") == y, F.col("level"))).alias(f"level_{y}")
            for y in (1996, 2000)
        ]
    )
    return wide.dropna()


@query(
    "j5_semi_join",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))""",
)
def semi_join(t):
    customers = t.read("customer").where(listed("c_mktsegment", ["BUILDING", "MACHINERY"]))
    keys = customers.select(F.col("c_custkey").alias("o_custkey"))
    return keep_listed(t.read("orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query(
    "j6_exact_prior_period",
    f"""WITH {GAPPY_SQL}
SELECT a.entity, a.period, a.level - b.level AS change
FROM gappy a LEFT JOIN gappy b ON a.entity = b.entity AND b.period = a.period - 1""",
    "change",
    7,
)
def exact_prior_period(t):
    changed = period_change(t.gappy, NATION, "level")
    return changed.select("entity", "period", "change")


@query(
    "j7_row_against_frame_statistic",
    """SELECT o_orderkey, m.median_price, o_totalprice > m.median_price AS above
FROM orders, (SELECT median(o_totalprice) AS median_price FROM orders) m""",
    "median_price",
)
def row_against_frame(t):
    orders = t.read("orders").select("o_orderkey", "o_totalprice")
    rows = with_frame_statistics(
        orders, column_medians(orders, ["o_totalprice"]), {"median_price": "o_totalprice"}
    )
    above = F.col("o_totalprice") > F.col("median_price")
    return rows.select("o_orderkey", "median_price", above.alias("above"))


@query(
    "j8_group_pairs",
    """WITH g AS (SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1)
SELECT a.name AS name_a, b.name AS name_b, a.n AS n_a, b.n AS n_b
FROM g a JOIN g b ON a.name < b.name""",
)
def group_pairs(t):
    groups = t.read("part").groupBy(F.col("p_type").alias("name"))
    pairs = unordered_pairs(groups.agg(F.count(F.lit(1)).alias("n")), "name")
    return pairs.select(
        F.col("a.name").alias("name_a"),
        F.col("b.name").alias("name_b"),
        F.col("a.n").alias("n_a"),
        F.col("b.n").alias("n_b"),
    )


@query(
    "j8_column_pairs",
    """SELECT unnest(['l_quantity', 'l_quantity', 'l_discount']) AS var_a,
       unnest(['l_discount', 'l_tax', 'l_tax']) AS var_b,
       unnest([sum(CAST(l_quantity > l_discount AS BIGINT)),
               sum(CAST(l_quantity > l_tax AS BIGINT)),
               sum(CAST(l_discount > l_tax AS BIGINT))])::BIGINT AS n_greater FROM lineitem""",
)
def column_pairs(t):
    cells = [
        F.struct(
            F.lit(a).alias("var_a"),
            F.lit(b).alias("var_b"),
            F.count_if(F.col(a) > F.col(b)).alias("n_greater"),
        )
        for a, b in combinations(["l_quantity", "l_discount", "l_tax"], 2)
    ]
    return t.read("lineitem").agg(F.array(*cells).alias("p")).select(F.inline("p"))


@query(
    "u1_union_all",
    """SELECT 'customer' AS kind, c_nationkey AS nk, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""",
    "balance",
)
def union_all(t):
    customer = t.read("customer").select(
        F.lit("customer").alias("kind"),
        F.col("c_nationkey").alias("nk"),
        F.col("c_acctbal").alias("balance"),
    )
    supplier = t.read("supplier").select(
        F.col("s_acctbal").alias("balance"),
        F.lit("supplier").alias("kind"),
        F.col("s_nationkey").alias("nk"),
    )
    return stack([customer, supplier])


@query("u2_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t):
    return t.read("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "u2_first_per_key",
    """SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1""",
)
def first_event(t):
    events = t.read("events").select("user_id", "ts", "event_id", "event_type")
    first = first_per_key(events, ["user_id"], ["ts", "event_id"])
    return first.select("user_id", "event_id", "event_type")
