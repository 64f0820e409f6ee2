"""Key checks and contracts (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators.quality import (
    contract_report,
    duplicate_keys,
    duplicate_sample,
    profile_columns,
    reconcile_flags,
)
from workloads.registry import query
from workloads.tables import GROWN_SQL, NATION, analytic_panel


@query(
    "q1_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicates(t):
    return duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "q1_duplicate_sample",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5""",
)
def sample_of_duplicates(t):
    return duplicate_sample(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


CONTRACT_SQL = """SELECT unnest([1, 2, 3, 4, 5]) AS check_no, '{name}' AS name,
  unnest(['min_rows', 'duplicate_keys', 'numeric_columns', 'infinite_values',
          'period_out_of_range']) AS check_name,
  unnest([n, dup, {numeric}, 0, outside])::BIGINT AS found,
  unnest([n >= {min_rows}, dup = 0, {numeric} >= 5, true, outside = 0]) AS passed
FROM ({counts})"""


@query(
    "q2_output_contract",
    f"WITH {GROWN_SQL} "
    + CONTRACT_SQL.format(
        name="nation_year",
        min_rows=1,
        numeric=9,
        counts="SELECT count(*) AS n, count(*) - count(DISTINCT (entity, period)) AS dup, "
        "count(*) FILTER (WHERE period NOT BETWEEN 1990 AND 2010) AS outside FROM indexed",
    ),
)
def output_contract(t):
    return contract_report(analytic_panel(t), NATION, NATION.key, "nation_year")


@query(
    "q2_broken_contract",
    CONTRACT_SQL.format(
        name="items",
        min_rows=1000000000,
        numeric=4,
        counts="SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dup,"
        " count(*) FILTER (WHERE year(l_shipdate) NOT BETWEEN 1990 AND 2010) AS outside "
        "FROM lineitem",
    ),
)
def broken_contract(t):
    items = t.read("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.year("l_shipdate").cast("int").alias("period"),
        "l_returnflag",
    )
    return contract_report(
        items, NATION, ["l_orderkey", "l_linenumber"], "items", min_rows=1_000_000_000
    )


@query(
    "q3_many_to_one_check",
    """SELECT c_nationkey, c_mktsegment, count(*) AS n_rows FROM customer GROUP BY 1, 2
HAVING count(*) > 1""",
)
def many_to_one_check(t):
    return duplicate_keys(t.read("customer"), ["c_nationkey", "c_mktsegment"])


@query(
    "q4_flag_reconciliation",
    f"""WITH {GROWN_SQL}
SELECT unnest(['level', 'rate', 'balance', 'share', 'growth', 'gap']) AS "column",
  unnest(s) AS imputed_count, unnest(s) AS flag_sum, true AS agrees
FROM (SELECT [count(*) FILTER (WHERE level_imputed), count(*) FILTER (WHERE rate_imputed),
  count(*) FILTER (WHERE balance_imputed), count(*) FILTER (WHERE share_imputed),
  count(*) FILTER (WHERE growth_imputed), count(*) FILTER (WHERE gap_imputed)] AS s FROM indexed)""",
)
def flag_reconciliation(t):
    panel = analytic_panel(t)
    return reconcile_flags(panel, profile_columns(panel, "nation_year", "after_etl"))
