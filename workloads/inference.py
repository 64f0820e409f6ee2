"""Statistics operators (T).

The p-values of the oracles are worked out in SQL on their own: closed forms
where the degrees of freedom allow one, enumeration for the exact rank test, and
Simpson quadrature otherwise.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelloom.functions import normal
from panelloom.functions.resampling import (
    DRAW_STEP,
    GROUP_STEP,
    MODULUS,
    REPLICATE_STEP,
    SEED_STEP,
    SHIFT,
    TERMS,
)
from panelloom.functions.tails import (
    ROYSTON_A1,
    ROYSTON_A2,
    ROYSTON_GAMMA,
    ROYSTON_MEAN_SMALL,
    ROYSTON_SD_SMALL,
)
from panelloom.operators.bootstrap import bootstrap_ci, bootstrap_means
from panelloom.operators.components import complete_rows, fit_components
from panelloom.operators.correlation import (
    correlation_matrix,
    correlation_pairs,
    holm,
    pvalue_matrix,
    sample_sizes,
    significance_list,
)
from panelloom.operators.facts import (
    PressureColumns,
    cumulative_facts,
    current_facts,
    driver_measures,
    pressure_drivers,
    synthesis_code,
)
from panelloom.operators.gaps import mask_imputed
from panelloom.operators.group_tests import (
    anova,
    brown_forsythe,
    effect_label,
    kruskal_wallis,
    mann_whitney_pairs,
    mann_whitney_statistics,
    select_group_test,
    shapiro_by_group,
    shapiro_statistic,
    tukey_pairs,
    tukey_statistics,
    with_chi2_p_value,
    with_f_p_value,
)
from panelloom.operators.growth import compare_endpoints
from panelloom.operators.outliers import iqr_mask, iqr_outliers
from workloads.registry import query
from workloads.tables import GROWN_SQL, HOLED_SQL, NATION, PANEL_SQL

MEASURES = ["level", "balance", "rate", "share"]
ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def year(t, period: int = 1999):
    return t.stored_panel.where(F.col("period") == period)


YEAR_SQL = PANEL_SQL + ", y AS (SELECT * FROM panel WHERE period = 1999)"


# --- outliers -------------------------------------------------------------------

FENCES_SQL = """fences AS (
  SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM src
)"""


@query(
    "t1_iqr_outliers",
    f"""WITH src AS (SELECT event_id, value * value * value AS x FROM events), {FENCES_SQL}
SELECT event_id, x,
  CASE WHEN x < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - x) / (q3 - q1)
       ELSE (x - (q3 + 1.5 * (q3 - q1))) / (q3 - q1) END AS iqr_distance,
  q1 - 1.5 * (q3 - q1) AS iqr_lower, q3 + 1.5 * (q3 - q1) AS iqr_upper
FROM src, fences WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)
ORDER BY iqr_distance DESC, event_id LIMIT 10""",
    "x iqr_distance iqr_lower iqr_upper",
    4,
)
def outliers(t):
    v = F.col("value")
    rows = t.read("events").select("event_id", (v * v * v).alias("x"))
    return iqr_outliers(rows, "x", "event_id", 10)


@query(
    "t1_iqr_zero_spread",
    "SELECT o_orderkey, 1.0::DOUBLE AS x, 0.0::DOUBLE AS iqr_distance, 0.0::DOUBLE AS iqr_lower, "
    "0.0::DOUBLE AS iqr_upper FROM orders WHERE false",
    "x",
)
def outliers_of_constant(t):
    rows = t.read("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") == 0, 9.0).otherwise(1.0).alias("x")
    )
    return iqr_outliers(rows, "x", "o_orderkey")


@query(
    "t2_iqr_mask",
    f"""WITH src AS (SELECT c_custkey, c_acctbal AS x FROM customer), {FENCES_SQL}
SELECT c_custkey, x < q1 - 0.4::DOUBLE * (q3 - q1) OR x > q3 + 0.4::DOUBLE * (q3 - q1)
  AS is_outlier FROM src, fences""",
)
def outlier_mask(t):
    rows = t.read("customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return iqr_mask(rows, "x", 0.4).select("c_custkey", "is_outlier")


# --- correlation ----------------------------------------------------------------


def pairs_sql(source: str, columns: list[str], method: str) -> str:
    parts = []
    for a, b in combinations(columns, 2):
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        if method == "pearson":
            rows = f"SELECT {a} AS x, {b} AS y FROM {source} WHERE {both}"
        else:
            rows = (
                f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0"
                f"::DOUBLE AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1)"
                f" / 2.0::DOUBLE AS y FROM {source} WHERE {both}"
            )
        parts.append(
            f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) AS n, corr(x, y) AS r FROM ({rows})"
        )
    return "\nUNION ALL ".join(parts)


def matrix_sql(columns: list[str], value: str, diagonal: str) -> str:
    """Matrix from a CTE ``pairs`` and one diagonal expression per column."""
    cells = ", ".join(
        f"coalesce(max({value}) FILTER (WHERE var_a = v AND var_b = '{c}' "
        f"OR var_b = v AND var_a = '{c}'), max(CASE WHEN v = '{c}' THEN {diagonal} END)) AS {c}"
        for c in columns
    )
    names = ", ".join(f"'{c}'" for c in columns)
    return (
        f"SELECT v AS variable, {cells} FROM pairs, (SELECT unnest([{names}]) AS v) GROUP BY v"
    )


def theta_area(upper: str, power: str) -> str:
    """Simpson rule for the integral of cos(x)^power from 0 to ``upper``."""
    return (
        f"(SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
        f"* pow(cos({upper} * i / 2000.0::DOUBLE), {power})) * {upper} / 6000.0::DOUBLE "
        f"FROM (SELECT unnest(generate_series(0, 2000)) AS i))"
    )


CORRELATION_P = (
    "1 - " + theta_area("asin(abs(r))", "(n - 3)") + " / " + theta_area("(pi() / 2)", "(n - 3)")
)
HOLM_SQL = """least(1.0::DOUBLE, max(scaled) OVER (ORDER BY p_value, var_a, var_b
  ROWS UNBOUNDED PRECEDING))"""


def tested_sql(source: str, columns: list[str], method: str) -> str:
    return f"""pairs_1 AS ({pairs_sql(source, columns, method)}),
pairs_2 AS (SELECT *, {CORRELATION_P} AS p_value FROM pairs_1),
pairs_3 AS (
  SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, var_a, var_b) + 1) * p_value
    AS scaled FROM pairs_2
),
pairs AS (SELECT *, {HOLM_SQL} AS p_adj FROM pairs_3)"""


@query(
    "t3_pearson_pairs",
    f"WITH {HOLED_SQL} " + pairs_sql("holed", ITEM_COLUMNS, "pearson"),
    "r",
)
def pearson_of_items(t):
    return correlation_pairs(t.holed_items, ITEM_COLUMNS)


@query(
    "t3_spearman_pairs",
    f"WITH {HOLED_SQL} " + pairs_sql("holed", ITEM_COLUMNS, "spearman"),
    "r",
)
def spearman_of_items(t):
    return correlation_pairs(t.holed_items, ITEM_COLUMNS, "spearman")


@query(
    "t3_correlation_matrix",
    f"WITH {YEAR_SQL}, pairs AS ({pairs_sql('y', MEASURES, 'spearman')}) "
    + matrix_sql(MEASURES, "r", "1.0::DOUBLE"),
    " ".join(MEASURES),
)
def matrix_of_year(t):
    return correlation_matrix(year(t), MEASURES, "spearman")


@query(
    "t4_pvalue_matrix",
    f"WITH {YEAR_SQL}, {tested_sql('y', MEASURES, 'spearman')} "
    + matrix_sql(MEASURES, "p_adj", "0.0::DOUBLE"),
    " ".join(MEASURES),
)
def p_values_of_year(t):
    return pvalue_matrix(year(t), MEASURES, "spearman")


@query(
    "t5_significance_list",
    f"""WITH {YEAR_SQL}, {tested_sql('y', MEASURES, 'pearson')}
SELECT var_a, var_b, n, r, p_value, r * r AS r_squared, p_adj, p_adj < 0.05 AS significant_05
FROM pairs""",
    "r p_value r_squared p_adj",
)
def significant_pairs(t):
    return significance_list(year(t), MEASURES)


@query(
    "t6_holm",
    """WITH p AS (SELECT p_brand, count(*) FILTER (WHERE p_size <= 2) / count(*)::DOUBLE AS p_value
           FROM part GROUP BY p_brand),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, p_brand) + 1) * p_value
        AS scaled FROM p)
SELECT p_brand, p_value, least(1.0::DOUBLE, max(scaled) OVER (ORDER BY p_value, p_brand
  ROWS UNBOUNDED PRECEDING)) AS p_adj FROM s""",
    "p_value p_adj",
)
def holm_of_brands(t):
    share = F.count_if(F.col("p_size") <= 2) / F.count(F.lit(1))
    rows = t.read("part").groupBy("p_brand").agg(share.alias("p_value"))
    return holm(rows, "p_value")


@query(
    "t7_pairwise_sample_sizes",
    f"WITH {HOLED_SQL} SELECT unnest(["
    + ", ".join(f"'{c}'" for c in ITEM_COLUMNS)
    + "]) AS variable, "
    + ", ".join(
        "unnest(["
        + ", ".join(
            f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a in ITEM_COLUMNS
        )
        + f"]) AS {b}"
        for b in ITEM_COLUMNS
    )
    + " FROM holed",
)
def pair_sizes(t):
    return sample_sizes(t.holed_items, ITEM_COLUMNS)


# --- group tests ----------------------------------------------------------------


def poly_sql(coefficients, x: str) -> str:
    return "(" + " + ".join(f"{c!r}::DOUBLE * pow({x}, {i})" for i, c in enumerate(coefficients)) + ")"


def normal_quantile_sql(p: str) -> str:
    def fraction(num, den, x):
        return f"{poly_sql(num, x)} / {poly_sql(den, x)}"

    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"({p} - 0.5) * " + fraction(
        normal.CENTRE_NUM, normal.CENTRE_DEN, f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    )
    middle = fraction(normal.MIDDLE_NUM, normal.MIDDLE_DEN, f"({r} - 1.6)")
    return (
        f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {centre} "
        f"ELSE sign({p} - 0.5) * {middle} END"
    )


def normal_sf_sql(z: str) -> str:
    """Upper normal tail by Simpson's rule from 0."""
    return (
        f"(0.5 - (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
        f"* exp(-pow({z} * i / 2000.0::DOUBLE, 2) / 2)) * ({z}) / 6000.0::DOUBLE / sqrt(2 * pi()) "
        f"FROM (SELECT unnest(generate_series(0, 2000)) AS i)))"
    )


def shapiro_sql(
    source: str, group: str, metric: str, order: str, name: str, first: int | None = None
) -> str:
    """CTEs ending in ``name`` (group, n, w, note)."""
    expected = normal_quantile_sql("((i - 0.375::DOUBLE) / (m_n + 0.25::DOUBLE))")
    a1 = poly_sql(ROYSTON_A1, "u")
    a2 = poly_sql(ROYSTON_A2, "u")
    note = "CASE WHEN max(n) > 5000 THEN 'p is approximate above 5000 observations' ELSE '' END"
    if first is not None:
        note = f"CASE WHEN max(n) > {first} THEN 'First {first} observations used' ELSE '' END"
    return f"""{name}_0 AS (
  SELECT {group} AS g, {metric} AS x,
    row_number() OVER (PARTITION BY {group} ORDER BY {order}, {metric}) AS k,
    count(*) OVER (PARTITION BY {group}) AS n
  FROM {source} WHERE {metric} IS NOT NULL
),
{name}_1 AS (
  SELECT g, x, n, row_number() OVER (PARTITION BY g ORDER BY x) AS i,
         count(*) OVER (PARTITION BY g) AS m_n FROM {name}_0 {'' if first is None else f'WHERE k <= {first}'}
),
{name}_2 AS (SELECT *, {expected} AS m, 1 / sqrt(m_n::DOUBLE) AS u FROM {name}_1),
{name}_3 AS (
  SELECT *, sum(m * m) OVER (PARTITION BY g) AS mm,
    max(m) OVER (PARTITION BY g) AS m_last,
    max(CASE WHEN i = m_n - 1 THEN m END) OVER (PARTITION BY g) AS m_next FROM {name}_2
),
{name}_4 AS (
  SELECT *, {a1} + m_last / sqrt(mm) AS a1, {a2} + m_next / sqrt(mm) AS a2 FROM {name}_3
),
{name}_5 AS (
  SELECT *, CASE WHEN m_n <= 5 THEN sqrt((mm - 2 * m_last * m_last) / (1 - 2 * a1 * a1))
    ELSE sqrt((mm - 2 * m_last * m_last - 2 * m_next * m_next)
              / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS s FROM {name}_4
),
{name}_6 AS (
  SELECT *, CASE WHEN i = m_n THEN a1 WHEN i = 1 THEN -a1
    WHEN m_n > 5 AND i = m_n - 1 THEN a2 WHEN m_n > 5 AND i = 2 THEN -a2 ELSE m / s END AS a,
    avg(x) OVER (PARTITION BY g) AS mean FROM {name}_5
),
{name} AS (
  SELECT g, max(n) AS n, pow(sum(a * (x - mean)), 2) / sum(pow(x - mean, 2)) AS w,
    {note} AS note
  FROM {name}_6 GROUP BY g
)"""


def shapiro_small_p_sql(w: str, n: str) -> str:
    """p for 4 to 11 observations."""
    y = f"(-ln({poly_sql(ROYSTON_GAMMA, n)} - ln(1 - {w})))"
    z = f"(({y} - {poly_sql(ROYSTON_MEAN_SMALL, n)}) / exp({poly_sql(ROYSTON_SD_SMALL, n)}))"
    return normal_sf_sql(z)


SEQUENCE = "l_orderkey * 10 + l_linenumber"


@query(
    "t8_shapiro_statistic",
    f"""WITH {shapiro_sql('lineitem', 'l_returnflag', 'l_extendedprice', SEQUENCE, 'sw')}
SELECT g AS l_returnflag, n, w, note FROM sw""",
    "w",
)
def shapiro_of_items(t):
    return shapiro_statistic(t.read("lineitem"), "l_extendedprice", "l_returnflag")


@query(
    "t8_shapiro_first_rows",
    f"""WITH {shapiro_sql('lineitem', 'l_returnflag', 'l_extendedprice', SEQUENCE, 'sw', 5000)}
SELECT g AS l_returnflag, n, w, note FROM sw""",
    "w",
)
def shapiro_of_first_items(t):
    rows = t.read("lineitem").withColumn("seq", F.expr(SEQUENCE))
    return shapiro_statistic(rows, "l_extendedprice", "l_returnflag", "seq", first=5000)


@query(
    "t8_shapiro_by_group",
    f"""WITH {YEAR_SQL}, {shapiro_sql('y', 'grp', 'level', 'nk', 'sw')},
p AS (SELECT *, {shapiro_small_p_sql('w', 'n')} AS p_value FROM sw)
SELECT g AS grp, n, w, p_value, p_value >= 0.05 AS normal_05, note FROM p""",
    "w p_value",
)
def shapiro_of_year(t):
    return shapiro_by_group(year(t), "level", "grp", "nk")


def one_way_sql(source: str, group: str, metric: str, name: str) -> str:
    return f"""{name}_g AS (
  SELECT {group} AS g, count(*) AS n, avg({metric}) AS mean, var_pop({metric}) * count(*) AS ss
  FROM {source} WHERE {metric} IS NOT NULL GROUP BY 1 HAVING count(*) >= 2
),
{name}_t AS (SELECT sum(n * mean) / sum(n) AS grand FROM {name}_g),
{name} AS (
  SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n,
         sum(n * pow(mean - grand, 2)) AS ss_between, sum(ss) AS ss_within,
         sum(n * pow(mean - grand, 2)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*)))
           AS statistic
  FROM {name}_g, {name}_t
)"""


OMEGA = """greatest(0.0::DOUBLE, (ss_between - (k - 1) * (ss_within / (n - k)))
  / (ss_between + ss_within + ss_within / (n - k)))"""
# Closed form of the F tail for five groups (four numerator degrees of freedom).
F_TAIL = """pow((n - k) / ((n - k) + 4 * statistic), (n - k) / 2.0::DOUBLE)
  * (1 + (n - k) / 2.0::DOUBLE * (1 - (n - k) / ((n - k) + 4 * statistic)))"""
# Closed form of the chi-square tail for five groups (four degrees of freedom).
CHI2_TAIL = "exp(-statistic / 2) * (1 + statistic / 2)"
LEVENE_SOURCE = """{name}_m AS (SELECT {group} AS g, median({metric}) AS med FROM {source} GROUP BY 1),
{name}_s AS (SELECT g, abs({metric} - med) AS spread FROM {source}
  JOIN {name}_m ON {group} = g)"""


@query(
    "t9_brown_forsythe",
    "WITH "
    + LEVENE_SOURCE.format(name="bf", group="event_type", metric="value", source="events")
    + f", {one_way_sql('bf_s', 'g', 'spread', 'bf')} "
    f"SELECT k, n, statistic, {F_TAIL} AS p_value FROM bf",
    "statistic p_value",
    5,
)
def brown_forsythe_of_events(t):
    return with_f_p_value(brown_forsythe(t.read("events"), "value", "event_type"))


@query(
    "t10_one_way_anova",
    f"""WITH {one_way_sql('events', 'event_type', 'value', 'a')}
SELECT k, n, ss_between / 1000 AS ss_between, ss_within / 1000 AS ss_within, statistic,
       {OMEGA} AS omega_squared, {F_TAIL} AS p_value FROM a""",
    "ss_between ss_within statistic omega_squared p_value",
    5,
)
def anova_of_events(t):
    row = with_f_p_value(anova(t.read("events"), "value", "event_type"))
    return row.withColumns(
        {"ss_between": F.col("ss_between") / 1000, "ss_within": F.col("ss_within") / 1000}
    )


def kruskal_sql(source: str, group: str, metric: str, name: str) -> str:
    return f"""{name}_r AS (
  SELECT {group} AS g, {metric} AS x,
    rank() OVER (ORDER BY {metric}) + (count(*) OVER (PARTITION BY {metric}) - 1) / 2.0::DOUBLE
      AS r, count(*) OVER (PARTITION BY {metric}) AS t
  FROM {source}
),
{name}_g AS (SELECT g, count(*) AS n, sum(r) AS rs FROM {name}_r GROUP BY g),
{name}_t AS (SELECT sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS nn FROM {name}_r),
{name} AS (
  SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n,
    (12 / (max(nn) * (max(nn) + 1)) * sum(rs * rs / n) - 3 * (max(nn) + 1))
      / (1 - max(ties) / (pow(max(nn), 3) - max(nn))) AS statistic
  FROM {name}_g, {name}_t
)"""


EPSILON = "greatest(0.0::DOUBLE, (statistic - k + 1) / (n - k))"


@query(
    "t11_kruskal_wallis",
    f"""WITH {kruskal_sql('documents', 'lang', 'n_chars', 'kw')}
SELECT k, n, statistic, {EPSILON} AS epsilon_squared FROM kw""",
    "statistic epsilon_squared",
    5,
)
def kruskal_of_documents(t):
    return kruskal_wallis(t.read("documents"), "n_chars", "lang")


@query(
    "t11_kruskal_wallis_p",
    f"""WITH {kruskal_sql('events', 'event_type', 'value', 'kw')}
SELECT k, n, statistic, {EPSILON} AS epsilon_squared, {CHI2_TAIL} AS p_value FROM kw""",
    "statistic epsilon_squared p_value",
    5,
)
def kruskal_of_events(t):
    return with_chi2_p_value(kruskal_wallis(t.read("events"), "value", "event_type"))


def effect_label_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} < 0.01 THEN 'negligible' WHEN {value} < 0.06 THEN 'small' "
        f"WHEN {value} < 0.14 THEN 'medium' ELSE 'large' END"
    )


TEST_SQL = f"""WITH {YEAR_SQL}, {shapiro_sql('y', 'grp', '{metric}', 'nk', 'sw')},
{LEVENE_SOURCE.format(name='bf', group='grp', metric='{metric}', source='y')},
{one_way_sql('bf_s', 'g', 'spread', 'bf')},
{one_way_sql('y', 'grp', '{metric}', 'a')},
{kruskal_sql('y', 'grp', '{metric}', 'kw')},
checks AS (
  SELECT (SELECT min({shapiro_small_p_sql('w', 'n')}) >= 0.05 FROM sw) AS all_normal,
         (SELECT statistic FROM bf) AS levene_stat, (SELECT {F_TAIL} FROM bf) AS levene_p
),
chosen AS (
  SELECT 'anova' AS method, statistic, {F_TAIL} AS p_value, 'omega_squared' AS effect_name,
         {OMEGA} AS effect_size FROM a
  UNION ALL SELECT 'kruskal', statistic, {CHI2_TAIL}, 'epsilon_squared', {EPSILON} FROM kw
)
SELECT method, statistic, p_value, p_value < 0.05 AS reject_h0, effect_name, effect_size,
       {effect_label_sql('effect_size')} AS effect_label, levene_stat, levene_p, all_normal,
       levene_p >= 0.05 AS equal_variances
FROM chosen, checks
WHERE method = CASE WHEN all_normal AND levene_p >= 0.05 THEN 'anova' ELSE 'kruskal' END"""

DECISION_COLUMNS = [
    "method", "statistic", "p_value", "reject_h0", "effect_name", "effect_size",
    "effect_label", "levene_stat", "levene_p", "all_normal", "equal_variances",
]


def decide(t, metric: str):
    return select_group_test(year(t), metric, "grp", "nk")


for _metric in ("level", "balance", "rate", "share"):

    @query(
        f"t12_group_test_of_{_metric}",
        TEST_SQL.replace("{metric}", _metric),
        "statistic p_value effect_size levene_stat levene_p",
    )
    def group_test(t, metric=_metric):
        return decide(t, metric).decision.select(*DECISION_COLUMNS)


def shifted_sql() -> str:
    """The year with groups pushed apart, so that the omnibus test rejects."""
    return YEAR_SQL + ", z AS (SELECT entity, nk, grp, rate + nk % 5 * 40 AS v FROM y)"


def shifted(t):
    return year(t).select("entity", "nk", "grp", (F.col("rate") + F.col("nk") % 5 * 40).alias("v"))


@query(
    "t12_group_summary",
    f"""WITH {shifted_sql()}, {shapiro_sql('z', 'grp', 'v', 'nk', 'sw')},
{LEVENE_SOURCE.format(name='bf', group='grp', metric='v', source='z')},
{one_way_sql('bf_s', 'g', 'spread', 'bf')},
checks AS (
  SELECT (SELECT min({shapiro_small_p_sql('w', 'n')}) >= 0.05 FROM sw)
         AND (SELECT {F_TAIL} FROM bf) >= 0.05 AS normal
)
SELECT grp, CASE WHEN (SELECT normal FROM checks) THEN avg(v) ELSE median(v) END AS value
FROM z GROUP BY grp""",
    "value",
)
def summary_of_shifted(t):
    return select_group_test(shifted(t), "v", "grp", "nk").group_summary


@query("t12_posthoc_rows")
def posthoc_of_shifted(t):
    return select_group_test(shifted(t), "v", "grp", "nk").posthoc


@query("t12_posthoc_blocked", "SELECT NULL::VARCHAR AS pair WHERE false")
def posthoc_blocked(t):
    same = year(t).withColumn("v", (F.col("nk") % 25 / 5).cast("int").cast("double"))
    result = select_group_test(same, "v", "grp", "nk").posthoc
    first, second = result.columns[:2]
    return result.select(F.concat(first, F.lit("-"), second).alias("pair"))


MWU_SQL = """pairs AS (
  SELECT a.g AS group_A, b.g AS group_B FROM (SELECT DISTINCT g FROM src) a
  JOIN (SELECT DISTINCT g FROM src) b ON a.g < b.g
),
both_sides AS (
  SELECT group_A, group_B, g, x FROM pairs JOIN src ON g = group_A OR g = group_B
),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY group_A, group_B ORDER BY x)
    + (count(*) OVER (PARTITION BY group_A, group_B, x) - 1) / 2.0::DOUBLE AS r,
    count(*) OVER (PARTITION BY group_A, group_B, x)::DOUBLE AS t
  FROM both_sides
),
sides AS (
  SELECT group_A, group_B,
    count(*) FILTER (WHERE g = group_A) AS n_A, count(*) FILTER (WHERE g = group_B) AS n_B,
    avg(x) FILTER (WHERE g = group_A) AS mean_A, avg(x) FILTER (WHERE g = group_B) AS mean_B,
    median(x) FILTER (WHERE g = group_A) AS median_A,
    median(x) FILTER (WHERE g = group_B) AS median_B,
    sum(r) FILTER (WHERE g = group_A) AS ra, sum(t * t - 1) AS ties
  FROM ranked GROUP BY 1, 2
),
u AS (
  SELECT * EXCLUDE (ra), ra - n_A::DOUBLE * (n_A + 1) / 2 AS U,
    2 * (ra - n_A::DOUBLE * (n_A + 1) / 2) / (n_A::DOUBLE * n_B) - 1 AS cliffs_delta
  FROM sides WHERE n_A >= 3 AND n_B >= 3
)"""
DELTA_LABEL_SQL = """CASE WHEN abs(cliffs_delta) < 0.147 THEN 'negligible'
  WHEN abs(cliffs_delta) < 0.33 THEN 'small' WHEN abs(cliffs_delta) < 0.474 THEN 'medium'
  ELSE 'large' END"""


@query(
    "t13_mann_whitney_statistics",
    f"""WITH src AS (SELECT lang AS g, CAST(n_chars AS DOUBLE) AS x FROM documents), {MWU_SQL}
SELECT * FROM u""",
    "mean_A mean_B median_A median_B U ties cliffs_delta",
    5,
)
def rank_statistics_of_documents(t):
    return mann_whitney_statistics(t.read("documents"), "n_chars", "lang")


# All ways to place five of ten ranks: exact two-sided p for two groups of five.
# With ties the normal approximation applies.
TIED_P = f"""least(1.0::DOUBLE, 2 * {normal_sf_sql(
    '((greatest(U, 25 - U) - 13) / sqrt(25 / 12.0::DOUBLE * (11 - ties / 90)))')})"""
EXACT_P = """(SELECT least(1.0::DOUBLE, 2.0::DOUBLE * count(*) FILTER (
    WHERE place >= greatest(U, 25 - U)) / count(*)) FROM placements)"""
PLACEMENTS_SQL = """placements AS (
  SELECT sum(CASE WHEN (mask >> bit) & 1 = 1 THEN bit + 1 ELSE 0 END) - 15 AS place
  FROM (SELECT unnest(generate_series(0, 1023)) AS mask), (SELECT unnest(generate_series(0, 9)) AS bit)
  WHERE bit_count(mask) = 5 GROUP BY mask
)"""


@query(
    "t13_mann_whitney_pairs",
    f"""WITH {shifted_sql()}, src AS (SELECT grp AS g, v AS x FROM z), {MWU_SQL},
{PLACEMENTS_SQL},
p AS (SELECT *, CASE WHEN ties = 0 THEN {EXACT_P} ELSE {TIED_P} END AS p_value FROM u),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, group_A, group_B) + 1)
        * p_value AS scaled FROM p),
h AS (SELECT *, least(1.0::DOUBLE, max(scaled) OVER (ORDER BY p_value, group_A, group_B
        ROWS UNBOUNDED PRECEDING)) AS p_adj FROM s)
SELECT group_A, group_B, n_A, n_B, mean_A, mean_B, median_A, median_B, U, p_value, cliffs_delta,
       p_adj, {DELTA_LABEL_SQL} AS effect_size, p_adj < 0.05 AS significant_05 FROM h""",
    "mean_A mean_B median_A median_B U p_value cliffs_delta p_adj",
)
def rank_tests_of_year(t):
    return mann_whitney_pairs(shifted(t), "v", "grp")


@query(
    "t14_tukey_statistics",
    """WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS mean,
                  var_pop(value) * count(*) AS ss FROM events GROUP BY 1),
e AS (SELECT sum(ss) / (sum(n) - count(*)) AS mse, count(*) AS k,
             CAST(sum(n) - count(*) AS BIGINT) AS df FROM m)
SELECT a.g AS group1, b.g AS group2, b.mean - a.mean AS meandiff,
       sqrt(mse / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS std_error, k, df
FROM m a JOIN m b ON a.g < b.g, e""",
    "meandiff std_error",
)
def tukey_of_events(t):
    return tukey_statistics(t.read("events"), "value", "event_type")


# The normal distribution on a fine grid (trapezoid sums with end correction), a
# Taylor step to the point in between, and Simpson sums over both integrals of the
# studentised range.
STEP = "0.0025::DOUBLE"
SIMPSON = "(CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
RANGE_TAIL_SQL = f"""bell AS (
  SELECT i, i * {STEP} AS z, exp(-pow(i * {STEP}, 2) / 2) / sqrt(2 * pi()) AS f
  FROM (SELECT unnest(generate_series(-4800, 4800)) AS i)
),
cdf AS (SELECT i, z, f, {STEP} * (sum(f) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - f / 2)
  + pow({STEP}, 2) / 12 * z * f AS c FROM bell),
zs AS (SELECT -8.5::DOUBLE + 17 * i / 200.0::DOUBLE AS z, {SIMPSON} * 17 / 600.0::DOUBLE AS wz
  FROM (SELECT unnest(generate_series(0, 200)) AS i)),
zc AS (SELECT zs.z, wz * f AS weight, c + f * (zs.z - cdf.z) AS upper
  FROM zs JOIN cdf ON cdf.i = CAST(round(zs.z / {STEP}) AS BIGINT)),
bounds AS (
  SELECT DISTINCT df, greatest(1e-9::DOUBLE, 1 - 10 / sqrt(2 * df::DOUBLE)) AS lo,
         1 + 10 / sqrt(2 * df::DOUBLE) + 2 / df::DOUBLE AS hi FROM tukey
),
ss AS (
  SELECT df, lo + (hi - lo) * i / 200.0::DOUBLE AS s, {SIMPSON} * (hi - lo) / 600.0::DOUBLE AS ws
  FROM bounds, (SELECT unnest(generate_series(0, 200)) AS i)
),
scale AS (
  SELECT df, s, ws * exp(ln(2) + df / 2.0::DOUBLE * ln(df / 2.0::DOUBLE)
    - lgamma(df / 2.0::DOUBLE) + (df - 1) * ln(s) - df * s * s / 2) AS ws FROM ss
),
nodes AS (
  SELECT group1, group2, k, ws, weight, upper,
         zc.z - abs(meandiff) / std_error * s AS x
  FROM tukey JOIN scale USING (df), zc
),
below AS (
  SELECT group1, group2, sum(ws * weight * k * pow(greatest(0.0::DOUBLE, upper
    - coalesce(c + f * (x - z) - z * f * pow(x - z, 2) / 2, 0)), k - 1)) AS p
  FROM nodes LEFT JOIN cdf ON i = CAST(round(x / {STEP}) AS BIGINT) GROUP BY 1, 2
)"""


@query(
    "t14_tukey_p_values",
    f"""WITH {shifted_sql()},
m AS (SELECT grp AS g, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS ss
      FROM z GROUP BY 1),
e AS (SELECT sum(ss) / (sum(n) - count(*)) AS mse, count(*) AS k,
             CAST(sum(n) - count(*) AS BIGINT) AS df FROM m),
tukey AS (SELECT a.g AS group1, b.g AS group2, b.mean - a.mean AS meandiff,
       sqrt(mse / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS std_error, k, df
  FROM m a JOIN m b ON a.g < b.g, e),
{RANGE_TAIL_SQL}
SELECT group1, group2, meandiff, greatest(0.0::DOUBLE, 1 - p) AS "p-adj", 1 - p < 0.05 AS reject
FROM tukey JOIN below USING (group1, group2)""",
    "meandiff p-adj",
    5,
)
def tukey_p_of_year(t):
    rows = tukey_pairs(shifted(t), "v", "grp")
    return rows.select("group1", "group2", "meandiff", "p-adj", "reject")


@query("t14_tukey_pairs")
def tukey_of_year(t):
    return tukey_pairs(shifted(t), "v", "grp")


# --- bootstrap ------------------------------------------------------------------


def draw_sql(seed: int, g: str, r: str, j: str) -> str:
    def scramble(y: str) -> str:
        return f"(({y}) * ({y}) + {SHIFT}) % {MODULUS}"

    x = (
        f"({seed * SEED_STEP}::BIGINT + {g} * {GROUP_STEP} + {r} * {REPLICATE_STEP} "
        f"+ {j} * {DRAW_STEP}) % {MODULUS}"
    )
    first = scramble(f"({x})")
    second = scramble(f"(({first}) + {j}) % {MODULUS}")
    return scramble(f"(({second}) + {r}) % {MODULUS}")


def bootstrap_sql(source: str, n_boot: int, seed: int = 42, min_n: int = 3) -> str:
    """CTEs ending in ``ci`` from ``source`` (g, x): Poisson counts of every value, whose mean
    falls short of one by 8 / sqrt(n), and the draws missing to n one by one."""
    place = (
        f"({draw_sql(seed + 1, 'g_no', 'r', 'j')}) * {MODULUS}::BIGINT "
        f"+ ({draw_sql(seed + 2, 'g_no', 'r', 'j')})"
    )
    return f"""rows_in AS (SELECT g, CAST(x AS DOUBLE) AS x FROM {source}
  WHERE x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))),
sizes AS (
  SELECT g, count(*) AS n, avg(x) AS mean,
         CAST('0x' || substr(md5(CAST(g AS VARCHAR)), 1, 7) AS BIGINT) AS g_no,
         greatest(0.0, 1.0 - 8.0 / sqrt(count(*)::DOUBLE))::DOUBLE AS lam
  FROM rows_in WHERE g IS NOT NULL GROUP BY g HAVING count(*) >= {min_n}
),
terms AS (
  SELECT g, k, exp(-lam) * CASE WHEN k = 0 THEN 1.0 ELSE pow(lam, k) END / factorial(k::INTEGER)::DOUBLE AS p
  FROM sizes, (SELECT unnest(range(0, {TERMS})) AS k)
),
limits AS (
  SELECT g, list(t ORDER BY k) AS limits
  FROM (SELECT g, k, floor(sum(p) OVER (PARTITION BY g ORDER BY k) * {MODULUS})::BIGINT AS t FROM terms)
  GROUP BY g
),
replicates AS (SELECT CAST(unnest(generate_series(0, {n_boot - 1})) AS BIGINT) AS r),
numbered AS (
  SELECT g, g_no, n, x, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS k
  FROM rows_in JOIN sizes USING (g)
),
counted AS (
  SELECT g, r, x, CASE WHEN n <= 64 THEN 0 ELSE {" + ".join(
      f"(d >= limits[{i}])::INTEGER" for i in range(1, TERMS + 1)
  )} END AS w
  FROM (SELECT g, n, r, x, {draw_sql(seed, 'g_no', 'r', 'k')} AS d FROM numbered, replicates)
  JOIN limits USING (g)
),
sums AS (SELECT g, r, sum(w) AS w, sum(w * x) AS wx FROM counted GROUP BY 1, 2),
missing AS (
  SELECT g, r, g_no, n, CAST(unnest(range(0, CAST(n - w AS BIGINT))) AS BIGINT) AS j
  FROM sums JOIN sizes USING (g)
),
more AS (
  SELECT m.g, m.r, sum(x) AS wx FROM (SELECT g, r, ({place}) % n AS k FROM missing) m
  JOIN numbered USING (g, k) GROUP BY 1, 2
),
means AS (
  SELECT s.g, s.r, (s.wx + coalesce(m.wx, 0)) / z.n AS m
  FROM sums s JOIN sizes z USING (g) LEFT JOIN more m ON m.g = s.g AND m.r = s.r
),
ci AS (
  SELECT g, max(mean) AS mean, quantile_cont(m, 0.025) AS ci_low,
         quantile_cont(m, 0.975) AS ci_high, max(n) AS n
  FROM means JOIN sizes USING (g) GROUP BY g
)"""


CI_COLUMNS = "mean, ci_low, ci_high, n, ci_high - mean AS error_plus, mean - ci_low AS error_minus"


@query(
    "t15_bootstrap_group_means",
    f"""WITH {YEAR_SQL}, src AS (SELECT grp AS g, rate AS x FROM y),
{bootstrap_sql('src', 2000)} SELECT g AS grp, {CI_COLUMNS} FROM ci""",
    "mean ci_low ci_high error_plus error_minus",
)
def bootstrap_of_year(t):
    return bootstrap_means(year(t), "rate", "grp")


@query(
    "t15_bootstrap_large_groups",
    f"""WITH src AS (SELECT o_orderstatus AS g, o_totalprice AS x FROM orders),
{bootstrap_sql('src', 2000)} SELECT g AS o_orderstatus, {CI_COLUMNS} FROM ci""",
    "mean ci_low ci_high error_plus error_minus",
    4,
)
def bootstrap_of_orders(t):
    return bootstrap_means(t.read("orders"), "o_totalprice", "o_orderstatus")


@query(
    "t16_bootstrap_ci",
    f"""WITH {YEAR_SQL}, src AS (SELECT 'all' AS g, rate AS x FROM y),
{bootstrap_sql('src', 1000, min_n=1)} SELECT mean, ci_low, ci_high FROM ci""",
    "mean ci_low ci_high",
)
def interval_of_year(t):
    return bootstrap_ci(year(t), "rate")


@query(
    "t16_bootstrap_ci_of_one",
    f"""WITH {YEAR_SQL} SELECT rate AS mean, rate AS ci_low, rate AS ci_high FROM y
WHERE entity = 'NATION_3'""",
    "mean ci_low ci_high",
)
def interval_of_one(t):
    return bootstrap_ci(year(t).where(F.col("entity") == "NATION_3"), "rate")


# --- principal components -------------------------------------------------------


@query(
    "t17_explained_variance",
    f"""WITH {GROWN_SQL},
c AS (SELECT level AS a, rate AS b, share AS d FROM indexed
      WHERE NOT level_imputed AND NOT rate_imputed AND NOT share_imputed AND share IS NOT NULL),
r AS (SELECT corr(a, b) AS x, corr(a, d) AS y, corr(b, d) AS z FROM c),
-- Eigenvalues of a 3x3 correlation matrix in trigonometric form.
p AS (SELECT sqrt((x * x + y * y + z * z) / 3) AS p, x * y * z AS det FROM r),
e AS (SELECT unnest([1, 2, 3]) AS component_no,
  unnest([1 + 2 * p * cos(acos(det / pow(p, 3)) / 3),
          1 + 2 * p * cos(acos(det / pow(p, 3)) / 3 + 4 * pi() / 3),
          1 + 2 * p * cos(acos(det / pow(p, 3)) / 3 + 2 * pi() / 3)]) AS value FROM p)
SELECT component_no, 'PC' || component_no AS component, value / 3 * 100 AS variance_pct,
       sum(value) OVER (ORDER BY component_no) / 3 * 100 AS cumulative_pct FROM e""",
    "variance_pct cumulative_pct",
)
def explained_variance(t):
    ids = ["entity", "period", "grp"]
    return fit_components(t.stored_analytic_panel, ["level", "rate", "share"], ids).variance


TWO_SQL = f"""WITH {PANEL_SQL},
m AS (SELECT avg(level) AS ma, stddev_pop(level) AS sa, avg(rate) AS mb, stddev_pop(rate) AS sb,
             corr(level, rate) AS r, count(*) AS n FROM panel)"""


@query(
    "t17_component_scores",
    # Two standardised features: the components are their scaled sum and difference.
    f"""{TWO_SQL}
SELECT entity, period,
  abs(CASE WHEN r > 0 THEN (level - ma) / sa + (rate - mb) / sb
           ELSE (level - ma) / sa - (rate - mb) / sb END) / sqrt(2) AS "PC1",
  abs(CASE WHEN r > 0 THEN (level - ma) / sa - (rate - mb) / sb
           ELSE (level - ma) / sa + (rate - mb) / sb END) / sqrt(2) AS "PC2"
FROM panel, m""",
    "PC1 PC2",
)
def component_scores(t):
    fitted = fit_components(t.stored_panel, ["level", "rate"], ["entity", "period"])
    return fitted.scores.select(
        "entity", "period", F.abs("PC1").alias("PC1"), F.abs("PC2").alias("PC2")
    )


@query(
    "t17_component_loadings",
    f"""{TWO_SQL}
SELECT unnest(['level', 'rate']) AS feature,
       sqrt((1 + abs(r)) / 2 * n / (n - 1)) AS "PC1", sqrt((1 - abs(r)) / 2 * n / (n - 1)) AS "PC2"
FROM m""",
    "PC1 PC2",
)
def component_loadings(t):
    fitted = fit_components(t.stored_panel, ["level", "rate"], ["entity", "period"])
    return fitted.loadings.select(
        "feature", F.abs("PC1").alias("PC1"), F.abs("PC2").alias("PC2")
    )


@query("t17_components_of_items")
def components_of_items(t):
    return fit_components(t.holed_items, ITEM_COLUMNS, ["l_returnflag"], 3).variance


@query(
    "t17_eligible_rows",
    f"""WITH {GROWN_SQL} SELECT entity, period, level, share FROM indexed
WHERE NOT level_imputed AND NOT share_imputed AND share IS NOT NULL""",
    "level share",
    7,
)
def eligible_rows(t):
    return complete_rows(t.stored_analytic_panel, ["level", "share"], ["entity", "period"])


# --- facts ----------------------------------------------------------------------

NAMES = PressureColumns(
    name="entity",
    group="grp",
    rate="rate",
    growth="growth",
    gap="gap",
    share="share",
    deprivation="balance",
    income="level",
    cumulative="cumulative_gap_pct",
)
LATEST_SQL = GROWN_SQL + ", latest AS (SELECT * FROM indexed WHERE period = 2000)"


def latest(t):
    return t.stored_analytic_panel.where(F.col("period") == 2000)


@query(
    "t18_pressure_drivers",
    f"""WITH {LATEST_SQL},
m AS (SELECT median(share) AS s, median(balance) AS b, median(level) AS l FROM latest),
f AS (
  SELECT entity, 'gap_widened' AS fact, gap AS amount FROM latest WHERE gap > 0
  UNION ALL SELECT entity, 'gap_narrowed', abs(gap) FROM latest WHERE gap <= 0
  UNION ALL SELECT entity, 'share_above_median', share FROM latest, m WHERE share > s
  UNION ALL SELECT entity, 'deprivation_above_median', balance FROM latest, m WHERE balance > b
  UNION ALL SELECT entity, 'income_below_median', level FROM latest, m WHERE level < l
)
SELECT * FROM f UNION ALL
SELECT entity, 'no_single_driver', NULL FROM latest WHERE entity NOT IN (SELECT entity FROM f)""",
    "amount",
)
def drivers(t):
    return pressure_drivers(latest(t), latest(t), NAMES, ["entity"])


@query(
    "t18_driver_measures",
    f"""WITH {LATEST_SQL},
v AS (
  SELECT entity, 'rate' AS metric, rate AS value FROM latest
  UNION ALL SELECT entity, 'growth', growth FROM latest
  UNION ALL SELECT entity, 'gap', gap FROM latest
  UNION ALL SELECT entity, 'share', share FROM latest
  UNION ALL SELECT entity, 'balance', balance FROM latest
)
SELECT *, CASE WHEN metric = 'growth' AND value >= 0 OR metric = 'gap' AND value <= 0
               THEN 'relief' ELSE 'pressure' END AS effect FROM v WHERE value IS NOT NULL""",
    "value",
)
def measures_of_drivers(t):
    return driver_measures(latest(t), NAMES, ["entity"])


def listing_sql(source: str, c: str, order: str) -> str:
    return (
        f"(SELECT string_agg(printf('%s (%+.1f)', entity, {c}), ', ' ORDER BY {c} {order}, entity) "
        f"FROM (SELECT entity, {c} FROM {source} WHERE {c} IS NOT NULL "
        f"ORDER BY {c} {order}, entity LIMIT 3))"
    )


def names_sql(source: str, c: str) -> str:
    return (
        f"(SELECT string_agg(entity, ', ' ORDER BY {c} DESC, entity) "
        f"FROM (SELECT entity, {c} FROM {source} WHERE {c} IS NOT NULL "
        f"ORDER BY {c} DESC, entity LIMIT 3))"
    )


@query(
    "t19_current_facts",
    f"""WITH {LATEST_SQL}, whole AS (SELECT * FROM latest WHERE gap IS NOT NULL),
positive AS (SELECT * FROM whole WHERE gap > 0)
SELECT count(*) AS n_entities, count(*) FILTER (WHERE gap > 0) AS n_positive,
  median(gap) AS median_gap, median(rate) AS median_rate, median(growth) AS median_growth,
  {listing_sql('positive', 'gap', 'DESC')} AS top_gaps,
  {names_sql('latest', 'balance')} AS top_deprivation,
  {names_sql('latest', 'share')} AS top_share
FROM whole""",
    "median_gap median_rate median_growth",
)
def facts_of_latest(t):
    return current_facts(latest(t), NAMES)


ENDS_SQL = """ends AS (
  SELECT entity, max(grp) AS grp,
    (max(idx) FILTER (WHERE period = 2001) / max(idx) FILTER (WHERE period = 1998) - 1) * 100
    - (max(level) FILTER (WHERE period = 2001) / max(level) FILTER (WHERE period = 1998) - 1) * 100
      AS gap
  FROM indexed GROUP BY entity
), cum AS (SELECT * FROM ends WHERE gap IS NOT NULL)"""


def endpoints(t):
    return compare_endpoints(
        t.stored_analytic_panel, NATION, "idx", "level", 1998, 2001, carry=("grp",)
    )


@query(
    "t19_synthesis_code",
    f"""WITH {LATEST_SQL}, {ENDS_SQL},
n AS (SELECT count(gap) AS n_entities, count(*) FILTER (WHERE gap > 0) AS n_positive FROM latest),
c AS (SELECT median(gap) AS cumulative_median FROM cum)
SELECT n_entities, n_positive, cumulative_median,
  CAST(CASE WHEN n_entities > 0 AND n_positive <= greatest(3, floor(n_entities * 0.25))
       THEN CASE WHEN cumulative_median > 0 THEN 1 ELSE 2 END ELSE 3 END AS INTEGER) AS synthesis
FROM n, c""",
    "cumulative_median",
)
def synthesis(t):
    return synthesis_code(latest(t), endpoints(t), NAMES)


@query(
    "t20_cumulative_facts",
    f"""WITH {LATEST_SQL}, {ENDS_SQL},
g AS (SELECT grp, median(gap) AS med FROM cum GROUP BY grp)
SELECT (SELECT grp FROM g ORDER BY med DESC, grp LIMIT 1) AS highest_group,
  (SELECT grp FROM g ORDER BY med, grp LIMIT 1) AS lowest_group,
  (SELECT median(gap) FROM cum) AS median_gap,
  {listing_sql('cum', 'gap', 'DESC')} AS top_gaps,
  {listing_sql('cum', 'gap', 'ASC')} AS bottom_gaps""",
    "median_gap",
)
def facts_of_endpoints(t):
    return cumulative_facts(endpoints(t), NAMES)


@query(
    "t4_masked_spearman",
    f"""WITH {GROWN_SQL}, masked AS (
  SELECT CASE WHEN NOT level_imputed THEN level END AS level,
         CASE WHEN NOT rate_imputed THEN rate END AS rate,
         CASE WHEN NOT share_imputed THEN share END AS share,
         CASE WHEN NOT growth_imputed THEN growth END AS growth FROM indexed)
{pairs_sql('masked', ['level', 'rate', 'share', 'growth'], 'spearman')}""",
    "r",
)
def masked_spearman(t):
    columns = ["level", "rate", "share", "growth"]
    masked = mask_imputed(t.stored_analytic_panel, columns)
    return correlation_pairs(masked, columns, "spearman")


@query(
    "t10_effect_labels",
    f"""WITH g AS (SELECT p_type, count(*) FILTER (WHERE p_size < 3) / count(*)::DOUBLE AS v
           FROM part GROUP BY 1)
SELECT p_type, {effect_label_sql('v')} AS label FROM g""",
)
def labels_of_types(t):
    share = F.count_if(F.col("p_size") < 3) / F.count(F.lit(1))
    rows = t.read("part").groupBy("p_type").agg(share.alias("v"))
    return rows.select("p_type", effect_label(F.col("v")).alias("label"))
