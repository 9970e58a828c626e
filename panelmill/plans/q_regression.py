"""Queries for the fixed-effects panel regression."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.functions.special import two_sided_sql
from panelmill.operators import regression as R
from panelmill.plans.common import r, rounded
import panelmill.plans.q_joins  # noqa: F401  (registers the feature-panel CTEs)
from panelmill.plans.q_joins import feature_panel
from panelmill.plans.registry import query
from panelmill.session import materialize

XCOLS = R.regressors()


def reg_panel(spark, sf_dir):
    return R.prepare_panel(feature_panel(spark, sf_dir))


_lags = ", ".join(f"lag({c}, 7) OVER w AS {c}_lag7" for c in R.WEATHER_LAGGED)
_months = ", ".join(f"CASE WHEN month(date) = {m} THEN 1 ELSE 0 END AS month_{m}"
                    for m in range(2, 13))
B.register_cte("regp", f"""
  SELECT * FROM (
    SELECT commodity, market, date, price_modal, {_lags},
      lag(price_modal, 1) OVER w AS price_lag1, lag(price_modal, 7) OVER w AS price_lag7,
      CAST(date - (SELECT min(date) FROM fpanel) AS DOUBLE) AS time_trend, {_months}
    FROM fpanel WINDOW w AS (PARTITION BY commodity, market ORDER BY date))
  WHERE {' AND '.join(f'{c}_lag7 IS NOT NULL' for c in R.WEATHER_LAGGED)}
    AND price_lag1 IS NOT NULL AND price_lag7 IS NOT NULL""", ("fpanel",))
_dm = ", ".join(f"CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER e AS {c}_dm"
                for c in ["price_modal", *XCOLS])
B.register_cte("regdm", f"""SELECT commodity, market, {_dm} FROM regp
  WINDOW e AS (PARTITION BY commodity, market)""", ("regp",))

_slopes = " UNION ALL ".join(
    f"SELECT commodity, '{c}' AS variable, "
    f"CASE WHEN sum({c}_dm * {c}_dm) = 0 THEN NULL "
    f"ELSE sum({c}_dm * price_modal_dm) / sum({c}_dm * {c}_dm) END AS slope "
    f"FROM regdm GROUP BY commodity" for c in XCOLS)


@query("m10_within_slopes", B.sql_with("regdm") + f"""
  SELECT commodity, variable, {r('slope', 'slope')} FROM ({_slopes})""")
def m10_within_slopes(spark, sf_dir):
    """Within (market-demeaned) one-regressor slopes from the same moments as the full model."""
    return rounded(R.within_slopes(reg_panel(spark, sf_dir), XCOLS))


def _sweep_sql() -> str:
    """The whole estimator by hand: Gram matrix of demeaned rows, scaled, swept pivot by pivot, clustered errors."""
    k = len(XCOLS)
    dm = [f"{c}_dm" for c in [*XCOLS, "price_modal"]]
    products = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in dm) + "]" for a in dm)
    score = "+".join(f"a[i][{j}] * s[{j}]" for j in range(1, k + 1))
    names = ", ".join(f"'{c}'" for c in XCOLS)
    return B.sql_with("regdm").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
  , e AS (SELECT commodity, market, count(*) AS n, [{products}] AS m FROM regdm GROUP BY 1, 2),
  t AS (SELECT commodity, sum(n) AS n, count(*) AS g, [{", ".join("[" + ", ".join(f"sum(m[{i}][{j}])" for j in range(1, k + 2)) + "]" for i in range(1, k + 2))}] AS m
        FROM e GROUP BY 1),
  sweep AS (
    SELECT commodity, 1 AS p, list_transform(m, lambda row, i: list_transform(row, lambda v, j: v / sqrt(m[i][i] * m[j][j]))) AS a FROM t
    UNION ALL
    SELECT commodity, p + 1, list_transform(a, lambda row, i: list_transform(row, lambda v, j:
      CASE WHEN i = p AND j = p THEN 1 / a[p][p] WHEN i = p THEN v / a[p][p] WHEN j = p THEN -v / a[p][p]
           ELSE v - row[p] * a[p][j] / a[p][p] END)) FROM sweep WHERE p <= {k}),
  fit AS (SELECT commodity, n, g, m, list_transform(a, lambda row, i: list_transform(row, lambda v, j: v / sqrt(m[i][i] * m[j][j]))) AS a,
            list_transform(range(1, {k + 1}), lambda i: a[i][{k + 1}] * sqrt(m[{k + 1}][{k + 1}] / m[i][i])) AS b, a[{k + 1}][{k + 1}] AS rest
          FROM sweep JOIN t USING (commodity) WHERE p = {k + 1}),
  scores AS (SELECT commodity, fit.a, list_transform(range(1, {k + 1}), lambda i:
               e.m[i][{k + 1}] - list_sum(list_transform(range(1, {k + 1}), lambda j: e.m[i][j] * fit.b[j]))) AS s
             FROM e JOIN fit USING (commodity)),
  meat AS (SELECT commodity, i, sum(power({score}, 2)) AS z FROM scores, range(1, {k + 1}) r(i) GROUP BY 1, 2),
  w AS (SELECT commodity, [{names}][i] AS variable, b[i] AS coef, sqrt((g / (g - 1.0e0)) * ((n - 1.0e0) / (n - {k} - g)) * z) AS se,
          n, 1.0e0 - rest AS r2, 1.0e0 - rest * (n - g) / (n - {k}.0e0 - g) AS ar2 FROM fit JOIN meat USING (commodity))
  SELECT commodity, variable, {r('coef', 'coefficient')}, {r('se', 'std_error')}, {r(two_sided_sql('(coef / se)'), 'p_value')},
    CASE WHEN {two_sided_sql('(coef / se)')} < 0.001 THEN '***'
         WHEN {two_sided_sql('(coef / se)')} < 0.01 THEN '**'
         WHEN {two_sided_sql('(coef / se)')} < 0.05 THEN '*' ELSE '' END AS stars,
    CAST(n AS BIGINT) AS nobs, {r('r2', 'r2_within')}, {r('ar2', 'adj_r2_within')} FROM w"""


@query("m10_fe_regression", _sweep_sql())
def m10_fe_regression(spark, sf_dir):
    """Within estimator, market-clustered SEs, p-values and stars."""
    return rounded(R.fit_fixed_effects(reg_panel(spark, sf_dir), XCOLS))


@query("m10_normal_equations", B.sql_with("regp") + "SELECT commodity, variable, 0.0e0 AS score FROM "
       + "(SELECT DISTINCT commodity FROM regp), (VALUES "
       + ", ".join(f"('{c}')" for c in XCOLS) + ") v(variable)")
def m10_normal_equations(spark, sf_dir):
    """The full model's residuals, taken from the rows, are orthogonal to every demeaned regressor."""
    panel = materialize(reg_panel(spark, sf_dir))
    beta = (R.fit_fixed_effects(panel, XCOLS).groupBy("commodity").pivot("variable", XCOLS)
            .agg(F.first("coefficient")))
    beta = beta.select("commodity", *[F.coalesce(c, F.lit(0.0)).alias(f"b_{c}") for c in XCOLS])
    e = Window.partitionBy("commodity", "market")
    dm = panel.select("commodity", *[(F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(e)).alias(c)
                                     for c in ["price_modal", *XCOLS]]).join(beta, "commodity")
    u = F.col("price_modal")
    for c in XCOLS:
        u = u - F.col(c) * F.col(f"b_{c}")
    dm = dm.withColumn("u", u)
    sums = dm.groupBy("commodity").agg(
        F.sum(F.col("price_modal") ** 2).alias("yy"),
        *[F.sum(F.col(c) * F.col("u")).alias(f"s_{c}") for c in XCOLS],
        *[F.sum(F.col(c) ** 2).alias(f"q_{c}") for c in XCOLS])
    each = F.explode(F.array(*[F.struct(
        F.lit(c).alias("variable"),
        F.coalesce(F.try_divide(F.col(f"s_{c}"), F.sqrt(F.col(f"q_{c}") * F.col("yy"))), F.lit(0.0)).alias("score"))
        for c in XCOLS]))
    out = sums.select("commodity", each.alias("e")).select("commodity", "e.*")
    return out.withColumn("score", F.round(F.abs("score"), 6))


TWO = ["price_lag1", "price_lag7"]


@query("m10_two_regressors", B.sql_with("regdm") + f"""
  , d AS (SELECT commodity, market, price_lag1_dm AS x1, price_lag7_dm AS x2, price_modal_dm AS y FROM regdm),
  g AS (SELECT commodity, count(*) AS n, count(DISTINCT market) AS g, sum(x1 * x1) AS a, sum(x1 * x2) AS b,
          sum(x2 * x2) AS c, sum(x1 * y) AS p, sum(x2 * y) AS q, sum(y * y) AS yy FROM d GROUP BY 1),
  s AS (SELECT *, a * c - b * b AS det, (c * p - b * q) / (a * c - b * b) AS b1,
          (a * q - b * p) / (a * c - b * b) AS b2 FROM g),
  u AS (SELECT d.commodity, d.market, sum(x1 * (y - b1 * x1 - b2 * x2)) AS s1,
          sum(x2 * (y - b1 * x1 - b2 * x2)) AS s2, sum(power(y - b1 * x1 - b2 * x2, 2)) AS ssr
        FROM d JOIN s ON d.commodity = s.commodity GROUP BY 1, 2),
  m AS (SELECT commodity, sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22, sum(ssr) AS ssr
        FROM u GROUP BY 1),
  v AS (SELECT s.*, m.*  EXCLUDE (commodity), c / det AS i11, -b / det AS i12, a / det AS i22,
          (s.g / (s.g - 1.0e0)) * ((n - 1.0e0) / (n - 2.0e0 - s.g)) AS adj, 1.0e0 - ssr / yy AS r2
        FROM s JOIN m ON s.commodity = m.commodity),
  w AS (SELECT commodity, n, r2, 1.0e0 - (1.0e0 - r2) * (n - g) / (n - 2.0e0 - g) AS ar2,
          'price_lag1' AS variable, b1 AS coef,
          sqrt(adj * (i11 * (m11 * i11 + m12 * i12) + i12 * (m12 * i11 + m22 * i12))) AS se FROM v
        UNION ALL SELECT commodity, n, r2, 1.0e0 - (1.0e0 - r2) * (n - g) / (n - 2.0e0 - g), 'price_lag7', b2,
          sqrt(adj * (i12 * (m11 * i12 + m12 * i22) + i22 * (m12 * i12 + m22 * i22))) FROM v)
  SELECT commodity, variable, {r('coef', 'coefficient')}, {r('se', 'std_error')},
    {r(two_sided_sql('(coef / se)'), 'p_value')},
    CASE WHEN {two_sided_sql('(coef / se)')} < 0.001 THEN '***'
         WHEN {two_sided_sql('(coef / se)')} < 0.01 THEN '**'
         WHEN {two_sided_sql('(coef / se)')} < 0.05 THEN '*' ELSE '' END AS stars,
    CAST(n AS BIGINT) AS nobs, {r('r2', 'r2_within')}, {r('ar2', 'adj_r2_within')} FROM w""")
def m10_two_regressors(spark, sf_dir):
    """The same estimator with two regressors, against its closed form."""
    return rounded(R.fit_fixed_effects(reg_panel(spark, sf_dir), TWO))


@query("p10_month_dummies", B.sql_with("panel") + "SELECT market, date, "
       + ", ".join(f"CASE WHEN month(date) = {m} THEN 1 ELSE 0 END AS month_{m}"
                   for m in range(2, 13)) + " FROM panel")
def p10_month_dummies(spark, sf_dir):
    from panelmill.operators.selection import month_dummies
    df = B.market_panel(spark, sf_dir)
    return df.select("market", "date", *month_dummies(F.month("date")))


@query("p11_dense_codes", B.sql_with("panel") + """
  SELECT p.market, p.date, c.code FROM panel p JOIN (
    SELECT market, row_number() OVER (ORDER BY market) - 1 AS code
    FROM (SELECT DISTINCT market FROM panel)) c ON p.market = c.market""")
def p11_dense_codes(spark, sf_dir):
    from panelmill.operators.selection import dense_codes
    return dense_codes(B.market_panel(spark, sf_dir), "market").select("market", "date", "code")
