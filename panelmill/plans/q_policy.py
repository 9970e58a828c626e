"""Queries for the policy tables.

Crop parameters per commodity come from the data: the forecast price is the
mean seasonal-naive forecast over the test days (G17), the current floor
is the latest policy-table price, and each commodity takes the reference's
elasticities and quantities of one of its two crops (its archetype, chosen
by a hash of the name).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.functions.welfare import num
from panelmill.operators import policy as V
from panelmill.operators.impute import impute_prices
from panelmill.operators.windows import series_window
from panelmill.params import (CONCAVITY_HIGH, CONCAVITY_LOW, CONCAVITY_POINTS, ELASTICITIES,
                              ETAS, FALLBACK_PRICE, FALLBACK_RMSE, PROCUREMENT, PRODUCTION, SCENARIOS, STRESS,
                              TEST_START, archetype_params)
from panelmill.plans import welfare_twin as T
from panelmill.plans.common import r, rounded
import panelmill.plans.q_joins  # noqa: F401  (registers the feature-panel CTEs)
from panelmill.plans.registry import query
from panelmill.session import materialize

CKEYS = ("commodity", "market")


def archetype(c):
    code = F.conv(F.substring(F.md5(c), 1, 2), 16, 10).cast("int")
    return F.when(code % 2 == 0, F.lit("wheat")).otherwise(F.lit("rice"))


def commodity_forecasts(spark, sf_dir, cube=None):
    """Mean seasonal-naive forecast and its RMSE per commodity over test days."""
    panel = impute_prices(B.commodity_panel(spark, sf_dir, cube), keys=CKEYS)
    w = series_window(CKEYS, "date")
    f = panel.select("commodity", "date", F.lag("price_modal", 7).over(w).alias("y_hat"),
                     F.lead("price_modal", 1).over(w).alias("y"))
    f = f.where((F.col("date") >= F.lit(TEST_START).cast("date")) & F.col("y_hat").isNotNull()
                & F.col("y").isNotNull())
    e = F.col("y") - F.col("y_hat")
    return f.groupBy("commodity").agg(F.avg("y_hat").alias("forecast_price"),
                                      F.sqrt(F.avg(e * e)).alias("rmse"))


def with_defaults(prices):
    """(commodity, forecast_price, rmse) with the archetype's fallback values where there is no forecast."""
    wheat = archetype(F.col("commodity")) == "wheat"
    pick = lambda table: F.when(wheat, F.lit(table["wheat"])).otherwise(F.lit(table["rice"]))
    return prices.select("commodity", F.coalesce("forecast_price", pick(FALLBACK_PRICE)).alias("forecast_price"),
                         F.coalesce("rmse", pick(FALLBACK_RMSE)).alias("rmse"),
                         F.col("forecast_price").isNull().alias("used_default"))


def crop_params(spark, sf_dir, checkpoint: bool = True, cube=None, fc=None):
    """One row per commodity; ``fc`` has forecast prices and RMSEs, by default the naive ones. Small but expensive (it scans the fact table), and
    reused by several branches of a plan, so it is materialised as a table in
    the shared ``spark.checkpoint.dir``."""
    if cube is None:
        cube = materialize(B.commodity_cube(spark, sf_dir))  # one fact pass for both inputs
    fc = fc if fc is not None else commodity_forecasts(spark, sf_dir, cube)
    cur = (B.policy(spark, sf_dir, cube).groupBy(F.col("crop").alias("commodity"))
           .agg(F.max_by("msp_rs_per_quintal", "year").alias("current_msp")))
    df = fc.join(cur, "commodity").withColumn("archetype", archetype(F.col("commodity")))
    ap = archetype_params(F.col("archetype"))
    out = df.select("commodity", F.col("forecast_price").alias("p"), "rmse", "current_msp",
                    "archetype", ap["eps_s"].alias("eps_s"), ap["eps_s_se"].alias("eps_s_se"),
                    ap["eps_d"].alias("eps_d"), ap["eps_d_se"].alias("eps_d_se"),
                    ap["q_proc"].alias("q_proc"), ap["q_total"].alias("q_total"))
    return materialize(out) if checkpoint else out


def _arch_case(table: dict) -> str:
    return f"CASE WHEN archetype = 'wheat' THEN {num(table['wheat'])} ELSE {num(table['rice'])} END"


B.register_cte("cfc", f"""
  SELECT commodity, avg(y_hat) AS forecast_price, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse
  FROM (SELECT commodity, date, lag(price_modal, 7) OVER w AS y_hat,
          lead(price_modal, 1) OVER w AS y
        FROM fp_imp WINDOW w AS (PARTITION BY commodity, market ORDER BY date))
  WHERE date >= DATE '{TEST_START}' AND y_hat IS NOT NULL AND y IS NOT NULL
  GROUP BY commodity""", ("fp_imp",))
B.register_cte("cparams", f"""
  SELECT commodity, p, rmse, current_msp, archetype,
    {_arch_case({k: v['supply'] for k, v in ELASTICITIES.items()})} AS eps_s,
    {_arch_case({k: v['supply_se'] for k, v in ELASTICITIES.items()})} AS eps_s_se,
    {_arch_case({k: v['demand'] for k, v in ELASTICITIES.items()})} AS eps_d,
    {_arch_case({k: v['demand_se'] for k, v in ELASTICITIES.items()})} AS eps_d_se,
    {_arch_case(PROCUREMENT)} AS q_proc, {_arch_case(PRODUCTION)} AS q_total
  FROM (SELECT f.commodity, f.forecast_price AS p, f.rmse, c.current_msp,
          CASE WHEN CAST(('0x' || substr(md5(f.commodity), 1, 2)) AS INTEGER) % 2 = 0
               THEN 'wheat' ELSE 'rice' END AS archetype
        FROM cfc f JOIN (SELECT crop, max_by(msp_rs_per_quintal, year) AS current_msp
                         FROM policy GROUP BY crop) c ON f.commodity = c.crop)""",
               ("cfc", "policy"))

EQ = [s for s in SCENARIOS if s[0] == "equal_weights"]
B.register_cte("cp_all", f"SELECT * FROM cparams, {V.weights_sql()}", ("cparams",))
B.register_cte("cp_eq", f"SELECT * FROM cparams, {V.weights_sql(EQ)}", ("cparams",))
B.register_cte("cp_opt", T.optimum("(SELECT *, 0.0e0 AS eta FROM cp_all)"), ("cp_all",))


@query("g17_forecast_price", B.sql_with("cfc") + f"""
  SELECT commodity, {r('forecast_price', 'forecast_price')}, {r('rmse', 'rmse')} FROM cfc""")
def g17_forecast_price(spark, sf_dir):
    return rounded(commodity_forecasts(spark, sf_dir))


_ARCH_T = "CAST(('0x' || substr(md5(t.commodity), 1, 2)) AS INTEGER) % 2 = 0"


@query("s9_default_prices", B.sql_with("cfc") + f"""
  SELECT t.commodity,
    {r(f"coalesce(f.forecast_price, CASE WHEN {_ARCH_T} THEN {num(FALLBACK_PRICE['wheat'])} ELSE {num(FALLBACK_PRICE['rice'])} END)", 'forecast_price')},
    {r(f"coalesce(f.rmse, CASE WHEN {_ARCH_T} THEN {num(FALLBACK_RMSE['wheat'])} ELSE {num(FALLBACK_RMSE['rice'])} END)", 'rmse')},
    f.forecast_price IS NULL AS used_default
  FROM (SELECT DISTINCT p_type AS commodity FROM part UNION SELECT lower(p_type) FROM part) t
  LEFT JOIN cfc f ON f.commodity = t.commodity""")
def s9_default_prices(spark, sf_dir):
    """Every known commodity gets a price and an RMSE; the archetype's fallback
    values where no forecast exists (here the lower-case names, which nothing is sold under)."""
    types = B.table(spark, sf_dir, "part", "p_type").select(
        F.explode(F.array("p_type", F.lower("p_type"))).alias("commodity")).distinct()
    return rounded(with_defaults(types.join(commodity_forecasts(spark, sf_dir), "commodity", "left")))


@query("v1_welfare_at_current", B.sql_with("cp_all") + f"""
  SELECT commodity, scenario, {r(T.welfare('current_msp'), 'welfare')}
  FROM (SELECT *, 0.0e0 AS eta FROM cp_all)""")
def v1_welfare_at_current(spark, sf_dir):
    df = V.with_weights(crop_params(spark, sf_dir)).withColumn("eta", F.lit(0.0))
    return rounded(V.welfare_at(df, "current_msp").select("commodity", "scenario", "welfare"))


_C = T.parts("current_msp", v2=True)


@query("v2_components", B.sql_with("cp_all") + f"""
  SELECT commodity, scenario, {', '.join(r(e, n) for n, e in _C.items())}
  FROM (SELECT *, 0.0e0 AS eta FROM cp_all)""")
def v2_components(spark, sf_dir):
    df = V.with_weights(crop_params(spark, sf_dir)).withColumn("eta", F.lit(0.0))
    return rounded(V.components_at(df, "current_msp").select("commodity", "scenario", *_C))


@query("v3_optimal_floor", B.sql_with("cp_opt") + f"""
  SELECT commodity, scenario, {r('m_star', 'm_star')}, {r('w_star', 'w_star')} FROM cp_opt""")
def v3_optimal_floor(spark, sf_dir):
    df = V.with_weights(crop_params(spark, sf_dir)).withColumn("eta", F.lit(0.0))
    return rounded(V.optimal_floor(df).select("commodity", "scenario", "m_star", "w_star"))


#: Weights with a deadweight-loss term, for which the optimum lies inside the search interval.
INTERIOR = [("interior_low", 0.6, 0.1, 0.1, 1.0), ("interior_high", 0.5, 0.05, 0.1, 0.6)]
B.register_cte("cp_int", f"SELECT * FROM cparams, {V.weights_sql(INTERIOR)}", ("cparams",))


@query("v3_interior_optima", B.sql_with("cp_int") + f"""
  SELECT commodity, scenario, {r('m_star', 'm_star')}, {r('w_star', 'w_star')},
    least(abs(m_star - p + 200), abs(m_star - p), abs(m_star - p - 1500)) > 1e-3 AS interior
  FROM ({T.optimum("(SELECT *, 0.0e0 AS eta FROM cp_int)")})""")
def v3_interior_optima(spark, sf_dir):
    """Optima at stationary points."""
    df = V.with_weights(crop_params(spark, sf_dir), INTERIOR).withColumn("eta", F.lit(0.0))
    out = V.optimal_floor(df)
    return rounded(out.select("commodity", "scenario", "m_star", "w_star",
                              (F.least(*[F.abs(F.col("m_star") - F.col("p") - F.lit(x)) for x in (-200.0, 0.0, 1500.0)])
                               > 1e-3).alias("interior")))


@query("v7_interior_sensitivity", B.sql_with("cp_int") + f"""
  SELECT commodity, scenario, eta, {r('m_star', 'optimal_msp')},
    {r('m_star - max(CASE WHEN eta = 0 THEN m_star END) OVER (PARTITION BY commodity, scenario)', 'delta_from_baseline')}
  FROM ({T.optimum("(SELECT * FROM cp_int, (VALUES " + ", ".join(f"({num(e)})" for e in ETAS) + ") AS et(eta))")})""")
def v7_interior_sensitivity(spark, sf_dir):
    """W18 where procurement moves the optimum."""
    base = V.with_weights(crop_params(spark, sf_dir), INTERIOR)
    opt = V.optimal_floor(base.select("*", F.explode(F.array(*[F.lit(float(e)) for e in ETAS])).alias("eta")))
    w = Window.partitionBy("commodity", "scenario")
    zero = F.max(F.when(F.col("eta") == 0, F.col("m_star"))).over(w)
    return rounded(opt.select("commodity", "scenario", "eta", F.col("m_star").alias("optimal_msp"),
                              (F.col("m_star") - zero).alias("delta_from_baseline")))


def concavity_sql(src: str, keys: str, points: int = CONCAVITY_POINTS) -> str:
    lo, hi = num(CONCAVITY_LOW), num(CONCAVITY_HIGH)
    step = f"((p + {hi}) - (p + {lo})) / {num(points - 1)}"
    return f"""
  SELECT {keys}, bool_and(d2 < 0) AS concave, max(d2) AS max_d2 FROM (
    SELECT *, CASE WHEN lag(d1) OVER w IS NULL THEN (lead(d1) OVER w - d1) / (lead(m) OVER w - m)
      WHEN lead(d1) OVER w IS NULL THEN (d1 - lag(d1) OVER w) / (m - lag(m) OVER w)
      ELSE -(lead(m) OVER w - m) / ((m - lag(m) OVER w) * ((m - lag(m) OVER w) + (lead(m) OVER w - m))) * lag(d1) OVER w
         + ((lead(m) OVER w - m) - (m - lag(m) OVER w)) / ((m - lag(m) OVER w) * (lead(m) OVER w - m)) * d1
         + (m - lag(m) OVER w) / ((lead(m) OVER w - m) * ((m - lag(m) OVER w) + (lead(m) OVER w - m))) * lead(d1) OVER w
      END AS d2
    FROM (
      SELECT *, CASE WHEN lag(w) OVER w IS NULL THEN (lead(w) OVER w - w) / (lead(m) OVER w - m)
        WHEN lead(w) OVER w IS NULL THEN (w - lag(w) OVER w) / (m - lag(m) OVER w)
        ELSE -(lead(m) OVER w - m) / ((m - lag(m) OVER w) * ((m - lag(m) OVER w) + (lead(m) OVER w - m))) * lag(w) OVER w
           + ((lead(m) OVER w - m) - (m - lag(m) OVER w)) / ((m - lag(m) OVER w) * (lead(m) OVER w - m)) * w
           + (m - lag(m) OVER w) / ((lead(m) OVER w - m) * ((m - lag(m) OVER w) + (lead(m) OVER w - m))) * lead(w) OVER w
        END AS d1
      FROM (SELECT *, {T.welfare('m')} AS w FROM (
              SELECT *, i * ({step}) + (p + {lo}) AS m
              FROM (SELECT *, 0.0e0 AS eta FROM {src}), generate_series(0, {points - 1}) AS g(i)))
      WINDOW w AS (PARTITION BY {keys} ORDER BY i))
    WINDOW w AS (PARTITION BY {keys} ORDER BY i))
  GROUP BY {keys}"""


@query("v4_concavity", B.sql_with("cp_all") + "SELECT commodity, scenario, concave, "
       + r("max_d2", "max_d2") + " FROM (" + concavity_sql("cp_all", "commodity, scenario") + ")")
def v4_concavity(spark, sf_dir):
    df = V.with_weights(crop_params(spark, sf_dir))
    return rounded(V.concavity(df, ["commodity", "scenario"]))


_C2 = T.parts("m_star", v2=True)


@query("v6_scenarios", B.sql_with("cp_opt") + f"""
  SELECT o.scenario, o.commodity AS crop, {r('o.current_msp', 'current_msp')},
    {r('o.p', 'forecast_price')}, {r('o.m_star', 'optimal_msp')},
    {r(_C2['delta_ps'], 'delta_ps')}, {r('-' + _C2['delta_cs'], 'delta_cs')},
    {r(_C2['govt_cost'], 'govt_cost')}, {r('o.w_star', 'net_welfare')},
    {r('o.m_star - o.current_msp', 'gap_from_current')}, c.concave
  FROM cp_opt o JOIN (""" + concavity_sql("cp_all", "commodity, scenario") + """) c
    ON o.commodity = c.commodity AND o.scenario = c.scenario""")
def v6_scenarios(spark, sf_dir):
    return rounded(V.scenario_table(crop_params(spark, sf_dir)))


_ETAS = ", ".join(f"({num(e)})" for e in ETAS)
B.register_cte("cp_eta", T.optimum(f"(SELECT * FROM cp_eq, (VALUES {_ETAS}) AS et(eta))"), ("cp_eq",))


@query("v7_procurement_sensitivity", B.sql_with("cp_eta") + f"""
  SELECT commodity AS crop, eta, {r('m_star', 'optimal_msp')},
    {r('m_star - max(CASE WHEN eta = 0 THEN m_star END) OVER (PARTITION BY commodity)',
       'delta_from_baseline')}, {r('w_star', 'welfare')}
  FROM cp_eta""")
def v7_procurement_sensitivity(spark, sf_dir):
    return rounded(V.procurement_sensitivity(crop_params(spark, sf_dir)))


_ST = ", ".join(f"('{n}', {num(s)}, {num(d)})" for n, s, d in STRESS)
B.register_cte("cp_stress", T.optimum(
    f"""(SELECT * EXCLUDE (scenario, eps_s, eps_d), st.scenario, eps_s * supply_mult AS eps_s,
           eps_d * demand_mult AS eps_d, 0.0e0 AS eta
         FROM cp_eq, (VALUES {_ST}) AS st(scenario, supply_mult, demand_mult))"""), ("cp_eq",))


@query("v8_elasticity_stress", B.sql_with("cp_stress") + f"""
  SELECT scenario, commodity AS crop, {r('supply_mult', 'supply_mult')},
    {r('demand_mult', 'demand_mult')}, {r('eps_s', 'eps_s')}, {r('eps_d', 'eps_d')},
    {r('m_star', 'optimal_msp')}, {r('m_star - current_msp', 'gap_from_current')},
    m_star > current_msp AS above_current
  FROM cp_stress""")
def v8_elasticity_stress(spark, sf_dir):
    return rounded(V.elasticity_stress(crop_params(spark, sf_dir)))


@query("g18_robustness", B.sql_with("cp_stress") + """
  SELECT commodity AS crop, CAST(count_if(m_star > current_msp) AS BIGINT) AS n_above,
    count(*) AS n_scenarios
  FROM cp_stress GROUP BY commodity""")
def g18_robustness(spark, sf_dir):
    st = V.elasticity_stress(crop_params(spark, sf_dir))
    return st.groupBy("crop").agg(F.count_if("above_current").cast("bigint").alias("n_above"),
                                  F.count(F.lit(1)).alias("n_scenarios"))


def curve_sql(points: int = 200, low: float = -300.0, high: float = 800.0) -> str:
    step = f"((p + {num(high)}) - (p + {num(low)})) / {num(points - 1)}"
    return f"""SELECT commodity, i, m, {T.welfare('m')} AS w FROM (
      SELECT *, i * ({step}) + (p + {num(low)}) AS m
      FROM (SELECT *, 0.0e0 AS eta FROM cp_eq), generate_series(0, {points - 1}) AS g(i))"""


B.register_cte("curve", curve_sql(), ("cp_eq",))


@query("v12_welfare_curve", B.sql_with("curve") + f"""
  SELECT commodity, CAST(i AS INTEGER) AS i, {r('m', 'm')}, {r('w', 'w')} FROM curve""")
def v12_welfare_curve(spark, sf_dir):
    return rounded(V.welfare_curve(crop_params(spark, sf_dir)))


@query("o6_curve_argmax", B.sql_with("curve") + f"""
  SELECT commodity, {r('m', 'm_at_max')}, {r('w', 'w_max')} FROM (
    SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY w DESC, i) AS rk FROM curve)
  WHERE rk = 1""")
def o6_curve_argmax(spark, sf_dir):
    return rounded(V.curve_argmax(V.welfare_curve(crop_params(spark, sf_dir))))


@query("v13_counterfactual", B.sql_with("cp_opt", "policy") + f"""
  SELECT p.crop, p.year, {r('p.msp_rs_per_quintal', 'actual_msp')},
    {r('p.msp_rs_per_quintal + g.gap', 'counterfactual_msp')}
  FROM policy p JOIN (SELECT commodity AS crop, m_star - current_msp AS gap FROM cp_opt
                      WHERE scenario = 'equal_weights') g ON p.crop = g.crop""")
def v13_counterfactual(spark, sf_dir):
    from panelmill.session import materialize
    cube = materialize(B.commodity_cube(spark, sf_dir))
    params = crop_params(spark, sf_dir, cube=cube)
    base = V.with_weights(params, [V.EQUAL]).withColumn("eta", F.lit(0.0))
    gaps = V.optimal_floor(base).select(F.col("commodity").alias("crop"),
                                        (F.col("m_star") - F.col("current_msp")).alias("gap"))
    return rounded(V.counterfactual_path(B.policy(spark, sf_dir, cube), gaps))


def commodity_prediction_means(spark, sf_dir, cube=None):
    """Per (commodity, model): mean actual and mean forecast over the test days."""
    panel = impute_prices(B.commodity_panel(spark, sf_dir, cube), keys=CKEYS)
    w = series_window(CKEYS, "date")
    f = panel.select("commodity", "date", F.lead("price_modal", 1).over(w).alias("y"),
                     F.lag("price_modal", 7).over(w).alias("naive"),
                     F.avg("price_modal").over(w.rowsBetween(-6, 0)).alias("ma"))
    f = f.where((F.col("date") >= F.lit(TEST_START).cast("date")) & F.col("y").isNotNull()
                & F.col("naive").isNotNull())
    long = f.select("commodity", "y", F.explode(F.array(
        F.struct(F.lit("naive").alias("model"), F.col("naive").alias("y_hat")),
        F.struct(F.lit("ma").alias("model"), F.col("ma").alias("y_hat")))).alias("_m"))
    return (long.groupBy("commodity", "_m.model")
            .agg(F.avg("y").alias("p_true"), F.avg("_m.y_hat").alias("p_pred")))


B.register_cte("cmeans", f"""
  SELECT commodity, model, avg(y) AS p_true, avg(y_hat) AS p_pred FROM (
    SELECT commodity, y, 'naive' AS model, naive AS y_hat FROM cpr
    UNION ALL SELECT commodity, y, 'ma' AS model, ma AS y_hat FROM cpr) GROUP BY 1, 2""",
               ("cpr",))
B.register_cte("cpr", f"""
  SELECT * FROM (SELECT commodity, date, lead(price_modal, 1) OVER w AS y,
      lag(price_modal, 7) OVER w AS naive,
      avg(price_modal) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma
    FROM fp_imp WINDOW w AS (PARTITION BY commodity, market ORDER BY date))
  WHERE date >= DATE '{TEST_START}' AND y IS NOT NULL AND naive IS NOT NULL""", ("fp_imp",))


def _regret_sql() -> str:
    src = (f"(SELECT m.*, c.* EXCLUDE (commodity, p), 0.0e0 AS eta FROM cmeans m "
           f"JOIN cp_eq c ON m.commodity = c.commodity)")
    true = T.optimum(src, "p_true", "m_true", "w_true")
    pred = T.optimum(f"({true})", "p_pred", "m_pred", "w_unused")
    return f"""SELECT commodity, model, m_true, m_pred, w_true, {T.welfare('m_pred', 'p_true')} AS w_at_pred
      FROM ({pred})"""


@query("v5_welfare_regret", B.sql_with("cmeans", "cp_eq") + f"""
  SELECT commodity, model, {r('m_true', 'm_true')}, {r('m_pred', 'm_pred')},
    {r('greatest(w_true - w_at_pred, 0.0e0)', 'regret')}
  FROM ({_regret_sql()})""")
def v5_welfare_regret(spark, sf_dir):
    """V5 + O7: regret per (commodity, model), sorted ascending."""
    from panelmill.session import materialize
    cube = materialize(B.commodity_cube(spark, sf_dir))
    means = commodity_prediction_means(spark, sf_dir, cube)
    params = crop_params(spark, sf_dir, cube=cube).drop("p")
    df = V.welfare_regret(means.join(params, "commodity"))
    return rounded(df.select("commodity", "model", "m_true", "m_pred", "regret")
                   .orderBy("regret", "commodity", "model"))
