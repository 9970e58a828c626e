"""Price-floor policy evaluation over series x parameter tables.

Every row is one (commodity, parameter set); the optimum is a closed-form
projection (no solver, no UDF), so thousands of scenarios or Monte Carlo
draws are one narrow stage. Parameter tables of fixed size are exploded as
literal arrays; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.welfare import (apply_stages, components_sql, num, optimum_stages,
                                         stages_sql, welfare_sql)
from panelmill.params import (CONCAVITY_HIGH, CONCAVITY_LOW, CONCAVITY_POINTS, ETAS, SCENARIOS,
                              STRESS)

EQUAL = [s for s in SCENARIOS if s[0] == "equal_weights"][0]


def weights_array(scenarios=SCENARIOS):
    return F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("alpha"),
                              F.lit(b).alias("beta"), F.lit(g).alias("gamma"),
                              F.lit(d).alias("delta")) for n, a, b, g, d in scenarios])


def weights_sql(scenarios=SCENARIOS) -> str:
    rows = ", ".join(f"('{n}', {num(a)}, {num(b)}, {num(g)}, {num(d)})"
                     for n, a, b, g, d in scenarios)
    return f"(VALUES {rows}) AS sc(scenario, alpha, beta, gamma, delta)"


def with_weights(df: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Every row x every weight scenario (literal array, no join)."""
    return (df.select("*", F.explode(weights_array(scenarios)).alias("_w"))
            .select("*", "_w.*").drop("_w"))


def optimal_floor(df: DataFrame) -> DataFrame:
    """V3: adds ``m_star`` and ``w_star`` per row (closed form)."""
    return apply_stages(df, optimum_stages())


def welfare_at(df: DataFrame, m: str, out: str = "welfare") -> DataFrame:
    """V1 at floor column ``m``."""
    return df.withColumn(out, F.expr(welfare_sql(m)))


def components_at(df: DataFrame, m: str, v2: bool = True) -> DataFrame:
    """V2 (``v2=True``: dCS is 0 when g <= 0) or V1's components at floor ``m``."""
    comps = components_sql(m, cs_kink_only_positive=v2)
    for name, expr in comps.items():
        df = df.withColumn(name, F.expr(expr))
    return df


def grid(df: DataFrame, low: float, high: float, points: int, keys: Sequence[str]) -> DataFrame:
    """``points`` floors evenly spaced on [p + low, p + high] (numpy linspace arithmetic)."""
    step = f"((p + {num(high)}) - (p + {num(low)})) / {num(points - 1)}"
    return (df.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
            .withColumn("m", F.expr(f"i * ({step}) + (p + {num(low)})")))


def gradient(df: DataFrame, y: str, x: str, keys: Sequence[str], order: str = "i",
             out: str = "dy") -> DataFrame:
    """Numpy-style second-order gradient on a non-uniform grid, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    ym, yp = F.lag(y).over(w), F.lead(y).over(w)
    xm, xp = F.lag(x).over(w), F.lead(x).over(w)
    dx1, dx2 = F.col(x) - xm, xp - F.col(x)
    a = -dx2 / (dx1 * (dx1 + dx2))
    b = (dx2 - dx1) / (dx1 * dx2)
    c = dx1 / (dx2 * (dx1 + dx2))
    g = (F.when(ym.isNull(), (yp - F.col(y)) / (xp - F.col(x)))
         .when(yp.isNull(), (F.col(y) - ym) / (F.col(x) - xm))
         .otherwise(a * ym + b * F.col(y) + c * yp))
    return df.withColumn(out, g)


def concavity(df: DataFrame, keys: Sequence[str], points: int = CONCAVITY_POINTS) -> DataFrame:
    """V4: W on ``points`` floors of [p-500, p+1500]; is d2W/dm2 < 0 everywhere?"""
    g = grid(df, CONCAVITY_LOW, CONCAVITY_HIGH, points, keys)
    g = g.withColumn("eta", F.lit(0.0))
    g = welfare_at(g, "m", "w")
    g = gradient(g, "w", "m", keys, out="d1")
    g = gradient(g, "d1", "m", keys, out="d2")
    return g.groupBy(*keys).agg(F.bool_and(F.col("d2") < 0).alias("concave"),
                                F.max("d2").alias("max_d2"))


def scenario_table(params: DataFrame) -> DataFrame:
    """V6: commodities x weight scenarios -> optimum, components, gap, concavity."""
    base = with_weights(params).withColumn("eta", F.lit(0.0))
    opt = components_at(optimal_floor(base), "m_star", v2=True)
    conc = concavity(base, ["commodity", "scenario"])
    return (opt.join(conc, ["commodity", "scenario"])
            .select("scenario", F.col("commodity").alias("crop"), "current_msp",
                    F.col("p").alias("forecast_price"), F.col("m_star").alias("optimal_msp"),
                    "delta_ps", (-F.col("delta_cs")).alias("delta_cs"), "govt_cost",
                    F.col("w_star").alias("net_welfare"),
                    (F.col("m_star") - F.col("current_msp")).alias("gap_from_current"),
                    "concave"))


def procurement_sensitivity(params: DataFrame, etas: Sequence[float] = ETAS) -> DataFrame:
    """V7 + W18: equal weights x eta grid; delta from the eta = 0 optimum."""
    base = with_weights(params, [EQUAL])
    base = base.select("*", F.explode(F.array(*[F.lit(float(e)) for e in etas])).alias("eta"))
    opt = optimal_floor(base)
    w = Window.partitionBy("commodity")
    baseline = F.max(F.when(F.col("eta") == 0, F.col("m_star"))).over(w)
    return opt.select(F.col("commodity").alias("crop"), "eta", F.col("m_star").alias("optimal_msp"),
                      (F.col("m_star") - baseline).alias("delta_from_baseline"),
                      F.col("w_star").alias("welfare"))


def stress_array(stress=STRESS):
    return F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("supply_mult"),
                              F.lit(d).alias("demand_mult")) for n, s, d in stress])


def elasticity_stress(params: DataFrame, stress=STRESS) -> DataFrame:
    """V8 + P8: scaled elasticities, optimum and its position relative to the current floor."""
    base = with_weights(params, [EQUAL]).drop("scenario").withColumn("eta", F.lit(0.0))
    base = base.select("*", F.explode(stress_array(stress)).alias("_s")).select("*", "_s.*")
    base = (base.withColumn("eps_s", F.col("eps_s") * F.col("supply_mult"))
            .withColumn("eps_d", F.col("eps_d") * F.col("demand_mult")))
    opt = optimal_floor(base)
    return opt.select("scenario", F.col("commodity").alias("crop"), "supply_mult", "demand_mult",
                      "eps_s", "eps_d", F.col("m_star").alias("optimal_msp"),
                      (F.col("m_star") - F.col("current_msp")).alias("gap_from_current"),
                      (F.col("m_star") > F.col("current_msp")).alias("above_current"))


def welfare_curve(params: DataFrame, low: float = -300.0, high: float = 800.0,
                  points: int = 200) -> DataFrame:
    """W over ``points`` floors of [p-300, p+800] with equal weights."""
    base = with_weights(params, [EQUAL]).withColumn("eta", F.lit(0.0))
    g = grid(base, low, high, points, ["commodity"])
    return welfare_at(g, "m", "w").select("commodity", "i", "m", "w")


def curve_argmax(curve: DataFrame, keys=("commodity",)) -> DataFrame:
    """The floor with the largest W, the first grid point on ties."""
    best = curve.groupBy(*keys).agg(F.max(F.struct(F.col("w"), (-F.col("i")).alias("ni"),
                                                   F.col("m"))).alias("b"))
    return best.select(*keys, F.col("b.m").alias("m_at_max"), F.col("b.w").alias("w_max"))


def welfare_regret(means: DataFrame) -> DataFrame:
    """V5: regret of optimising on the forecast mean instead of the actual mean.

    ``means`` has one row per (commodity, model) with ``p_true``, ``p_pred``
    and the crop parameters. Both optima are projections of the same row.
    """
    base = with_weights(means, [EQUAL]).withColumn("eta", F.lit(0.0))
    t = optimal_floor(base.withColumn("p", F.col("p_true")))
    t = t.withColumnRenamed("m_star", "m_true").withColumnRenamed("w_star", "w_true")
    t = optimal_floor(t.withColumn("p", F.col("p_pred")))
    t = t.withColumnRenamed("m_star", "m_pred").drop("w_star")
    t = t.withColumn("p", F.col("p_true"))
    t = welfare_at(t, "m_pred", "w_at_pred")
    return t.withColumn("regret", F.greatest(F.col("w_true") - F.col("w_at_pred"), F.lit(0.0)))


def counterfactual_path(policy: DataFrame, gaps: DataFrame) -> DataFrame:
    """Actual floor by year plus the optimum's gap from the current floor."""
    return (policy.join(gaps, "crop")
            .select("crop", "year", F.col("msp_rs_per_quintal").alias("actual_msp"),
                    (F.col("msp_rs_per_quintal") + F.col("gap")).alias("counterfactual_msp")))


__all__ = ["optimal_floor", "welfare_at", "components_at", "concavity", "scenario_table",
           "procurement_sensitivity", "elasticity_stress", "welfare_curve", "curve_argmax",
           "welfare_regret", "counterfactual_path", "gradient", "grid", "stages_sql"]
