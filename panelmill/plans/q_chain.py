"""From forecasts to policy: the forest's regime-B prices feed the policy tables.

The price of a commodity is the mean forecast of the policy-neutral forest over the test days, its
uncertainty the forest's RMSE; a commodity without a forecast takes the fallback values of its archetype.
``plans.q_policy`` has the same tables on naive prices, which SQL can check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.operators import policy as V
from panelmill.operators import uncertainty as U
from panelmill.plans.q_models import cube, g17_model_prices, once
from panelmill.plans.q_policy import crop_params, with_defaults
from panelmill.plans.registry import query


def forest_params(spark, sf_dir):
    def make():
        prices = (g17_model_prices(spark, sf_dir).where("regime = 'B' AND model = 'rf'")
                  .select("commodity", "forecast_price", "rmse"))
        types = B.table(spark, sf_dir, "part", "p_type").select(F.col("p_type").alias("commodity")).distinct()
        full = with_defaults(types.join(prices, "commodity", "left"))
        return crop_params(spark, sf_dir, cube=cube(spark, sf_dir), fc=full.select("commodity", "forecast_price", "rmse"))
    return once(spark, sf_dir, "forest-params", make)


@query("v5_regret_models")
def v5_regret_models(spark, sf_dir):
    """V5 + O7: regret of optimising on each model's mean forecast, by regime, sorted ascending."""
    means = g17_model_prices(spark, sf_dir).select(
        "commodity", "regime", "model", F.col("actual_price").alias("p_true"),
        F.col("forecast_price").alias("p_pred")).where("p_pred IS NOT NULL")
    params = forest_params(spark, sf_dir).drop("p")
    df = V.welfare_regret(means.join(params, "commodity"))
    return (df.select("commodity", "regime", "model", "m_true", "m_pred", "regret")
            .orderBy("regret", "commodity", "regime", "model"))


@query("v6_scenarios_forest")
def v6_scenarios_forest(spark, sf_dir):
    return V.scenario_table(forest_params(spark, sf_dir))


@query("v7_sensitivity_forest")
def v7_sensitivity_forest(spark, sf_dir):
    return V.procurement_sensitivity(forest_params(spark, sf_dir))


@query("v8_stress_forest")
def v8_stress_forest(spark, sf_dir):
    return V.elasticity_stress(forest_params(spark, sf_dir))


@query("v11_mc_summary_forest")
def v11_mc_summary_forest(spark, sf_dir):
    return U.dual_summary(U.all_draws(forest_params(spark, sf_dir)))


@query("v9_v10_draws_forest")
def v9_v10_draws_forest(spark, sf_dir):
    return U.all_draws(forest_params(spark, sf_dir))


@query("v12_curve_forest")
def v12_curve_forest(spark, sf_dir):
    return V.welfare_curve(forest_params(spark, sf_dir))


@query("v13_counterfactual_forest")
def v13_counterfactual_forest(spark, sf_dir):
    base = V.with_weights(forest_params(spark, sf_dir), [V.EQUAL]).withColumn("eta", F.lit(0.0))
    gaps = V.optimal_floor(base).select(F.col("commodity").alias("crop"),
                                        (F.col("m_star") - F.col("current_msp")).alias("gap"))
    return V.counterfactual_path(B.policy(spark, sf_dir, cube(spark, sf_dir)), gaps)
