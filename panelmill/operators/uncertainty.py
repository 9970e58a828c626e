"""Monte Carlo propagation of parameter and forecast uncertainty.

Draws are rows: (commodity x source x draw id) generated by ``explode`` of a
``sequence`` per commodity row, so they spread over tasks like any data. Each
draw's optimum is the closed-form V3 projection; summaries are grouped
aggregates. Nothing is collected; a lost task recomputes identical draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.random import key_sql, normal_sql, uniform_sql
from panelmill.functions.special import quantile_sql, upper_tail_sql
from panelmill.functions.welfare import num
from panelmill.operators.aggregates import quantile_summary
from panelmill.operators.policy import EQUAL, optimal_floor, with_weights
from panelmill.params import FORECAST_SD_FRACTION, MC_DRAWS, MC_SEED

def truncated_tail_sql(mean: str, sd: str, sign: str, seed: int, var: str,
                       dialect: str = "spark", source: str = "mc1") -> str:
    """u P(Z > -c) with c = mean / sd for a positive, -mean / sd for a negative draw; u is the draw's uniform."""
    u = uniform_sql(key_sql([f"'{seed}'", "commodity", f"'{source}'", "draw", f"'{var}'"], dialect), dialect)
    c = f"({mean} / {sd})" if sign == "+" else f"(-{mean} / {sd})"
    return f"({u} * {upper_tail_sql(f'(-{c})')})"


def truncated_from_tail_sql(mean: str, sd: str, sign: str, tail: str) -> str:
    """The draw of a tail probability: mean +- sd z with P(Z > z) = tail."""
    z = f"(-{quantile_sql(tail)})"
    return f"({mean} + {sd} * {z})" if sign == "+" else f"({mean} - {sd} * {z})"


def truncated_draw_sql(mean: str, sd: str, sign: str, seed: int, var: str,
                       dialect: str = "spark", source: str = "mc1") -> str:
    """A normal draw conditioned on the required sign, by the inverse distribution function.

    The reference redraws until the sign is right, which gives the same distribution; here no draw is
    ever lost, however unlikely the sign.
    """
    return truncated_from_tail_sql(mean, sd, sign, truncated_tail_sql(mean, sd, sign, seed, var, dialect, source))


def forecast_draw_sql(seed: int, dialect: str = "spark") -> str:
    z = normal_sql([f"'{seed}'", "commodity", "'mc2'", "draw", "'p'"], dialect)
    return f"greatest(p + {num(FORECAST_SD_FRACTION)} * rmse * {z}, {num(0.5)} * p)"


def with_draws(params: DataFrame, n: int = MC_DRAWS) -> DataFrame:
    return params.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))


DRAW_COLUMNS = ["draw", "eps_s", "eps_d", "p", "m_star"]


def elasticity_draws(params: DataFrame, n: int = MC_DRAWS, seed: int = MC_SEED, weights=EQUAL) -> DataFrame:
    """V9 (MC-1): elasticities ~ truncated normal, forecast fixed; optimum per draw."""
    d = with_weights(with_draws(params, n), [weights]).withColumn("eta", F.lit(0.0))
    # the tails are columns of their own, so the quantile does not repeat the hash
    d = (d.withColumn("_ts", F.expr(truncated_tail_sql("eps_s", "eps_s_se", "+", seed, "s")))
         .withColumn("_td", F.expr(truncated_tail_sql("eps_d", "eps_d_se", "-", seed, "d"))))
    d = (d.withColumn("eps_s", F.expr(truncated_from_tail_sql("eps_s", "eps_s_se", "+", "_ts")))
         .withColumn("eps_d", F.expr(truncated_from_tail_sql("eps_d", "eps_d_se", "-", "_td"))).drop("_ts", "_td"))
    return optimal_floor(d).select("commodity", F.lit("Elasticity (MC-1)").alias("source"), *DRAW_COLUMNS)


def forecast_draws(params: DataFrame, n: int = MC_DRAWS, seed: int = MC_SEED + 500, weights=EQUAL) -> DataFrame:
    """V10 (MC-2): p ~ N(p_hat, 0.3 rmse) floored at p_hat / 2; optimum per draw."""
    d = with_weights(with_draws(params, n), [weights]).withColumn("eta", F.lit(0.0))
    d = d.withColumn("p", F.expr(forecast_draw_sql(seed)))
    return optimal_floor(d).select("commodity", F.lit("Forecast (MC-2)").alias("source"), *DRAW_COLUMNS)


def all_draws(params: DataFrame, n: int = MC_DRAWS, weights=EQUAL) -> DataFrame:
    return (elasticity_draws(params, n, weights=weights)
            .unionByName(forecast_draws(params, n, weights=weights)))


def dual_summary(draws: DataFrame) -> DataFrame:
    """Median, 90 % interval, width and SD per (commodity, source)."""
    return quantile_summary(draws, "m_star", ["commodity", "source"])


def ci_ratio(summary: DataFrame) -> DataFrame:
    """Forecast CI width over elasticity CI width (denominator floored at 1)."""
    s = summary.groupBy("commodity").agg(
        F.max(F.when(F.col("source").startswith("Forecast"), F.col("ci_width"))).alias("w2"),
        F.max(F.when(F.col("source").startswith("Elasticity"), F.col("ci_width"))).alias("w1"))
    return s.select("commodity", (F.col("w2") / F.greatest(F.col("w1"), F.lit(1.0)))
                    .alias("ci_ratio"))


def combined_band(summary: DataFrame, params: DataFrame) -> DataFrame:
    """G15 + P8: widest band over sources and where the current floor falls."""
    b = summary.groupBy("commodity").agg(F.min("ci_lower").alias("band_lower"),
                                         F.max("ci_upper").alias("band_upper"))
    b = b.join(params.select("commodity", "current_msp"), "commodity")
    pos = (F.when(F.col("current_msp") < F.col("band_lower"), "below")
           .when(F.col("current_msp") > F.col("band_upper"), "above").otherwise("within"))
    return b.withColumn("current_position", pos)
