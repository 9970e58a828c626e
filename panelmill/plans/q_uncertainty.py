"""Queries for the Monte Carlo decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.operators import uncertainty as U
from panelmill.operators.aggregates import density_histogram
from panelmill.params import MC_DRAWS, MC_SEED
from panelmill.plans.common import r, rounded
from panelmill.plans import welfare_twin as T
from panelmill.plans.q_policy import INTERIOR, crop_params
import panelmill.plans.q_policy  # noqa: F401  (registers the parameter CTEs)
from panelmill.plans.registry import query
from panelmill.session import materialize



def _draw_ctes(name: str, params: str) -> None:
    """Draws and their summary as CTEs ``name`` and ``name``_summary over the parameter CTE ``params``."""
    mc1 = f"""(SELECT * EXCLUDE (eps_s, eps_d, _ts, _td),
        {U.truncated_from_tail_sql('eps_s', 'eps_s_se', '+', '_ts')} AS eps_s,
        {U.truncated_from_tail_sql('eps_d', 'eps_d_se', '-', '_td')} AS eps_d, 0.0e0 AS eta
      FROM (SELECT *, {U.truncated_tail_sql('eps_s', 'eps_s_se', '+', MC_SEED, 's', 'duckdb')} AS _ts,
              {U.truncated_tail_sql('eps_d', 'eps_d_se', '-', MC_SEED, 'd', 'duckdb')} AS _td
            FROM {params}, generate_series(0, {MC_DRAWS - 1}) AS g(draw)))"""
    mc2 = f"""(SELECT * EXCLUDE (p), {U.forecast_draw_sql(MC_SEED + 500, 'duckdb')} AS p, 0.0e0 AS eta
      FROM {params}, generate_series(0, {MC_DRAWS - 1}) AS g(draw))"""
    B.register_cte(name, f"""
      SELECT commodity, 'Elasticity (MC-1)' AS source, CAST(draw AS INTEGER) AS draw, eps_s, eps_d, p, m_star
      FROM ({T.optimum(mc1)}) UNION ALL
      SELECT commodity, 'Forecast (MC-2)' AS source, CAST(draw AS INTEGER) AS draw, eps_s, eps_d, p, m_star
      FROM ({T.optimum(mc2)})""", (params,))
    B.register_cte(f"{name}_summary", f"""
      SELECT commodity, source, q[2] AS median_msp, q[1] AS ci_lower, q[3] AS ci_upper,
        q[3] - q[1] AS ci_width, sd
      FROM (SELECT commodity, source, quantile_cont(m_star, [0.05, 0.5, 0.95]) AS q,
              stddev_pop(m_star) AS sd FROM {name} GROUP BY 1, 2)""", (name,))


_draw_ctes("mc_draws", "cp_eq")
B.register_cte("cp_int_low", "SELECT * FROM cp_int WHERE scenario = 'interior_low'", ("cp_int",))
_draw_ctes("mci_draws", "cp_int_low")
B.register_cte("mc_summary", "SELECT * FROM mc_draws_summary", ("mc_draws_summary",))
@query("v9_v10_draws", B.sql_with("mc_draws") + f"""
  SELECT commodity, source, draw, {r('eps_s', 'eps_s')}, {r('eps_d', 'eps_d')}, {r('p', 'p')},
    {r('m_star', 'm_star')} FROM mc_draws""")
def v9_v10_draws(spark, sf_dir):
    return rounded(U.all_draws(crop_params(spark, sf_dir)))


@query("v11_mc_summary", B.sql_with("mc_summary") + f"""
  SELECT commodity, source, {r('median_msp', 'median_msp')}, {r('ci_lower', 'ci_lower')},
    {r('ci_upper', 'ci_upper')}, {r('ci_width', 'ci_width')}, {r('sd', 'sd')}
  FROM mc_summary""")
def v11_mc_summary(spark, sf_dir):
    """G13 over both sources."""
    return rounded(U.dual_summary(U.all_draws(crop_params(spark, sf_dir))))


@query("g14_ci_ratio", B.sql_with("mc_summary") + f"""
  SELECT commodity, {r('max(CASE WHEN source LIKE ' + "'Forecast%'" + ' THEN ci_width END) / greatest(max(CASE WHEN source LIKE ' + "'Elasticity%'" + ' THEN ci_width END), 1.0e0)', 'ci_ratio')}
  FROM mc_summary GROUP BY commodity""")
def g14_ci_ratio(spark, sf_dir):
    return rounded(U.ci_ratio(U.dual_summary(U.all_draws(crop_params(spark, sf_dir)))))


@query("g14_interior_ratio", B.sql_with("mci_draws_summary") + f"""
  SELECT commodity, {r("max(CASE WHEN source LIKE 'Elasticity%' THEN ci_width END)", 'elasticity_width')},
    {r("max(CASE WHEN source LIKE 'Forecast%' THEN ci_width END) / greatest(max(CASE WHEN source LIKE 'Elasticity%' THEN ci_width END), 1.0e0)", 'ci_ratio')}
  FROM mci_draws_summary GROUP BY commodity""")
def g14_interior_ratio(spark, sf_dir):
    """V9-V11 and G14 with weights for which both sources move the optimum."""
    summary = materialize(U.dual_summary(U.all_draws(crop_params(spark, sf_dir), weights=INTERIOR[0])))
    width = summary.where(F.col("source").startswith("Elasticity")).select(
        "commodity", F.col("ci_width").alias("elasticity_width"))
    return rounded(width.join(U.ci_ratio(summary), "commodity"))


@query("g15_combined_band", B.sql_with("mc_summary", "cparams") + f"""
  SELECT b.commodity, {r('band_lower', 'band_lower')}, {r('band_upper', 'band_upper')},
    {r('c.current_msp', 'current_msp')},
    CASE WHEN c.current_msp < band_lower THEN 'below'
         WHEN c.current_msp > band_upper THEN 'above' ELSE 'within' END AS current_position
  FROM (SELECT commodity, min(ci_lower) AS band_lower, max(ci_upper) AS band_upper
        FROM mc_summary GROUP BY commodity) b JOIN cparams c ON b.commodity = c.commodity""")
def g15_combined_band(spark, sf_dir):
    params = crop_params(spark, sf_dir)
    return rounded(U.combined_band(U.dual_summary(U.all_draws(params)), params))


@query("g16_draw_histogram", B.sql_with("mc_draws") + f"""
  , bounds AS (SELECT commodity, source, min(m_star) AS lo, max(m_star) AS hi,
                 count(m_star) AS n FROM mc_draws GROUP BY 1, 2),
  binned AS (
    SELECT d.commodity, d.source,
      least(CASE WHEN b.hi > b.lo
                 THEN CAST(floor((d.m_star - b.lo) / ((b.hi - b.lo) / 40)) AS INTEGER) + 1
                 ELSE 1 END, 40) AS bin, count(*) AS cnt
    FROM mc_draws d JOIN bounds b ON d.commodity = b.commodity AND d.source = b.source
    GROUP BY 1, 2, 3)
  SELECT g.commodity, g.source, CAST(g.bin AS INTEGER) AS bin,
    {r('g.lo + (g.bin - 1) * ((g.hi - g.lo) / 40)', 'bin_lo')},
    {r('g.lo + g.bin * ((g.hi - g.lo) / 40)', 'bin_hi')},
    CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
    {r('CASE WHEN g.n * ((g.hi - g.lo) / 40) = 0 THEN NULL ELSE CAST(coalesce(c.cnt, 0) AS DOUBLE) / (g.n * ((g.hi - g.lo) / 40)) END', 'density')}
  FROM (SELECT b.*, s.bin FROM bounds b, generate_series(1, 40) AS s(bin)) g
  LEFT JOIN binned c ON g.commodity = c.commodity AND g.source = c.source AND g.bin = c.bin""")
def g16_draw_histogram(spark, sf_dir):
    draws = U.all_draws(crop_params(spark, sf_dir))
    return rounded(density_histogram(draws, "m_star", ["commodity", "source"], 40))
