"""Registered queries against their DuckDB twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from panelmill.plans.registry import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, rows_of

# Values of fitted models; their keys, targets, ranges and sums have queries with an oracle.
ROWS_ONLY = {"m1_m2_m9_regime_predictions", "m9_regime_metrics", "m3_o3_top_features",
             "m8_rolling_cv_models", "m9_predictions_wide", "v9_v10_draws_forest", "m5_ets_forecast", "m6_sarima_forecast",
             "m7_sarima_aic_forecast", "m5_m7_series_metrics", "o2_leaderboard", "g9_model_horizons",
             "j8_regime_pairs", "g12_models_vs_naive", "g17_model_prices", "v5_regret_models",
             "v6_scenarios_forest", "v7_sensitivity_forest", "v8_stress_forest", "v11_mc_summary_forest",
             "v12_curve_forest", "v13_counterfactual_forest"}

SAMPLE = ["g1_daily_mean", "w5_interpolate", "feature_panel", "j3_asof_policy",
          "g12_diebold_mariano", "g9_multihorizon", "v6_scenarios", "v8_elasticity_stress",
          "v11_mc_summary", "w5_interpolate_blocked", "w1_w7_blocked", "g13_price_quantiles", "m1_tree_splits", "m10_within_slopes", "m10_two_regressors", "m10_normal_equations", "g12_dm_pvalue",
          "m5_grid", "m6_seasonal_ar", "v3_interior_optima", "v7_interior_sensitivity", "s3_source_fallback", "s9_default_prices",
          "s1_s2_price_files", "g16_draw_histogram", "p11_dense_codes", "j4_cv_folds", "w16_lookback_multi"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    E.queries()
    qs, sql = QUERIES, ORACLES
    assert set(sql) <= set(qs)
    assert set(qs) - set(sql) == ROWS_ONLY


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "date" in df.columns and "price_modal" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.sql(E.oracle_sql()[name]).df()
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
