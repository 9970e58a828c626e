"""The reference's output tables, each written from its query.

    python -m panelmill.plans.outputs --sf /root/testdata/sf0.01 --out <folder> [table ...]

Every table is an independent Spark job writing parquet (overwrite); nothing
is collected to the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from panelmill.params import RF_PARAMS

# table name -> registered query
OUTPUT_TABLES = {
    "daily_panel": "feature_panel",
    "daily_agg": "p7_daily_agg",
    "model_results": "m9_regime_metrics",
    "predictions": "m9_predictions_wide",
    "feature_importance": "m3_o3_top_features",
    "rolling_cv": "m8_rolling_cv_models",
    "multihorizon": "g9_model_horizons",
    "leaderboard": "o2_leaderboard",
    "dm_tests": "g12_models_vs_naive",
    "model_b_forecasts": "g17_model_prices",
    "welfare_regret": "v5_regret_models",
    "welfare_scenarios": "v6_scenarios",
    "welfare_scenarios_forest": "v6_scenarios_forest",
    "weather_panel_results": "m10_fe_regression",
    "monte_carlo_results": "v11_mc_summary_forest",
    "mc_draws": "v9_v10_draws_forest",
    "sensitivity_procurement": "v7_sensitivity_forest",
    "sensitivity_elasticity": "v8_stress_forest",
}


def write_outputs(spark: SparkSession, sf_dir: str, out_root: str,
                  tables: list[str] | None = None, forest_trees: int = RF_PARAMS["num_trees"]) -> dict[str, str]:
    from panelmill.plans.registry import QUERIES, load_all
    load_all()
    spark.conf.set("spark.panelmill.forest.trees", str(forest_trees))
    written = {}
    for name in tables or list(OUTPUT_TABLES):
        path = f"{out_root.rstrip('/')}/{name}"
        QUERIES[OUTPUT_TABLES[name]](spark, sf_dir).write.mode("overwrite").parquet(path)
        written[name] = path
    return written


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("tables", nargs="*")
    a = ap.parse_args()
    from panelmill.session import get_spark
    for name, path in write_outputs(get_spark(), a.sf, a.out, a.tables or None).items():
        print(name, path)


if __name__ == "__main__":
    main()
