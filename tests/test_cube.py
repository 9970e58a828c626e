"""The facts are joined once for the model queries, and no table that grows with them is broadcast."""

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.plans import q_chain as C
from panelmill.plans import q_models as Q
from panelmill.session import clear_scratch
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_tables_are_not_broadcast(spark):
    for df in (B.commodity_cube(spark, SF_SMALL), B._order_nation(spark, SF_SMALL)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_facts_are_joined_once(spark, monkeypatch):
    whole, made = B.commodity_cube, []

    def counted(*args):
        made.append(args)
        return whole(*args)

    def prices(spark, sf_dir):
        rows = Q.panel(spark, sf_dir).groupBy("commodity").agg(F.avg("price_modal").alias("forecast_price"))
        return rows.select(F.lit("B").alias("regime"), F.lit("rf").alias("model"), "*", F.lit(1.0).alias("rmse"))

    clear_scratch(spark)  # tables of other tests
    monkeypatch.setattr(B, "commodity_cube", counted)
    monkeypatch.setattr(C, "g17_model_prices", prices)
    try:
        Q.series_predictions(spark, SF_SMALL)
        assert C.forest_params(spark, SF_SMALL).count() > 0
        assert C.v13_counterfactual_forest(spark, SF_SMALL).count() > 0
    finally:
        clear_scratch(spark)
    assert len(made) == 1
