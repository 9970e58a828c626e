"""Small golden cases (FIXTURES §4, SURVEY §5.2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmill.functions.calendar import add_temporal_features
from panelmill.operators import metrics as M
from panelmill.operators.impute import impute_prices
from panelmill.operators.policy import optimal_floor
from panelmill.operators.windows import add_price_features
from panelmill.params import ELASTICITIES, PROCUREMENT, PRODUCTION, SCENARIOS


def _series(spark, values):
    d0 = dt.date(2020, 1, 1)
    rows = [("m", d0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "market string, date date, price_modal double")


def test_w5_interpolation_edges(spark):
    out = impute_prices(_series(spark, [None, 1.0, None, 4.0, None])).orderBy("date")
    assert [r.price_modal for r in out.collect()] == [1.0, 1.0, 2.5, 4.0, 4.0]


def test_w6_all_missing_series_stays_missing(spark):
    out = impute_prices(_series(spark, [None, None]))
    assert [r.price_modal for r in out.collect()] == [None, None]


def test_w3_first_row_and_min_periods(spark):
    out = add_price_features(_series(spark, [1.0, 2.0, 4.0, 9.0])).orderBy("date").collect()
    assert out[0].price_lag1 is None and out[0].price_std7 is None
    assert out[0].price_ma7 == 1.0
    assert out[1].price_std7 == pytest.approx(0.7071067811865476)
    assert out[3].price_std30 is None  # fewer than 5 rows


def test_g4_g13_linear_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 4.0, 9.0]], "x double")
    q = df.agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5)))).first()[0]
    assert q == pytest.approx([1.15, 1.75, 3.0])


def test_g7_r2_is_one_minus_sse_over_sst(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [("m", d0 + dt.timedelta(days=i), "x", float(y), float(p))
            for i, (y, p) in enumerate(zip([1, 2, 3], [11, 12, 13]))]
    pred = spark.createDataFrame(rows, "market string, date date, model string, y double, "
                                       "y_hat double")
    r = M.accuracy(pred).first()
    assert r.r2 == pytest.approx(-149.0)
    assert r.rmse == pytest.approx(10.0) and r.mae == pytest.approx(10.0)
    assert r.dir_acc == pytest.approx(100.0)


def test_f1_weekday_and_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2021, 1, 1),)], "date date")
    rows = add_temporal_features(df).orderBy("date").collect()
    assert rows[1].day_of_week == 0
    assert rows[0].week_of_year == 53


def test_g12_bandwidth_exact_cubes(spark):
    df = spark.createDataFrame([(t,) for t in [1, 7, 8, 64, 124, 125, 126]], "t long")
    got = [r.b for r in df.select(M.bandwidth(F.col("t")).alias("b")).collect()]
    assert got == [1, 1, 2, 4, 4, 5, 5]


# SURVEY §5.2: global optimum for the fallback prices 2350 / 2967 (g*, W).
GOLDEN = {
    ("wheat", "farmer_centric"): (1500, 10385.11), ("rice", "farmer_centric"): (1500, 140512.08),
    ("wheat", "consumer_centric"): (-200, 1061.45), ("rice", "consumer_centric"): (-200, 2854.71),
    ("wheat", "fiscal_conserv"): (-200, 3898.42), ("rice", "fiscal_conserv"): (-200, 7049.34),
    ("wheat", "equal_weights"): (-200, 3285.70), ("rice", "equal_weights"): (-200, 5832.87),
}
GOLDEN_ETA = {"wheat": [3285.70, 3177.71, 3069.72, 2853.75, 2637.78],
              "rice": [5832.87, 5727.19, 5621.52, 5410.17, 5198.83]}


def _params(spark, etas=(0.0,)):
    price = {"wheat": 2350.0, "rice": 2967.0}
    rows = []
    for crop in ("wheat", "rice"):
        e = ELASTICITIES[crop]
        for name, a, b, g, d in SCENARIOS:
            for eta in etas:
                rows.append((crop, name, price[crop], e["supply"], e["demand"], PROCUREMENT[crop],
                             PRODUCTION[crop], a, b, g, d, float(eta)))
    return spark.createDataFrame(rows, "commodity string, scenario string, p double, "
                                       "eps_s double, eps_d double, q_proc double, "
                                       "q_total double, alpha double, beta double, "
                                       "gamma double, delta double, eta double")


def test_v3_fallback_prices_golden(spark):
    for r in optimal_floor(_params(spark)).collect():
        g, w = GOLDEN[(r.commodity, r.scenario)]
        assert r.m_star - r.p == pytest.approx(g, abs=1e-6)
        assert r.w_star == pytest.approx(w, abs=0.01)


def test_v7_eta_golden(spark):
    df = optimal_floor(_params(spark, (0, 0.5, 1, 2, 3))).where("scenario = 'equal_weights'")
    got = {}
    for r in df.orderBy("eta").collect():
        assert r.m_star - r.p == pytest.approx(-200, abs=1e-6)
        got.setdefault(r.commodity, []).append(r.w_star)
    for crop, ws in GOLDEN_ETA.items():
        assert got[crop] == pytest.approx(ws, abs=0.01)
