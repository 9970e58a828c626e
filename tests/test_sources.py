"""Sources, sinks and the streaming ingest."""

import pytest

from panelmill import bindings as B
from panelmill.session import scratch_path
from panelmill.sources import prices_csv, tables
from tests.conftest import SF_SMALL


def test_panel_read_prunes_partitions(spark):
    path = scratch_path(spark, "t-panel")
    tables.write_table(B.commodity_panel(spark, SF_SMALL), path, ["commodity"])
    df = tables.read_panel(spark, path, "PROMO")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(commodity" in plan and "PROMO" in plan
    assert {r.commodity for r in df.select("commodity").distinct().collect()} == {"PROMO"}


def test_missing_panel_raises(spark):
    with pytest.raises(FileNotFoundError):
        tables.read_panel(spark, scratch_path(spark, "absent")).count()


def test_price_files_round_trip_drops_only_bad_cells(spark):
    panel = B.market_panel(spark, SF_SMALL)
    root = scratch_path(spark, "t-prices")
    prices_csv.write_price_files(panel, root, "all")
    back = prices_csv.read_price_files(spark, root, "all")
    assert back.columns == ["date", "state", "market", "price_modal"]
    n_in, n_back = panel.count(), back.count()
    assert 0.75 * n_in < n_back < n_in
    assert prices_csv.read_price_files(spark, root, "nothing_here") is None


def test_streaming_ingest_is_idempotent(spark):
    from panelmill.sources.files import glob
    from panelmill.streaming.ingest import ingest_sites
    root = scratch_path(spark, "t-stream")
    prices_csv.write_price_files(B.market_panel(spark, SF_SMALL), root, "all")
    table, ckpt = scratch_path(spark, "t-table"), scratch_path(spark, "t-ckpt")
    folders = glob(spark, f"{root}/*_all")
    ingest_sites(spark, folders, table, ckpt)
    n1 = spark.read.parquet(table).count()
    ingest_sites(spark, folders, table, ckpt)  # nothing new: no duplicates
    assert spark.read.parquet(table).count() == n1
    assert n1 == prices_csv.read_price_files(spark, root, "all").count()


def test_output_tables_written(spark):
    from panelmill.plans.outputs import write_outputs
    out = scratch_path(spark, "t-out")
    paths = write_outputs(spark, SF_SMALL, out, ["welfare_scenarios", "sensitivity_elasticity"])
    assert spark.read.parquet(paths["welfare_scenarios"]).count() == 24
    assert spark.read.parquet(paths["sensitivity_elasticity"]).count() == 30


@pytest.fixture(scope="module")
def small_trees():
    """Small ensembles: the tests look at shapes and keys, not at accuracy. The fits are shared by the tests."""
    from panelmill import session
    from panelmill.operators import ensembles as E
    from panelmill.plans import q_models as Q
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Q, "learners", lambda spark: {"rf": E.Forest(3, 3), "gb": E.Boosted(3, 2)})
        patch.setattr(session, "_REMEMBERED", {})
        yield Q


def test_long_predictions_of_all_models(spark, small_trees):
    Q = small_trees
    p = Q.long_predictions(spark, SF_SMALL)
    n = {(r.regime, r.model): r["count"] for r in p.groupBy("regime", "model").count().collect()}
    assert set(n) == {(g, m) for g in "AB" for m in ("naive", "sarima_fix", "sarima_aic", "ets", "rf", "gb")}
    assert len(set(n.values())) == 1  # as many rows for every model
    _, imp = Q.regime_predictions(spark, SF_SMALL)
    sums = {(r.commodity, r.regime, r.model): r.s for r in imp.groupBy("commodity", "regime", "model").agg({"importance": "sum"})
            .withColumnRenamed("sum(importance)", "s").collect()}
    assert len(sums) == 4 * imp.select("commodity").distinct().count() and all(abs(v - 1.0) < 1e-6 for v in sums.values())
    feats = {(r.regime, r.feature) for r in imp.collect()}
    assert ("A", "msp_current") in feats and ("B", "msp_current") not in feats  # regime B is policy-neutral
    top = Q.m3_o3_top_features(spark, SF_SMALL).collect()
    assert {r["rank"] for r in top} == {1, 2, 3} and len(top) == 3 * len(sums)  # per commodity, regime and model
    board = Q.o2_leaderboard(spark, SF_SMALL).collect()
    assert {r["rank"] for r in board} == set(range(1, 7)) and len({r.commodity for r in board}) * 12 == len(board)
    dm = Q.g12_models_vs_naive(spark, SF_SMALL).collect()
    assert len(dm) == len({r.commodity for r in board}) * 2 * 5 * 2
    keys = Q.m1_m2_m9_keys(spark, SF_SMALL)
    assert keys.where("not inside").count() == 0


def test_policy_tables_from_forest_prices(spark, small_trees):
    from panelmill.plans import q_chain as C
    params = C.forest_params(spark, SF_SMALL).collect()
    prices = {r.commodity: r for r in small_trees.g17_model_prices(spark, SF_SMALL).where("regime = 'B' AND model = 'rf'").collect()}
    assert {r.commodity: r.p for r in params} == {k: v.forecast_price for k, v in prices.items()}
    assert C.v6_scenarios_forest(spark, SF_SMALL).count() == 4 * len(params)
    regret = C.v5_regret_models(spark, SF_SMALL).collect()
    assert len(regret) == len(params) * 2 * 6 and all(r.regret >= 0 for r in regret)


def test_rolling_cv_has_the_naive_and_every_commodity(spark, small_trees):
    from panelmill.operators import ensembles as E
    from panelmill.operators import models as ML
    Q = small_trees
    fm = ML.rolling_cv(Q.panel(spark, SF_SMALL), Q.FOLDS, {"rf": E.Forest(2, 2)}).collect()
    assert {r.model for r in fm} == {"rf", "naive"} and {r.fold for r in fm} == {1, 2, 3}
    assert len({r.commodity for r in fm}) * 6 == len(fm)


def test_weather_payload_text_and_missing_sources(spark):
    import json
    from panelmill.sources.weather import first_existing, parse_payload_text, read_weather_csv
    doc = {"properties": {"parameter": {
        "T2M_MAX": {"20200101": 30.5, "20200102": 31.0}, "T2M_MIN": {"20200101": 20.0},
        "PRECTOTCORR": {"20200101": 1.5, "20200102": 0.0}, "RH2M": {"20200102": 55.0}}}}
    df = spark.createDataFrame([("Somewhere", json.dumps(doc))], "state string, payload string")
    rows = {r.date.isoformat(): r for r in parse_payload_text(df, "payload").collect()}
    assert rows["2020-01-01"].max_temp == 30.5 and rows["2020-01-01"].humidity is None
    assert rows["2020-01-02"].min_temp is None and rows["2020-01-02"].humidity == 55.0
    missing = scratch_path(spark, "nothing")
    assert first_existing(spark, [(missing, read_weather_csv)]) is None


def test_aic_selection_picks_the_smallest_aic(spark):
    import numpy as np
    import pandas as pd
    from panelmill.operators.series import ORDERS, forecast_series, innovations, sarima_fit, select_orders
    rng = np.random.default_rng(5)
    y = 100 + np.cumsum(rng.normal(0, 1, 300)) + 5 * np.sin(2 * np.pi * np.arange(300) / 7)
    dates = pd.date_range("2020-01-01", periods=300, freq="D")
    pdf = pd.DataFrame({"market": "m", "date": dates.date, "y": y,
                        "horizon_end": [dates[-1].date() + pd.Timedelta(days=10)] * 300})
    pdf = pd.concat([pdf, pdf.iloc[:12].assign(market="short")])
    train = spark.createDataFrame(pdf, "market string, date date, y double, horizon_end date")
    out = forecast_series(train, ["market"], ["sarima_aic"]).where("market = 'm'").toPandas()
    assert len(out) == 10 and set(out["status"]) == {"ok"}
    w, e = innovations(y)
    best = min((sarima_fit(w, e, p, q)[2], (p, q)) for p, q in ORDERS)
    assert out["params"].iloc[0].startswith(f"order=({best[1][0]},1,{best[1][1]})")
    orders = select_orders(train, ["market"]).collect()  # one row: nothing fits the short series
    assert [(r.market, r.p, r.q) for r in orders] == [("m", *best[1])] and abs(orders[0].aic - best[0]) < 1e-9


def _write(path, text):
    from pathlib import Path
    folder = Path(path.removeprefix("file:"))
    folder.parent.mkdir(parents=True, exist_ok=True)
    folder.write_text(text)


def test_mixed_headers_in_one_folder_and_malformed_rows(spark):
    from panelmill.streaming.ingest import ingest_sites
    root = scratch_path(spark, "t-mixed")
    _write(f"{root}/a_all/one.csv", "date,market,state,modal_price\n1/2/2020,M1,S1,10\n"
           "03/02/2020,M1,S1,11,z,too,many\n4/2/2020,M1,S1,12\n5/2/2020,M9\n")
    _write(f"{root}/a_all/two.csv", "date,state,market,modal_price\n01-Feb-2020,S2,M2,20\nnever,S2,M2,21\n")
    want = {("M1", "S1", 10.0), ("M1", "S1", 12.0), ("M2", "S2", 20.0)}
    got = prices_csv.read_price_files(spark, root, "all").collect()
    assert {(r.market, r.state, r.price_modal) for r in got} == want and len(got) == 3
    table, ckpt = scratch_path(spark, "t-mixed-table"), scratch_path(spark, "t-mixed-ckpt")
    ingest_sites(spark, [f"{root}/a_all"], table, ckpt)
    _write(f"{root}/a_all/three.csv", "modal_price,market,date,state\n30,M3,2020-02-01 00:00:00,S3\n")
    ingest_sites(spark, [f"{root}/a_all"], table, ckpt)
    got = spark.read.parquet(table).collect()
    assert {(r.market, r.state, r.price_modal) for r in got} == want | {("M3", "S3", 30.0)} and len(got) == 4


def test_seven_spellings_of_one_day(spark):
    import datetime as dt
    from panelmill.functions.calendar import parse_day_first
    texts = ["1/2/2020", "01-Feb-2020", "1 Feb 2020", "01/02/20", "2020-02-01 00:00:00", "01.02.2020",
             "February 1, 2020"]
    df = spark.createDataFrame([(t,) for t in texts + ["31/02/2020", "1 Foo 2020", "", None]], "t string")
    got = [r.d for r in df.select(parse_day_first("t").alias("d")).collect()]
    assert got == [dt.date(2020, 2, 1)] * 7 + [None] * 4
