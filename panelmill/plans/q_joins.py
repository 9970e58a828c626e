"""Queries for joins, covariates, policy lookup and the full feature panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.operators import joins as J
from panelmill.operators import selection as P
from panelmill.operators import windows as W
from panelmill.operators.blocked import as_of, in_blocks
from panelmill.params import FOLDS, TEST_START, TRAIN_END
from panelmill.plans.common import imputed_spine, r, rounded
from panelmill.plans.features import ALL_FEATURES, build_feature_panel, feature_panel_sql
from panelmill.plans.registry import query

for _name, (_body, _deps) in feature_panel_sql().items():
    B.register_cte(_name, _body, _deps)


def feature_panel(spark, sf_dir, cube=None):
    """Panel and policy table come from one materialised (commodity, nation, day) cube,
    so the fact table is scanned and joined once for both."""
    from panelmill.session import materialize
    cube = cube if cube is not None else materialize(B.commodity_cube(spark, sf_dir))
    return build_feature_panel(B.commodity_panel(spark, sf_dir, cube),
                               B.covariates(spark, sf_dir), B.policy(spark, sf_dir, cube))


INT_FEATURES = {"day_of_week", "day_of_month", "month", "quarter", "week_of_year", "year",
                "extreme_heat_days", "drought_indicator"}


def _sel(cols):
    return ", ".join(c if c in INT_FEATURES else r(c, c) for c in cols)


FP_COLS = ["commodity", "market", "date"]


@query("feature_panel", B.sql_with("fpanel") + f"""
  SELECT commodity, state, market, date, {r('price_modal', 'price_modal')},
    {_sel(ALL_FEATURES)}, {r('price_target', 'price_target')} FROM fpanel""")
def q_feature_panel(spark, sf_dir):
    """Entry 1: the 39-feature panel on (commodity, market) daily series."""
    df = feature_panel(spark, sf_dir)
    return rounded(df.select("commodity", "state", "market", "date", "price_modal",
                             *ALL_FEATURES, "price_target"))


@query("p1_feature_columns", B.sql_with("fpanel") + f"""
  SELECT {', '.join(FP_COLS)}, {_sel(ALL_FEATURES)} FROM fpanel""")
def p1_feature_columns(spark, sf_dir):
    df = feature_panel(spark, sf_dir)
    return rounded(df.select(*FP_COLS, *P.feature_columns(df)))


@query("p2_policy_neutral", B.sql_with("fpanel") + f"""
  SELECT {', '.join(FP_COLS)},
    {_sel([c for c in ALL_FEATURES if c not in P.POLICY_COLUMNS])} FROM fpanel""")
def p2_policy_neutral(spark, sf_dir):
    df = feature_panel(spark, sf_dir)
    return rounded(df.select(*FP_COLS, *P.feature_columns(df, policy_neutral=True)))


@query("j1_weather_join", B.sql_with("panel", "wfeat") + f"""
  SELECT p.state, p.market, p.date, {r('w.max_temp', 'max_temp')}, {r('w.min_temp', 'min_temp')},
    {r('w.rainfall_daily', 'rainfall_daily')}, {r('w.humidity', 'humidity')},
    {r('w.temp_range', 'temp_range')}, {r('w.temp_anomaly', 'temp_anomaly')},
    {r('w.rainfall_7d_cum', 'rainfall_7d_cum')},
    CAST(coalesce(w.max_temp > 40, false) AS INTEGER) AS extreme_heat_days,
    CAST(coalesce(w.rainfall_daily < w.rain_p25, false) AS INTEGER) AS drought_indicator
  FROM panel p LEFT JOIN wfeat w ON p.state = w.state AND p.date = w.date""")
def j1_weather_join(spark, sf_dir):
    wf = J.weather_features(B.covariates(spark, sf_dir))
    df = J.join_weather(B.market_panel(spark, sf_dir), wf)
    return rounded(df.select("state", "market", "date", "max_temp", "min_temp", "rainfall_daily",
                             "humidity", "temp_range", "temp_anomaly", "rainfall_7d_cum",
                             "extreme_heat_days", "drought_indicator"))


B.register_cte("fact_quantiles", """SELECT l_returnflag, quantile_cont(x, 0.5) AS median_msp, quantile_cont(x, 0.05) AS ci_lower,
    quantile_cont(x, 0.95) AS ci_upper, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS ci_width, stddev_pop(x) AS sd
  FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem) GROUP BY 1""", ())


@query("w10_temp_anomaly", B.sql_with("wfeat") + f"""
  SELECT state, date, {r('temp_anomaly', 'temp_anomaly')} FROM wfeat""")
def w10_temp_anomaly(spark, sf_dir):
    df = W.add_rolling_anomaly(B.covariates(spark, sf_dir), "max_temp", ("state",), "date",
                               30, 7, "temp_anomaly")
    return rounded(df.select("state", "date", "temp_anomaly"))


@query("w11_rainfall_7d", B.sql_with("wfeat") + f"""
  SELECT state, date, {r('rainfall_7d_cum', 'rainfall_7d_cum')} FROM wfeat""")
def w11_rainfall_7d(spark, sf_dir):
    df = W.add_rolling_sum(B.covariates(spark, sf_dir), "rainfall_daily", ("state",), "date", 7)
    return rounded(df.select("state", "date", "rainfall_7d_cum"))


@query("g4_rain_p25", B.sql_with("covariates") + f"""
  SELECT state, CAST(month(date) AS INTEGER) AS month,
    {r('quantile_cont(CAST(rainfall_daily AS DOUBLE), 0.25)', 'rain_p25')}
  FROM covariates GROUP BY 1, 2""")
def g4_rain_p25(spark, sf_dir):
    from panelmill.operators.aggregates import group_quantile
    cov = B.covariates(spark, sf_dir).withColumn("month", F.month("date").cast("int"))
    return rounded(group_quantile(cov, "rainfall_daily", ["state", "month"], 0.25, "rain_p25"))


@query("w10_w11_blocked", B.sql_with("wfeat") + f"""
  SELECT state, date, {r('temp_anomaly', 'temp_anomaly')}, {r('rainfall_7d_cum', 'rainfall_7d_cum')} FROM wfeat""")
def w10_w11_blocked(spark, sf_dir):
    """W10 and W11 over blocks of 256 rows with halos of 30 rows."""
    def features(df, keys):
        df = W.add_rolling_anomaly(df, "max_temp", keys, "date", 30, 7, "temp_anomaly")
        return W.add_rolling_sum(df, "rainfall_daily", keys, "date", 7)
    df = in_blocks(B.covariates(spark, sf_dir), ["state"], "date", features, 30, 0, 256)
    return rounded(df.select("state", "date", "temp_anomaly", "rainfall_7d_cum"))


@query("g4_rain_p25_selected", B.sql_with("covariates") + f"""
  SELECT state, CAST(month(date) AS INTEGER) AS month,
    {r('quantile_cont(CAST(rainfall_daily AS DOUBLE), 0.25)', 'rain_p25')}
  FROM covariates GROUP BY 1, 2""")
def g4_rain_p25_selected(spark, sf_dir):
    """G4 by distributed selection."""
    from panelmill.operators.aggregates import group_quantile
    cov = B.covariates(spark, sf_dir).withColumn("month", F.month("date").cast("int"))
    return rounded(group_quantile(cov, "rainfall_daily", ["state", "month"], 0.25, "rain_p25", "select"))


@query("g13_price_quantiles", B.sql_with("fact_quantiles") + f"""
  SELECT l_returnflag, {r('median_msp', 'median_msp')}, {r('ci_lower', 'ci_lower')}, {r('ci_upper', 'ci_upper')},
    {r('ci_width', 'ci_width')}, {r('sd', 'sd')} FROM fact_quantiles""")
def g13_price_quantiles(spark, sf_dir):
    """G13 over all fact rows: three groups, each too large for one task's map at scale, by distributed selection."""
    from panelmill.operators.aggregates import quantile_summary
    x = B.table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    return rounded(quantile_summary(x.withColumn("x", F.col("l_extendedprice").cast("double")), "x", ["l_returnflag"], "select"))


@query("j3_asof_policy", B.sql_with("fp_pol0") + f"""
  SELECT commodity, market, date, {r('msp_current', 'msp_current')} FROM fp_pol0""")
def j3_asof_policy(spark, sf_dir):
    from panelmill.session import materialize
    cube = materialize(B.commodity_cube(spark, sf_dir))
    pol = B.policy(spark, sf_dir, cube).select("crop", F.col("year").alias("_pyear"),
                                         F.col("msp_rs_per_quintal").alias("msp_current"))
    df = B.commodity_panel(spark, sf_dir, cube).withColumn("_y", F.year("date"))
    df = J.as_of_join(df, pol, "commodity", "crop", "_y", "_pyear", ["msp_current"])
    return rounded(df.select("commodity", "market", "date", "msp_current"))


@query("j3_asof_daily", B.sql_with("panel", "covariates") + f"""
  SELECT panel.state, panel.market, panel.date, dim.date AS as_of, {r('dim.max_temp', 'max_temp')}, {r('dim.rainfall_daily', 'rainfall_daily')}
  FROM panel ASOF LEFT JOIN (SELECT * FROM covariates WHERE max_temp > 45 AND day(date) % 3 = 0) dim
    ON panel.state = dim.state AND panel.date >= dim.date""")
def j3_asof_daily(spark, sf_dir):
    """J3 at day grain: the last very hot day of the state at or before each price, over blocks of 1,000 rows."""
    hot = B.covariates(spark, sf_dir).where("max_temp > 45 AND day(date) % 3 = 0")
    df = as_of(B.market_panel(spark, sf_dir).select("state", "market", "date"), hot, ["state"], "date",
               ["max_temp", "rainfall_daily"], 1000)
    return rounded(df.select("state", "market", "date", "as_of", "max_temp", "rainfall_daily"))


@query("j2_policy_features", B.sql_with("fpanel") + f"""
  SELECT commodity, market, date, {_sel(P.POLICY_COLUMNS)} FROM fpanel""")
def j2_policy_features(spark, sf_dir):
    return rounded(feature_panel(spark, sf_dir).select("commodity", "market", "date",
                                                       *P.POLICY_COLUMNS))


@query("w12_cross_market", B.sql_with("imputed") + f"""
  SELECT p.market, p.date, {r('p.price_modal - m.dm', 'price_spread_from_mean')},
    {r('CASE WHEN m.dm = 0 THEN NULL ELSE p.price_modal / m.dm END', 'price_relative')}
  FROM imputed p JOIN (SELECT date, avg(price_modal) AS dm FROM imputed GROUP BY date) m
    ON p.date = m.date""")
def w12_cross_market(spark, sf_dir):
    df = J.add_cross_features(imputed_spine(spark, sf_dir), "price_modal", ["date"])
    return rounded(df.select("market", "date", "price_spread_from_mean", "price_relative"))


@query("j4_cv_folds", B.sql_with("panel") + """
  SELECT p.market, p.date, f.fold,
    CASE WHEN p.date <= f.train_end THEN 'train' ELSE 'test' END AS role
  FROM panel p JOIN (VALUES """ + ", ".join(
    f"({i}, DATE '{a}', DATE '{b}', DATE '{c}')" for i, a, b, c in FOLDS) + """)
    AS f(fold, train_end, test_start, test_end)
    ON p.date <= f.train_end OR (p.date >= f.test_start AND p.date <= f.test_end)""")
def j4_cv_folds(spark, sf_dir):
    df = J.assign_folds(B.market_panel(spark, sf_dir), FOLDS)
    return df.select("market", "date", "fold", "role")


@query("p3_temporal_split", B.sql_with("panel") + f"""
  SELECT market, date, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train'
    WHEN date >= DATE '{TEST_START}' THEN 'test' ELSE 'val' END AS split FROM panel""")
def p3_temporal_split(spark, sf_dir):
    df = P.temporal_split(B.market_panel(spark, sf_dir), TRAIN_END, TEST_START)
    return df.select("market", "date", "split")


@query("w13_covariate_lag7", B.sql_with("panel", "covariates") + f"""
  SELECT p.market, p.date,
    {r('lag(c.max_temp, 7) OVER w', 'max_temp_lag7')},
    {r('lag(c.rainfall_daily, 7) OVER w', 'rainfall_daily_lag7')}
  FROM panel p LEFT JOIN covariates c ON p.state = c.state AND p.date = c.date
  WINDOW w AS (PARTITION BY p.market ORDER BY p.date)""")
def w13_covariate_lag7(spark, sf_dir):
    df = B.market_panel(spark, sf_dir).join(B.covariates(spark, sf_dir), ["state", "date"], "left")
    w = W.series_window(("market",), "date")
    return rounded(df.select("market", "date",
                             F.lag("max_temp", 7).over(w).alias("max_temp_lag7"),
                             F.lag("rainfall_daily", 7).over(w).alias("rainfall_daily_lag7")))


@query("w14_time_trend", B.sql_with("panel") + """
  SELECT market, date, CAST(date - (SELECT min(date) FROM panel) AS INTEGER) AS trend
  FROM panel""")
def w14_time_trend(spark, sf_dir):
    return W.add_time_trend(B.market_panel(spark, sf_dir)).select("market", "date", "trend")


@query("j9_dense_grid", B.sql_with("wfeat") + """
  SELECT s.state, CAST(y.year AS INTEGER) AS year,
    CAST(coalesce(v.heat_days, 0) AS BIGINT) AS heat_days
  FROM (SELECT DISTINCT state FROM wfeat) s
  CROSS JOIN (SELECT min(year(date)) AS y0, max(year(date)) AS y1 FROM wfeat) b
  CROSS JOIN LATERAL (SELECT unnest(generate_series(b.y0, b.y1)) AS year) y
  LEFT JOIN (SELECT state, CAST(year(date) AS INTEGER) AS year,
               sum(CAST(max_temp > 40 AS INTEGER)) AS heat_days
             FROM wfeat GROUP BY 1, 2) v ON v.state = s.state AND v.year = y.year""")
def j9_dense_grid(spark, sf_dir):
    """Heat-day counts on the dense (state x every year) grid, 0 where absent.

    The year axis is a ``sequence`` over the covariate table's year range
    (scalar subqueries), exploded per state: no cross join at all.
    """
    from panelmill.session import materialize
    wf = materialize(B.covariates(spark, sf_dir))
    heat = (wf.select("state", F.year("date").cast("int").alias("year"),
                      (F.col("max_temp") > 40).cast("int").alias("heat"))
            .groupBy("state", "year").agg(F.sum("heat").cast("bigint").alias("heat_days")))
    keys = wf.select("state").distinct().select(
        "state", wf.select(F.min(F.year("date")).cast("int")).scalar().alias("y0"),
        wf.select(F.max(F.year("date")).cast("int")).scalar().alias("y1"))
    return J.dense_grid(heat, keys, "state", "year", "y0", "y1", "heat_days").select(
        "state", "year", "heat_days")


@query("j10_group_stat", B.sql_with("panel") + f"""
  SELECT market, date, {r('avg(price_modal) OVER (PARTITION BY market)', 'market_mean')}
  FROM panel""")
def j10_group_stat(spark, sf_dir):
    df = J.with_series_stat(B.market_panel(spark, sf_dir), ["market"], F.avg("price_modal"), "market_mean")
    return rounded(df.select("market", "date", "market_mean"))
