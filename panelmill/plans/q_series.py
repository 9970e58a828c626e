"""Queries for the per-series statistical forecasts (M5-M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.operators import metrics as M
from panelmill.operators import series as S
from panelmill.params import TEST_START, TRAIN_END
from panelmill.plans.common import imputed_spine, r, rounded
from panelmill.plans.registry import query
from panelmill.session import materialize

KEYS = ("market",)


ALL_KINDS = ("ets", "sarima", "sarima_aic")


def series_forecasts(spark, sf_dir, kinds):
    """Test rows of every series with the forecasts of ``kinds``; the panel is built once."""
    panel = materialize(imputed_spine(spark, sf_dir))
    train = S.training_windows(panel, KEYS, "price_modal", TRAIN_END, 730, reuse=False)
    fc = S.forecast_series(train, KEYS, kinds)
    test = panel.where(F.col("date") >= F.lit(TEST_START).cast("date")).select(
        "market", "date", F.col("price_modal").alias("y"))
    return test.join(fc, ["market", "date"]).select("market", "date", "model", "y", "y_hat",
                                                    "params", "status")


@query("m5_ets_forecast")
def m5_ets_forecast(spark, sf_dir):
    return series_forecasts(spark, sf_dir, "ets")


_WINDOW = f"""
  y AS (SELECT market, date, price_modal AS y, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS t,
          count(*) OVER (PARTITION BY market) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS back
              FROM imputed WHERE date <= DATE '{TRAIN_END}') WHERE back <= 730),
  start AS (SELECT market, any_value(n) AS n, max(date) AS last, avg(y) FILTER (t < 7) AS l0,
              avg(y) FILTER (t >= 7 AND t < 14) AS l1, list(y ORDER BY t) FILTER (t < 7) AS first FROM y GROUP BY 1)"""


def _smoothing_sql(grid) -> str:
    """The recursion over days for all parameter sets, then the set with the least SSE."""
    sets = ", ".join(f"({i}, {a!r}e0, {b!r}e0, {g!r}e0, {p!r}e0)" for i, (a, b, g, p) in enumerate(grid))
    ahead = "lev + tr * phi * (1.0e0 - power(phi, h)) / (1.0e0 - phi) + s[(start.n + h - 1) % 7 + 1]"
    return B.sql_with("imputed").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
  , {_WINDOW},
  grid AS (SELECT * FROM (VALUES {sets}) v(i, a, b, g, phi)),
  state AS (
    SELECT market, i, a, b, g, phi, CAST(0 AS BIGINT) AS t, l0 AS lev, (l1 - l0) / 7.0e0 AS tr,
      list_transform(first, lambda v: v - l0) AS s, 0.0e0 AS sse FROM start, grid
    UNION ALL
    SELECT market, i, a, b, g, phi, t + 1, nl, b * (nl - lev) + (1.0e0 - b) * phi * tr,
      list_transform(s, lambda v, k: CASE WHEN k = t % 7 + 1 THEN g * (y - nl) + (1.0e0 - g) * si ELSE v END),
      sse + power(y - (lev + phi * tr + si), 2)
    FROM (SELECT state.*, y.y, s[t % 7 + 1] AS si, a * (y.y - s[t % 7 + 1]) + (1.0e0 - a) * (lev + phi * tr) AS nl
          FROM state JOIN y USING (market, t))),
  best AS (SELECT state.* FROM state JOIN start ON state.market = start.market AND state.t = start.n
           QUALIFY row_number() OVER (PARTITION BY state.market ORDER BY sse, i) = 1)
  SELECT best.market, last + CAST(h AS INTEGER) AS date, {r(ahead, 'y_hat')}, CAST(phi AS DOUBLE) AS phi
  FROM best JOIN start USING (market), LATERAL generate_series(1, 28) g(h)"""


def month_ahead(spark, sf_dir, kind):
    train = S.training_windows(imputed_spine(spark, sf_dir), KEYS, "price_modal", TRAIN_END, 730)
    fc = S.forecast_series(train, KEYS, kind)
    return fc.where(F.datediff("date", F.lit(TRAIN_END).cast("date")) <= 28)


@query("m5_fixed_parameters", _smoothing_sql([S.ETS_FIXED]))
def m5_fixed_parameters(spark, sf_dir):
    """The smoothing recursion with one parameter set, 28 days ahead of every market's training window."""
    return rounded(month_ahead(spark, sf_dir, "ets_fixed").select(
        "market", "date", "y_hat", F.lit(S.ETS_FIXED[3]).alias("phi")))


@query("m5_grid", _smoothing_sql(S.ETS_GRID))
def m5_grid(spark, sf_dir):
    """The best of the whole parameter grid, 28 days ahead, with the damping it chose."""
    phi = F.regexp_extract("params", r"phi=([0-9.]+)", 1).cast("double")
    return rounded(month_ahead(spark, sf_dir, "ets").select("market", "date", "y_hat", phi.alias("phi")))


@query("m6_seasonal_ar", B.sql_with("imputed").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
  , {_WINDOW},
  d AS (SELECT market, t, y - lag(y, 1) OVER w - lag(y, 7) OVER w + lag(y, 8) OVER w AS w FROM y
        WINDOW w AS (PARTITION BY market ORDER BY t)),
  fit AS (SELECT x.market, sum(x.w * z.w) / sum(z.w * z.w) AS a FROM d x JOIN d z ON x.market = z.market AND z.t = x.t - 7
          WHERE z.w IS NOT NULL GROUP BY 1),
  tail AS (SELECT y.market, list(y.y ORDER BY y.t) AS ys, list(d.w ORDER BY y.t) AS ws
           FROM y JOIN d USING (market, t) WHERE y.t >= y.n - 8 GROUP BY 1),
  ahead AS (SELECT market, 0 AS h, ys, ws, a FROM tail JOIN fit USING (market)
            UNION ALL
            SELECT market, h + 1, list_append(ys[2:], a * ws[2] + ys[8] + ys[2] - ys[1]), list_append(ws[2:], a * ws[2]), a
            FROM ahead WHERE h < 28)
  SELECT ahead.market, last + CAST(h AS INTEGER) AS date, {r('ys[8]', 'y_hat')} FROM ahead JOIN start USING (market) WHERE h > 0""")
def m6_seasonal_ar(spark, sf_dir):
    """A seasonal ARIMA of fixed order, (0,1,0)(1,1,0)_7, estimated and forecast 28 days ahead."""
    return rounded(month_ahead(spark, sf_dir, "sar").select("market", "date", "y_hat"))


@query("m6_sarima_forecast")
def m6_sarima_forecast(spark, sf_dir):
    return series_forecasts(spark, sf_dir, "sarima")


@query("m7_sarima_aic_forecast")
def m7_sarima_aic_forecast(spark, sf_dir):
    return series_forecasts(spark, sf_dir, "sarima_aic")


@query("m5_m7_series_metrics")
def m5_m7_series_metrics(spark, sf_dir):
    return M.accuracy(series_forecasts(spark, sf_dir, ALL_KINDS), ["model"], ["market"])
