"""Entry 1 of the reference: raw panel -> 39-feature panel (one Spark plan).

Steps: impute (W5/W6) -> cross-market (W12; it only reads the imputed price,
so running it first gives the same values as the reference's order) ->
price features (W1-W4, P5) -> calendar (F1/F2) -> weather (W10/W11/G4 on the
covariate table, J1, P6) -> policy (J2/J3, W8/W9) -> target (W7) -> drop (P4).

All series windows share the partitioning on ``keys`` so Spark exchanges
the panel once for them; the weather and policy joins are keyed joins
whose small side AQE may broadcast after measuring it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelmill.functions.calendar import CALENDAR_SQL, CYCLICAL_SQL, add_temporal_features
from panelmill.operators.blocked import in_blocks, interpolate_in_blocks, numbered
from panelmill.operators.impute import impute_prices, interpolate_sql
from panelmill.operators.joins import (add_cross_features, add_policy_features,
                                       join_weather, weather_features)
from panelmill.operators.windows import add_lead_target, add_price_features
from panelmill.params import MOVING_WINDOWS, PRICE_LAGS

LOOK_BACK = 30  # rows that any feature looks back: the longest lag and window; a policy change is lagged by 1 + 7 rows

PRICE_FEATURES = ([f"price_lag{k}" for k in PRICE_LAGS] + [f"price_ma{n}" for n in MOVING_WINDOWS]
                  + ["price_std7", "price_std30", "price_ret1", "price_ret7", "price_momentum"])
CALENDAR_FEATURES = ["day_of_week", "day_of_month", "month", "quarter", "week_of_year", "year",
                     "month_sin", "month_cos"]
WEATHER_FEATURES = ["max_temp", "min_temp", "rainfall_daily", "humidity", "temp_range",
                    "temp_anomaly", "extreme_heat_days", "rainfall_7d_cum", "drought_indicator"]
POLICY_FEATURES = ["msp_current", "price_to_msp_ratio", "msp_change_pct", "msp_current_lag7",
                   "price_to_msp_ratio_lag7", "msp_change_pct_lag7"]
CROSS_FEATURES = ["price_spread_from_mean", "price_relative"]
ALL_FEATURES = (PRICE_FEATURES + CALENDAR_FEATURES + WEATHER_FEATURES + POLICY_FEATURES
                + CROSS_FEATURES)


def build_feature_panel(panel: DataFrame, covariates: DataFrame | None, policy: DataFrame | None,
                        keys: Sequence[str] = ("commodity", "market"), order: str = "date",
                        horizon: int = 1, block_rows: int | None = None) -> DataFrame:
    """``block_rows``: compute all series windows block by block (``operators.blocked``), for series too long for a task."""
    if block_rows:
        df = interpolate_in_blocks(numbered(panel, keys, order), "price_modal", keys, order, block_rows)
    else:
        df = impute_prices(panel, "price_modal", keys, order)
    # W12 needs only the imputed price, so it runs here: the table it materialises
    # is the narrow imputed panel, and every series window below (features,
    # policy lags, target) then shares one exchange on ``keys``.
    by = ["commodity", order] if "commodity" in df.columns else [order]
    df = add_cross_features(df, "price_modal", by)
    weather = weather_features(covariates, block_rows=block_rows) if covariates is not None else None

    def features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        df = add_price_features(df, "price_modal", keys, order)
        df = add_temporal_features(df, order)
        if weather is not None:
            df = join_weather(df, weather)
        if policy is not None and "commodity" in df.columns:
            df = add_policy_features(df, policy, keys, order)
        return add_lead_target(df, "price_modal", horizon, keys, order)

    if block_rows:
        df = in_blocks(df, keys, order, features, LOOK_BACK, horizon, block_rows, placed=True).drop("_pos")
    else:
        df = features(df, keys)
    return df.na.drop(subset=["price_target", "price_lag7", "price_ma7"])


def feature_panel_sql(src: str = "cpanel", keys: str = "commodity, market") -> dict[str, tuple]:
    """CTE bodies (name -> (sql, deps)) of the DuckDB twin of ``build_feature_panel``."""
    w = f"PARTITION BY {keys} ORDER BY date"
    lags = ", ".join(f"lag(price_modal, {k}) OVER w AS price_lag{k}" for k in PRICE_LAGS)
    mas = ", ".join(f"avg(price_modal) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                    f" AS price_ma{n}" for n in MOVING_WINDOWS)
    sds = ", ".join(
        f"CASE WHEN count(price_modal) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        f" >= {mp} THEN stddev_samp(price_modal) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND"
        f" CURRENT ROW) END AS price_std{n}" for n, mp in [(7, 2), (30, 5)])
    rets = ", ".join(f"CASE WHEN lag(price_modal, {k}) OVER w = 0 THEN NULL ELSE price_modal"
                     f" / lag(price_modal, {k}) OVER w END - 1 AS price_ret{k}" for k in (1, 7))
    return {
        "fp_imp": (interpolate_sql(src, keys=keys), (src,)),
        "fp_price": (f"""SELECT *, price_modal - price_ma30 AS price_momentum FROM (
            SELECT *, {lags}, {mas}, {sds}, {rets} FROM fp_imp WINDOW w AS ({w}))""",
                     ("fp_imp",)),
        "fp_cal": (f"""SELECT *, {CYCLICAL_SQL} FROM (
            SELECT *, {CALENDAR_SQL.format(d='date')} FROM fp_price)""", ("fp_price",)),
        "wfeat": ("""SELECT c.*, q.rain_p25 FROM (
            SELECT *, max_temp - min_temp AS temp_range,
              max_temp - CASE WHEN count(max_temp) OVER w30 >= 7 THEN avg(max_temp) OVER w30 END
                AS temp_anomaly,
              CASE WHEN count(rainfall_daily) OVER w7 >= 1 THEN sum(rainfall_daily) OVER w7 END
                AS rainfall_7d_cum,
              month(date) AS _month
            FROM covariates
            WINDOW w30 AS (PARTITION BY state ORDER BY date
                           ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
                   w7 AS (PARTITION BY state ORDER BY date
                          ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) c
          LEFT JOIN (SELECT state, month(date) AS _month,
                       quantile_cont(CAST(rainfall_daily AS DOUBLE), 0.25) AS rain_p25
                     FROM covariates GROUP BY 1, 2) q
            ON c.state = q.state AND c._month = q._month""", ("covariates",)),
        "fp_wx": ("""SELECT p.*, w.max_temp, w.min_temp, w.rainfall_daily, w.humidity,
              w.temp_range, w.temp_anomaly, w.rainfall_7d_cum,
              CAST(coalesce(w.max_temp > 40, false) AS INTEGER) AS extreme_heat_days,
              CAST(coalesce(w.rainfall_daily < w.rain_p25, false) AS INTEGER) AS drought_indicator
            FROM fp_cal p LEFT JOIN wfeat w ON p.state = w.state AND p.date = w.date""",
                  ("fp_cal", "wfeat")),
        "pol_iv": ("""SELECT crop, msp_rs_per_quintal AS msp_current,
              CASE WHEN row_number() OVER (PARTITION BY crop ORDER BY year) = 1
                   THEN -2147483648 ELSE year END AS _from,
              coalesce(lead(year) OVER (PARTITION BY crop ORDER BY year), 2147483647) AS _to
            FROM policy""", ("policy",)),
        "fp_pol0": ("""SELECT p.*, i.msp_current FROM fp_wx p LEFT JOIN pol_iv i
              ON p.commodity = i.crop AND year(p.date) >= i._from AND year(p.date) < i._to""",
                    ("fp_wx", "pol_iv")),
        "fp_pol1": (f"""SELECT *,
              CASE WHEN msp_current = 0 THEN NULL ELSE price_modal / msp_current END
                AS price_to_msp_ratio,
              coalesce(CASE WHEN lag(msp_current) OVER w = 0 THEN NULL
                            ELSE msp_current / lag(msp_current) OVER w END - 1, 0.0)
                AS msp_change_pct
            FROM fp_pol0 WINDOW w AS ({w})""", ("fp_pol0",)),
        "fp_pol": (f"""SELECT *, lag(msp_current, 7) OVER w AS msp_current_lag7,
              lag(price_to_msp_ratio, 7) OVER w AS price_to_msp_ratio_lag7,
              lag(msp_change_pct, 7) OVER w AS msp_change_pct_lag7
            FROM fp_pol1 WINDOW w AS ({w})""", ("fp_pol1",)),
        "fp_x": ("""SELECT p.*, p.price_modal - m.dm AS price_spread_from_mean,
              CASE WHEN m.dm = 0 THEN NULL ELSE p.price_modal / m.dm END AS price_relative
            FROM fp_pol p JOIN (SELECT commodity, date, avg(price_modal) AS dm FROM fp_pol
                                GROUP BY 1, 2) m
              ON p.commodity = m.commodity AND p.date = m.date""", ("fp_pol",)),
        "fpanel": (f"""SELECT * FROM (SELECT *, lead(price_modal, 1) OVER ({w}) AS price_target
              FROM fp_x)
            WHERE price_target IS NOT NULL AND price_lag7 IS NOT NULL
              AND price_ma7 IS NOT NULL""", ("fp_x",)),
    }
