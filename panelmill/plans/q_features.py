"""Queries for the price panel: imputation, window features, calendar (W*, F1/F2, G1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.functions.calendar import CALENDAR_SQL, CYCLICAL_SQL, add_temporal_features
from panelmill.operators import blocked as BL
from panelmill.operators import windows as W
from panelmill.operators.aggregates import daily_mean
from panelmill.params import MOVING_WINDOWS, PRICE_LAGS
from panelmill.plans.common import imputed_spine, r, rounded
from panelmill.plans.registry import query

KEYS = ("market",)


def price_feature_sql() -> str:
    lags = ",\n".join(f"lag(price_modal, {k}) OVER w AS price_lag{k}" for k in PRICE_LAGS)
    mas = ",\n".join(f"avg(price_modal) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                     f" AS price_ma{n}" for n in MOVING_WINDOWS)
    sds = ",\n".join(
        f"CASE WHEN count(price_modal) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        f" >= {mp} THEN stddev_samp(price_modal) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND"
        f" CURRENT ROW) END AS price_std{n}" for n, mp in [(7, 2), (30, 5)])
    rets = ",\n".join(f"CASE WHEN lag(price_modal, {k}) OVER w = 0 THEN NULL ELSE price_modal"
                      f" / lag(price_modal, {k}) OVER w END - 1 AS price_ret{k}" for k in (1, 7))
    return f"""SELECT *, {lags}, {mas}, {sds}, {rets},
        lead(price_modal, 1) OVER w AS price_target
      FROM imputed WINDOW w AS (PARTITION BY market ORDER BY date)"""


B.register_cte("pfeat", price_feature_sql(), ("imputed",))


def price_features(spark, sf_dir):
    df = W.add_price_features(imputed_spine(spark, sf_dir), keys=KEYS)
    return W.add_lead_target(df, keys=KEYS)


@query("w5_interpolate", B.sql_with("imputed") + f"""
  SELECT state, market, date, {r('price_modal', 'price_modal')} FROM imputed""")
def w5_interpolate(spark, sf_dir):
    return rounded(imputed_spine(spark, sf_dir).select("state", "market", "date", "price_modal"))


@query("w1_lags", B.sql_with("pfeat") + "SELECT market, date, "
       + ", ".join(r(f"price_lag{k}", f"price_lag{k}") for k in PRICE_LAGS) + " FROM pfeat")
def w1_lags(spark, sf_dir):
    return rounded(price_features(spark, sf_dir)
                   .select("market", "date", *[f"price_lag{k}" for k in PRICE_LAGS]))


@query("w2_moving_means", B.sql_with("pfeat") + "SELECT market, date, "
       + ", ".join(r(f"price_ma{n}", f"price_ma{n}") for n in MOVING_WINDOWS) + " FROM pfeat")
def w2_moving_means(spark, sf_dir):
    return rounded(price_features(spark, sf_dir)
                   .select("market", "date", *[f"price_ma{n}" for n in MOVING_WINDOWS]))


@query("w3_rolling_sd", B.sql_with("pfeat") + f"""
  SELECT market, date, {r('price_std7', 'price_std7')}, {r('price_std30', 'price_std30')}
  FROM pfeat""")
def w3_rolling_sd(spark, sf_dir):
    return rounded(price_features(spark, sf_dir)
                   .select("market", "date", "price_std7", "price_std30"))


@query("w4_returns", B.sql_with("pfeat") + f"""
  SELECT market, date, {r('price_ret1', 'price_ret1')}, {r('price_ret7', 'price_ret7')},
    {r('price_modal - price_ma30', 'price_momentum')}
  FROM pfeat""")
def w4_returns(spark, sf_dir):
    return rounded(price_features(spark, sf_dir)
                   .select("market", "date", "price_ret1", "price_ret7", "price_momentum"))


@query("w7_target", B.sql_with("pfeat") + f"""
  SELECT market, date, {r('price_target', 'price_target')} FROM pfeat""")
def w7_target(spark, sf_dir):
    return rounded(price_features(spark, sf_dir).select("market", "date", "price_target"))


def blocked_spine(spark, sf_dir, rows):
    """The imputed spine by blocks of ``rows`` rows, with its places."""
    return BL.interpolate_in_blocks(BL.numbered(B.spine(spark, sf_dir), KEYS, "date"), "price_modal", KEYS, "date", rows)


@query("w5_interpolate_blocked", B.sql_with("imputed") + f"""
  SELECT state, market, date, {r('price_modal', 'price_modal')} FROM imputed""")
def w5_interpolate_blocked(spark, sf_dir):
    """W5/W6 with the carry by block summaries: the path of a series too long for one task."""
    return rounded(blocked_spine(spark, sf_dir, 512).select("state", "market", "date", "price_modal"))


BLOCKED = ([f"price_lag{k}" for k in PRICE_LAGS] + [f"price_ma{n}" for n in MOVING_WINDOWS]
           + ["price_std7", "price_std30", "price_ret1", "price_ret7", "price_target"])


@query("w1_w7_blocked", B.sql_with("pfeat") + "SELECT market, date, " + ", ".join(r(c, c) for c in BLOCKED) + " FROM pfeat")
def w1_w7_blocked(spark, sf_dir):
    """W1-W4, W7 (and W15, which is the lag of 7) over blocks of 512 rows with halos of 30 rows and one row."""
    def features(df, keys):
        return W.add_lead_target(W.add_price_features(df, keys=keys), keys=keys)
    df = BL.in_blocks(blocked_spine(spark, sf_dir, 512), KEYS, "date", features, 30, 1, 512, placed=True)
    return rounded(df.select("market", "date", *BLOCKED))


@query("f1_calendar", B.sql_with("panel") + f"""
  SELECT market, date, {CALENDAR_SQL.format(d='date')} FROM panel""")
def f1_calendar(spark, sf_dir):
    df = add_temporal_features(B.market_panel(spark, sf_dir))
    return df.select("market", "date", "day_of_week", "day_of_month", "month", "quarter",
                     "week_of_year", "year")


@query("f2_cyclical_month", B.sql_with("panel") + f"""
  SELECT market, date, {r('month_sin', 'month_sin')}, {r('month_cos', 'month_cos')}
  FROM (SELECT market, date, {CYCLICAL_SQL} FROM (SELECT *, month(date) AS month FROM panel))""")
def f2_cyclical(spark, sf_dir):
    df = add_temporal_features(B.market_panel(spark, sf_dir))
    return rounded(df.select("market", "date", "month_sin", "month_cos"))


FEATURE_NUMERIC = (["price_modal"] + [f"price_lag{k}" for k in PRICE_LAGS]
                   + [f"price_ma{n}" for n in MOVING_WINDOWS]
                   + ["price_std7", "price_std30", "price_ret1", "price_ret7", "price_target"])


def flagship(spark, sf_dir):
    """Binding panel -> day spine -> W5 -> W1-W4, W7 -> P4 -> G1 (daily mean over markets)."""
    feats = price_features(spark, sf_dir).na.drop(subset=["price_target", "price_lag7",
                                                          "price_ma7"])
    return rounded(daily_mean(feats, FEATURE_NUMERIC, keys=("date",)))


@query("g1_daily_mean", B.sql_with("pfeat") + "SELECT date, "
       + ", ".join(r(f"avg({c})", c) for c in FEATURE_NUMERIC) + """
  FROM pfeat
  WHERE price_target IS NOT NULL AND price_lag7 IS NOT NULL AND price_ma7 IS NOT NULL
  GROUP BY date""")
def g1_daily_mean(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("w20_position", B.sql_with("panel") + """
  SELECT market, date, CAST(row_number() OVER (PARTITION BY market ORDER BY date) AS INTEGER)
    AS rn FROM panel""")
def w20_position(spark, sf_dir):
    return W.add_position(B.market_panel(spark, sf_dir), KEYS).select("market", "date", "rn")


@query("o4_last_730", B.sql_with("imputed") + f"""
  SELECT market, date, {r('price_modal', 'price_modal')} FROM (
    SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS rn FROM imputed)
  WHERE rn <= 730""")
def o4_last_730(spark, sf_dir):
    """The last 730 points of every series (a per-series limit, the feature itself)."""
    df = W.add_position(imputed_spine(spark, sf_dir), KEYS, descending=True)
    return rounded(df.where(F.col("rn") <= 730).select("market", "date", "price_modal"))


LOOK = ["price_modal", "price_lag1", "price_ma7"]


@query("w16_lookback_multi", B.sql_with("pfeat") + f"""
  SELECT market, date, seq FROM (
    SELECT market, date, list_transform(list([{', '.join(LOOK)}]) OVER (PARTITION BY market ORDER BY date
        ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
      lambda v: list_transform(v, lambda x: floor(((x * 1e4 + 0.5) + 1e-6) + abs(x) * 1e-8) / 1e4)) AS seq
    FROM pfeat) WHERE len(seq) = 30""")
def w16_lookback_multi(spark, sf_dir):
    """Look-back windows of 30 rows x 3 features."""
    df = W.lookback_windows(price_features(spark, sf_dir), LOOK, 30, KEYS, out="seq")
    half_up = lambda x: F.floor(((x * 1e4 + 0.5) + 1e-6) + F.abs(x) * 1e-8).cast("double") / 1e4
    return df.select("market", "date", F.transform("seq", lambda v: F.transform(v, half_up)).alias("seq"))


@query("w16_lookback", B.sql_with("imputed") + """
  SELECT market, date, seq FROM (
    SELECT market, date,
      list_transform(list(price_modal) OVER (PARTITION BY market ORDER BY date
                     ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
                     lambda x: floor(((x * 1e4 + 0.5) + 1e-6) + abs(x) * 1e-8) / 1e4) AS seq
    FROM imputed) WHERE len(seq) = 30""")
def w16_lookback(spark, sf_dir):
    df = W.lookback_sequences(imputed_spine(spark, sf_dir), "price_modal", 30, KEYS)
    return df.select("market", "date",
                     F.transform("seq", lambda x: F.floor(((x * 1e4 + 0.5) + 1e-6) + F.abs(x) * 1e-8)
                                 .cast("double") / 1e4)
                     .alias("seq"))
