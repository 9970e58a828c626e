"""Queries for forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.operators import joins as J
from panelmill.functions.special import normal_two_sided, two_sided_sql
from panelmill.operators import metrics as M
from panelmill.operators import windows as W
from panelmill.operators.aggregates import column_means, impute_with_means
from panelmill.params import FOLDS, HORIZONS, TEST_START, TRAIN_END
from panelmill.plans.common import r, rounded
from panelmill.plans.q_features import price_features
from panelmill.plans.registry import query

DROP = ["price_target", "price_lag7", "price_ma7"]
MODELS = [("naive", "price_lag7"), ("ma", "price_ma7")]


def _models_array():
    return F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("y_hat"))
                     for m, c in MODELS])


def predictions(spark, sf_dir, test_only: bool = True):
    """Long predictions of two SQL-expressible models on every series.

    ``naive`` is the seasonal naive value 7 rows back (W15, computed over
    train+test rows so the first test rows reach into the train tail); ``ma``
    is the trailing 7-row mean. Both predict the next row (D8 kept).
    """
    f = price_features(spark, sf_dir).na.drop(subset=DROP)
    if test_only:
        f = f.where(F.col("date") >= F.lit(TEST_START).cast("date"))
    return (f.select("market", "date", F.col("price_target").alias("y"),
                     F.explode(_models_array()).alias("_m"))
            .select("market", "date", "_m.model", "y", "_m.y_hat"))


B.register_cte("pred_all", """
  SELECT market, date, 'naive' AS model, price_target AS y, price_lag7 AS y_hat FROM pfeat
  WHERE price_target IS NOT NULL AND price_lag7 IS NOT NULL AND price_ma7 IS NOT NULL
  UNION ALL
  SELECT market, date, 'ma' AS model, price_target AS y, price_ma7 AS y_hat FROM pfeat
  WHERE price_target IS NOT NULL AND price_lag7 IS NOT NULL AND price_ma7 IS NOT NULL""",
               ("pfeat",))
B.register_cte("pred", f"SELECT * FROM pred_all WHERE date >= DATE '{TEST_START}'", ("pred_all",))


def accuracy_sql(src: str, by: str) -> str:
    """DuckDB twin of ``metrics.accuracy`` over relation ``src`` grouped by ``by``."""
    return f"""
  SELECT {by}, count(*) AS n,
    {r('sqrt(avg((y - y_hat) * (y - y_hat)))', 'rmse')},
    {r('avg(abs(y - y_hat))', 'mae')},
    {r('avg(CASE WHEN y <> 0 THEN abs((y - y_hat) / y) END) * 100', 'mape')},
    {r('''CASE WHEN var_pop(y) * count(y) = 0
           THEN CASE WHEN sum((y - y_hat) * (y - y_hat)) = 0 THEN 1.0 ELSE 0.0 END
           ELSE 1 - sum((y - y_hat) * (y - y_hat)) / (var_pop(y) * count(y)) END''', 'r2')},
    {r('avg(CASE WHEN dy IS NOT NULL AND dp IS NOT NULL THEN CAST(dy = dp AS DOUBLE) END) * 100',
       'dir_acc')}
  FROM (SELECT *, sign(y - lag(y) OVER w) AS dy, sign(y_hat - lag(y_hat) OVER w) AS dp
        FROM {src} WINDOW w AS (PARTITION BY {by}, market ORDER BY date)) a
  GROUP BY {by}"""


@query("j7_predictions_long", B.sql_with("pred") + f"""
  SELECT market, date, model, {r('y', 'y')}, {r('y_hat', 'y_hat')} FROM pred""")
def j7_predictions_long(spark, sf_dir):
    return rounded(predictions(spark, sf_dir))


@query("j7_predictions_wide", B.sql_with("pred") + f"""
  SELECT market, date, {r('y', 'y')},
    {r("max(CASE WHEN model = 'ma' THEN y_hat END)", 'ma')},
    {r("max(CASE WHEN model = 'naive' THEN y_hat END)", 'naive')}
  FROM pred GROUP BY market, date, y""")
def j7_predictions_wide(spark, sf_dir):
    wide = (predictions(spark, sf_dir).groupBy("market", "date", "y")
            .pivot("model", ["ma", "naive"]).agg(F.max("y_hat")))
    return rounded(wide)


@query("w15_seasonal_naive", B.sql_with("imputed") + f"""
  SELECT market, date, {r('y_naive', 'y_naive')} FROM (
    SELECT market, date, lag(price_modal, 7) OVER (PARTITION BY market ORDER BY date) AS y_naive
    FROM imputed) WHERE date >= DATE '{TEST_START}'""")
def w15_seasonal_naive(spark, sf_dir):
    from panelmill.plans.common import imputed_spine
    df = W.seasonal_naive(imputed_spine(spark, sf_dir), "price_modal", 7, ("market",))
    return rounded(df.where(F.col("date") >= F.lit(TEST_START).cast("date"))
                   .select("market", "date", "y_naive"))


@query("g5_g8_accuracy", B.sql_with("pred") + accuracy_sql("pred", "model"))
def g5_g8_accuracy(spark, sf_dir):
    return rounded(M.accuracy(predictions(spark, sf_dir), ["model"], ["market"]))


@query("g9_multihorizon", B.sql_with("pred") + """, hz AS (
  SELECT p.*, h.horizon FROM (SELECT *, row_number() OVER (PARTITION BY model, market
                                     ORDER BY date) AS rn FROM pred) p
  JOIN (VALUES """ + ", ".join(f"('{h}', {n})" for h, n in HORIZONS) + """) AS h(horizon, days)
    ON p.rn <= h.days)""" + accuracy_sql("hz", "model, horizon"))
def g9_multihorizon(spark, sf_dir):
    return rounded(M.multihorizon(predictions(spark, sf_dir), HORIZONS, ["model"], ["market"]))


@query("o2_model_rank", B.sql_with("pred") + f"""
  SELECT market, model, {r('mape', 'mape')},
    CAST(row_number() OVER (PARTITION BY market ORDER BY mape ASC NULLS LAST, model) AS INTEGER)
      AS rank
  FROM (SELECT market, model, avg(CASE WHEN y <> 0 THEN abs((y - y_hat) / y) END) * 100 AS mape
        FROM pred GROUP BY market, model)""")
def o2_model_rank(spark, sf_dir):
    from pyspark.sql import Window
    pred = predictions(spark, sf_dir)
    per = pred.groupBy("market", "model").agg(
        (F.avg(F.when(F.col("y") != 0, F.abs((F.col("y") - F.col("y_hat")) / F.col("y"))))
         * 100).alias("mape"))
    w = Window.partitionBy("market").orderBy(F.asc_nulls_last("mape"), "model")
    return rounded(per.withColumn("rank", F.row_number().over(w)))


@query("g10_cv_summary", B.sql_with("pred_all") + f"""
  SELECT model, {r('avg(mape)', 'mape_mean')}, {r('stddev_pop(mape)', 'mape_sd')} FROM (
    SELECT f.fold, p.model,
      avg(CASE WHEN p.y <> 0 THEN abs((p.y - p.y_hat) / p.y) END) * 100 AS mape
    FROM pred_all p JOIN (VALUES """ + ", ".join(
    f"({i}, DATE '{a}', DATE '{b}', DATE '{c}')" for i, a, b, c in FOLDS) + """)
      AS f(fold, train_end, test_start, test_end)
      ON p.date >= f.test_start AND p.date <= f.test_end
    GROUP BY 1, 2) WHERE mape IS NOT NULL GROUP BY model""")
def g10_cv_summary(spark, sf_dir):
    """M8's SQL-expressible part: fold MAPE of the naive models, mean and SD over folds."""
    folds = J.assign_folds(predictions(spark, sf_dir, test_only=False), FOLDS)
    fm = (folds.where(F.col("role") == "test").groupBy("fold", "model")
          .agg((F.avg(F.when(F.col("y") != 0, F.abs((F.col("y") - F.col("y_hat")) / F.col("y"))))
                * 100).alias("mape")))
    return rounded(M.cv_summary(fm, ["model"]))


IMPUTE_COLS = ["price_std30", "temp_anomaly", "rainfall_7d_cum", "max_temp", "humidity"]


@query("g11_mean_impute", B.sql_with("fpanel") + "SELECT commodity, market, date, "
       + ", ".join(r(f"coalesce({c}, (SELECT avg({c}) FROM fpanel WHERE date <= DATE '{TRAIN_END}'))",
                     c) for c in IMPUTE_COLS) + " FROM fpanel")
def g11_mean_impute(spark, sf_dir):
    from panelmill.plans.q_models import panel
    fp = panel(spark, sf_dir)
    means = column_means(fp.where(F.col("date") <= F.lit(TRAIN_END).cast("date")), IMPUTE_COLS)
    return rounded(impute_with_means(fp, means, IMPUTE_COLS)
                   .select("commodity", "market", "date", *IMPUTE_COLS))


def dm_input(spark, sf_dir, loss="squared"):
    from pyspark.sql import Window
    wide = (predictions(spark, sf_dir).groupBy("market", "date", "y")
            .pivot("model", ["ma", "naive"]).agg(F.max("y_hat")))
    w = Window.partitionBy("market").orderBy("date")
    return wide.select("market", F.row_number().over(w).alias("t"),
                       M.loss_differential(F.col("naive"), F.col("ma"), F.col("y"), loss).alias("d"))


def _dm_ctes(name: str, differential: str) -> None:
    """Loss differentials, and the DM statistic per market, as CTEs ``name`` and ``name``_stat."""
    B.register_cte(name, f"""
      SELECT market, row_number() OVER (PARTITION BY market ORDER BY date) AS t, {differential} AS d
      FROM (SELECT market, date, y, max(CASE WHEN model = 'naive' THEN y_hat END) AS yn,
              max(CASE WHEN model = 'ma' THEN y_hat END) AS ym FROM pred GROUP BY 1, 2, 3)""", ("pred",))
    B.register_cte(f"{name}_b", f"""
      SELECT market, count(d) AS T, avg(d) AS d_bar, var_samp(d) AS gamma0,
        CAST(floor(round(power(count(d), 1.0 / 3.0), 9)) AS INTEGER) AS b FROM {name} GROUP BY market""", (name,))
    B.register_cte(f"{name}_stat", f"""
      SELECT market, T, CAST(b AS INTEGER) AS b, d_bar, sqrt(var_d) AS se_d,
        CASE WHEN var_d > 0 THEN d_bar / sqrt(var_d) END AS dm_stat
      FROM (SELECT o.*, (gamma0 + coalesce(gs.gsum, 0.0)) / T AS var_d
            FROM {name}_b o LEFT JOIN (
              SELECT market, sum(2 * (1 - CAST(k AS DOUBLE) / CAST(b + 1 AS DOUBLE)) * gk) AS gsum
              FROM (SELECT x.market, x.k, x.b, covar_samp(c.d, x.d) AS gk
                    FROM (SELECT {name}.market, {name}.t + g.k AS t, g.k, {name}.d, {name}_b.b
                          FROM {name} JOIN {name}_b ON {name}.market = {name}_b.market,
                          LATERAL generate_series(1, {name}_b.b) AS g(k)) x
                    JOIN {name} c ON c.market = x.market AND c.t = x.t GROUP BY 1, 2, 3)
              GROUP BY market) gs ON o.market = gs.market)""", (name, f"{name}_b"))


_dm_ctes("dmd", "(y - yn) * (y - yn) - (y - ym) * (y - ym)")
_dm_ctes("dma", "abs(y - yn) - abs(y - ym)")
_DM_COLS = f"market, T, b, {r('d_bar', 'd_bar')}, {r('se_d', 'se_d')}, {r('dm_stat', 'dm_stat')}"


@query("g12_diebold_mariano", B.sql_with("dmd_stat") + f"SELECT {_DM_COLS} FROM dmd_stat")
def g12_diebold_mariano(spark, sf_dir):
    """Seasonal naive vs moving average, squared loss, per market."""
    return rounded(M.diebold_mariano(dm_input(spark, sf_dir), ["market"]))


@query("g12_dm_absolute", B.sql_with("dma_stat") + f"SELECT {_DM_COLS} FROM dma_stat")
def g12_dm_absolute(spark, sf_dir):
    """The same pair under absolute loss."""
    return rounded(M.diebold_mariano(dm_input(spark, sf_dir, "absolute"), ["market"]))


@query("g12_dm_pvalue", B.sql_with("dmd_stat") + f"""
  SELECT market, {r('dm_stat', 'dm_stat')}, CASE WHEN dm_stat IS NOT NULL THEN {r(two_sided_sql('dm_stat'))} END
    AS p_value FROM dmd_stat""")
def g12_dm_pvalue(spark, sf_dir):
    dm = M.diebold_mariano(dm_input(spark, sf_dir), ["market"])
    return rounded(dm.select("market", "dm_stat", normal_two_sided(F.col("dm_stat")).alias("p_value")))


@query("w19_pad_edge", B.sql_with("spine") + f"""
  SELECT market, date, {r('y_hat', 'y_hat')} FROM (
    SELECT s.market, s.date, last_value(n.y_hat IGNORE NULLS) OVER (
        PARTITION BY s.market ORDER BY s.date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y_hat
    FROM spine s LEFT JOIN (
      SELECT market, date, lag(price_modal, 7) OVER (PARTITION BY market ORDER BY date) AS y_hat
      FROM panel) n ON s.market = n.market AND s.date = n.date)
  WHERE date >= DATE '{TEST_START}'""")
def w19_pad_edge(spark, sf_dir):
    """A forecast defined on the raw rows only, padded with its edge value onto every day."""
    from panelmill.session import materialize
    panel = materialize(B.market_panel(spark, sf_dir))  # feeds the forecast and the spine
    naive = W.seasonal_naive(panel, "price_modal", 7, ("market",), out="y_hat")
    cells = B.spine(spark, sf_dir, panel).select("market", "date")
    df = cells.join(naive.select("market", "date", "y_hat"), ["market", "date"], "left")
    df = W.pad_edge(df, "y_hat", ("market",))
    return rounded(df.where(F.col("date") >= F.lit(TEST_START).cast("date"))
                   .select("market", "date", "y_hat"))


@query("j8_pair_models", B.sql_with("pred") + f"""
  SELECT market, count(*) AS n,
    {r('avg(CASE WHEN abs(y - ym) < abs(y - yn) THEN 1.0 ELSE 0.0 END) * 100', 'ma_better_pct')},
    {r('avg(abs(y - yn) - abs(y - ym))', 'mean_abs_gain')}
  FROM (SELECT market, date, y, max(CASE WHEN model = 'naive' THEN y_hat END) AS yn,
          max(CASE WHEN model = 'ma' THEN y_hat END) AS ym FROM pred GROUP BY 1, 2, 3)
  GROUP BY market""")
def j8_pair_models(spark, sf_dir):
    """Pair two forecasts of the same rows and compare them with conditional aggregates."""
    wide = (predictions(spark, sf_dir).groupBy("market", "date", "y")
            .pivot("model", ["ma", "naive"]).agg(F.max("y_hat")))
    ea, en = F.abs(F.col("y") - F.col("ma")), F.abs(F.col("y") - F.col("naive"))
    return rounded(wide.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(ea < en, 1.0).otherwise(0.0)) * 100).alias("ma_better_pct"),
        F.avg(en - ea).alias("mean_abs_gain")))
