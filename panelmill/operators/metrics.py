"""Forecast accuracy (G5-G10, G12) over a long prediction table.

Predictions are long: one row per (series keys, date, model) with ``y`` and
``y_hat``. Every metric is a grouped aggregate, so millions of series and
models run as one partial-aggregated job. Direction accuracy and the
Diebold-Mariano lags are computed inside each series (decision D10).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import materialize


def _err(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


def accuracy(pred: DataFrame, by: Sequence[str] = ("model",), series: Sequence[str] = ("market",),
             order: str = "date", y: str = "y", p: str = "y_hat") -> DataFrame:
    """Rmse, mae, mape (%), r2 = 1 - SSE/SST, dir_acc (%).

    The lag for direction is taken inside each (by, series) run; the first
    row of a series has no direction and is excluded. SST is n * var_pop(y)
    (a stable one-pass moment), so the table is read once, not joined to its
    own means.
    """
    w = Window.partitionBy(*by, *series).orderBy(order)
    dy = F.signum(F.col(y) - F.lag(y).over(w))
    dp = F.signum(F.col(p) - F.lag(p).over(w))
    staged = pred.select(*by, y, p, F.when(dy.isNotNull() & dp.isNotNull(),
                                            (dy == dp).cast("double")).alias("_hit"))
    e = _err(y, p)
    agg = (staged.groupBy(*by)
           .agg(F.count(F.lit(1)).alias("n"),
                F.sqrt(F.avg(e * e)).alias("rmse"),
                F.avg(F.abs(e)).alias("mae"),
                (F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * 100).alias("mape"),
                F.sum(e * e).alias("_sse"),
                (F.var_pop(y) * F.count(y)).alias("_sst"),
                (F.avg("_hit") * 100).alias("dir_acc")))
    r2 = (F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("_sse") / F.col("_sst")))
    return agg.withColumn("r2", r2).drop("_sse", "_sst")


def first_n_rows(pred: DataFrame, horizons: Sequence[tuple[str, int]], by=("model",),
                 series=("market",), order: str = "date") -> DataFrame:
    """The first ``n`` rows of every series, once per horizon (literal array)."""
    w = Window.partitionBy(*by, *series).orderBy(order)
    arr = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("days"))
                    for h, n in horizons])
    return (pred.withColumn("_rn", F.row_number().over(w))
            .select("*", F.explode(F.filter(arr, lambda h: h["days"] >= F.col("_rn"))).alias("_h"))
            .select("*", "_h.*").drop("_h", "_rn", "days"))


def multihorizon(pred: DataFrame, horizons, by=("model",), series=("market",),
                 order="date") -> DataFrame:
    rows = first_n_rows(pred, horizons, by, series, order)
    return accuracy(rows, [*by, "horizon"], series, order)


def cv_summary(fold_metrics: DataFrame, by=("model",), value="mape") -> DataFrame:
    """Mean and population SD of the fold metric over non-null folds."""
    return fold_metrics.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_sd"))


def bandwidth(t: Column) -> Column:
    """Largest integer b with b^3 <= T (exact at perfect cubes)."""
    b = F.floor(F.pow(t.cast("double"), 1.0 / 3.0)).cast("int")
    b = F.when((b + 1) * (b + 1) * (b + 1) <= t, b + 1).otherwise(b)
    return F.when(b * b * b > t, b - 1).otherwise(b)


def diebold_mariano(d: DataFrame, keys: Sequence[str], t: str = "t", value: str = "d",
                    reuse: bool = True) -> DataFrame:
    """DM statistic with a Bartlett/Newey-West variance per series.

    ``d`` holds one row per (keys, t) with the loss differential. Lag-k
    autocovariances come from a self-join of each row with the row k steps
    earlier, k = 1..b(T): T*b rows per series, distributed by the keys.
    Variance <= 0 gives NULL. ``d`` feeds three branches and is materialised
    once (``reuse``).
    """
    if reuse:
        d = materialize(d)
    base = d.groupBy(*keys).agg(F.count(value).alias("T"), F.avg(value).alias("d_bar"),
                                F.var_samp(value).alias("gamma0"))
    base = base.withColumn("b", bandwidth(F.col("T")))
    shifted = (d.join(base.select(*keys, "b"), list(keys))
               .select(*keys, F.explode(F.sequence(F.lit(1), F.greatest("b", F.lit(1))))
                       .alias("k"), (F.col(t)).alias("_t0"), F.col(value).alias("_dlag"), "b")
               .where(F.col("k") <= F.col("b"))
               .withColumn(t, F.col("_t0") + F.col("k")))
    pairs = shifted.join(d, [*keys, t])
    gam = (pairs.groupBy(*keys, "k", "b")
           .agg(F.covar_samp(value, "_dlag").alias("gk"))
           .groupBy(*keys)
           .agg(F.sum(2 * (1 - F.col("k") / (F.col("b") + 1)) * F.col("gk")).alias("gsum")))
    out = base.join(gam, list(keys), "left")
    var = (F.col("gamma0") + F.coalesce(F.col("gsum"), F.lit(0.0))) / F.col("T")
    return (out.withColumn("var_d", var)
            .withColumn("dm_stat", F.when(F.col("var_d") > 0, F.col("d_bar") / F.sqrt("var_d")))
            .withColumn("se_d", F.sqrt("var_d"))
            .select(*keys, "T", "b", "d_bar", "se_d", "dm_stat"))


def loss_differential(a: Column, b: Column, y: Column, loss: str = "squared") -> Column:
    """Loss of forecast ``a`` less loss of forecast ``b``; ``loss`` is squared or absolute."""
    if loss == "squared":
        return (y - a) * (y - a) - (y - b) * (y - b)
    if loss == "absolute":
        return F.abs(y - a) - F.abs(y - b)
    raise ValueError(f"unknown loss {loss}")
