"""Row-based window features over each series.

Everything here is a Catalyst window expression. Features that share the
same partition/order spec are added in ONE ``select`` so Spark plans a single
exchange on the series keys, a single sort and one WindowExec evaluating
every frame. Lags are by row, not by day (the reference's semantics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.numeric import safe_div
from panelmill.params import MOVING_WINDOWS, PRICE_LAGS
from panelmill.session import materialize


def series_window(keys: Sequence[str] = ("market",), order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def trailing(keys: Sequence[str], order: str, rows: int):
    return series_window(keys, order).rowsBetween(-(rows - 1), Window.currentRow)


def guarded(agg: Column, value: str, frame, min_periods: int) -> Column:
    """``agg`` over ``frame`` only when the frame holds ``min_periods`` non-null values."""
    return F.when(F.count(F.col(value)).over(frame) >= min_periods, agg.over(frame))


def lag_cols(value: str, lags: Sequence[int], keys, order, prefix: str | None = None):
    w = series_window(keys, order)
    prefix = prefix or f"{value.replace('_modal', '')}_lag"
    return [F.lag(value, k).over(w).alias(f"{prefix}{k}") for k in lags]


def moving_mean_cols(value: str, windows: Sequence[int], keys, order, prefix="price_ma"):
    """Trailing means with min_periods=1 (the current row is always present)."""
    return [F.avg(value).over(trailing(keys, order, n)).alias(f"{prefix}{n}") for n in windows]


def rolling_sd_cols(value: str, spec: Sequence[tuple[int, int]], keys, order,
                    prefix="price_std"):
    """Sample SD (ddof 1) over trailing rows, NULL until ``min_periods`` values."""
    return [guarded(F.stddev_samp(value), value, trailing(keys, order, n), mp)
            .alias(f"{prefix}{n}") for n, mp in spec]


def return_cols(value: str, periods: Sequence[int], keys, order, prefix="price_ret"):
    w = series_window(keys, order)
    return [(safe_div(F.col(value), F.lag(value, k).over(w)) - 1).alias(f"{prefix}{k}")
            for k in periods]


def add_price_features(df: DataFrame, value: str = "price_modal",
                       keys: Sequence[str] = ("market",), order: str = "date") -> DataFrame:
    """W1-W4 and momentum (P5) in one projection -> one WindowExec."""
    feats = (lag_cols(value, PRICE_LAGS, keys, order, "price_lag")
             + moving_mean_cols(value, MOVING_WINDOWS, keys, order)
             + rolling_sd_cols(value, [(7, 2), (30, 5)], keys, order)
             + return_cols(value, [1, 7], keys, order))
    out = df.select("*", *feats)
    return out.withColumn("price_momentum", F.col(value) - F.col("price_ma30"))


def add_lead_target(df: DataFrame, value: str = "price_modal", horizon: int = 1,
                    keys: Sequence[str] = ("market",), order: str = "date",
                    out: str = "price_target") -> DataFrame:
    """The value ``horizon`` rows ahead."""
    return df.withColumn(out, F.lead(value, horizon).over(series_window(keys, order)))


def add_position(df: DataFrame, keys=("market",), order="date", out="rn",
                 descending: bool = False) -> DataFrame:
    """Row position within a series."""
    o = F.col(order).desc() if descending else F.col(order)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(o)))


def add_rolling_anomaly(df: DataFrame, value: str, keys=("state",), order="date",
                        rows: int = 30, min_periods: int = 7, out: str = "temp_anomaly"):
    """X minus its trailing ``rows``-row mean (NULL below ``min_periods``)."""
    frame = trailing(keys, order, rows)
    return df.withColumn(out, F.col(value) - guarded(F.avg(value), value, frame, min_periods))


def add_rolling_sum(df: DataFrame, value: str, keys=("state",), order="date",
                    rows: int = 7, out: str = "rainfall_7d_cum"):
    """Trailing sum, min_periods=1 (NULL only if every value in the frame is NULL)."""
    frame = trailing(keys, order, rows)
    return df.withColumn(out, guarded(F.sum(value), value, frame, 1))


def seasonal_naive(df: DataFrame, value: str = "price_modal", lag: int = 7,
                   keys=("market",), order="date", out: str = "y_naive") -> DataFrame:
    """The value ``lag`` rows back inside the series (computed on train+test rows,
    so the first test rows reach back into the training tail)."""
    return df.withColumn(out, F.lag(value, lag).over(series_window(keys, order)))


def lookback_sequences(df: DataFrame, value: str, lookback: int = 30, keys=("market",),
                       order="date", out: str = "seq") -> DataFrame:
    """Rows [t-lookback, t-1] as an array; short histories dropped."""
    frame = series_window(keys, order).rowsBetween(-lookback, -1)
    seq = F.collect_list(F.col(value)).over(frame)
    return df.withColumn(out, seq).where(F.size(out) == lookback)


def lookback_windows(df: DataFrame, features: Sequence[str], lookback: int = 30, keys=("market",),
                     order="date", out: str = "window") -> DataFrame:
    """W16 with several features: the ``lookback`` rows before t as a (lookback x features) array.

    One pass over one exchange; each row's features are an array and the frame collects
    those. Rows with a shorter history are dropped.
    """
    frame = series_window(keys, order).rowsBetween(-lookback, -1)
    row = F.array(*[F.col(c).cast("double") for c in features])
    return df.withColumn(out, F.collect_list(row).over(frame)).where(F.size(out) == lookback)


def pad_edge(df: DataFrame, value: str, keys=("market",), order="date", out=None):
    """Carry the last known forecast forward over a step spine (edge padding)."""
    out = out or value
    frame = series_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(frame))


def add_time_trend(df: DataFrame, order: str = "date", out: str = "trend",
                   reuse: bool = True) -> DataFrame:
    """Days since the global first date (a scalar subquery, no global window)."""
    if reuse:
        df = materialize(df)
    return df.withColumn(out, F.datediff(order, df.select(F.min(order)).scalar()))
