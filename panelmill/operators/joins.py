"""Joins (J1-J10).

No join here relies on a hint: Spark's statistics (and AQE at run time)
choose a broadcast only when a side is measured below
``spark.sql.autoBroadcastJoinThreshold``; otherwise the join is a shuffle
sort-merge join with AQE skew splitting. Parameter tables of fixed, known
size are not joined at all: they are literal arrays exploded in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.numeric import flag, safe_div
from panelmill.operators.aggregates import group_quantile
from panelmill.operators.blocked import in_blocks
from panelmill.operators.windows import add_rolling_anomaly, add_rolling_sum
from panelmill.session import materialize


def weather_features(cov: DataFrame, keys=("state",), order="date",
                     fit_until: str | None = None, reuse: bool = True,
                     block_rows: int | None = None) -> DataFrame:
    """W10, W11, G4 on the covariate table, per state by date (decisions D3/D4).

    Adds ``temp_range``, ``temp_anomaly``, ``rainfall_7d_cum`` and the
    (state, month) 25 % rain quantile ``rain_p25`` (J10: group statistic
    joined back). ``fit_until`` restricts the quantile sample to avoid the
    reference's look-ahead. The covariate table feeds both the rows and the
    quantile, so with ``reuse`` it is materialised once (it is small:
    states x days).
    """
    if reuse:
        cov = materialize(cov)
    cov = cov.withColumn("temp_range", F.col("max_temp") - F.col("min_temp"))

    def rolling(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        df = add_rolling_anomaly(df, "max_temp", keys, order, 30, 7, "temp_anomaly")
        return add_rolling_sum(df, "rainfall_daily", keys, order, 7, "rainfall_7d_cum")

    cov = in_blocks(cov, keys, order, rolling, 30, 0, block_rows) if block_rows else rolling(cov, keys)
    cov = cov.withColumn("_month", F.month(order))
    sample = cov if fit_until is None else cov.where(F.col(order) <= F.lit(fit_until))
    p25 = group_quantile(sample, "rainfall_daily", [*keys, "_month"], 0.25, "rain_p25")
    return cov.join(p25, [*keys, "_month"], "left").drop("_month")


def join_weather(panel: DataFrame, wfeat: DataFrame, on=("state", "date")) -> DataFrame:
    """J1 + P6: left join on (state, date); indicators are 0 when unmatched."""
    cols = ["max_temp", "min_temp", "rainfall_daily", "humidity", "temp_range",
            "temp_anomaly", "rainfall_7d_cum", "rain_p25"]
    w = wfeat.select(*on, *[c for c in cols if c in wfeat.columns])
    out = panel.join(w, list(on), "left")
    out = out.withColumn("extreme_heat_days", flag(F.col("max_temp") > 40))
    out = out.withColumn("drought_indicator", flag(F.col("rainfall_daily") < F.col("rain_p25")))
    return out.drop("rain_p25")


def as_of_years(dim: DataFrame, key: str, year: str = "year") -> DataFrame:
    """A yearly dimension as one row per key and year of the table's whole range.

    A year without a row takes the last one before it; years before a key's first row take that
    first row (the reference's back-fill). The result is keys x years, whatever the data's size.
    """
    dim = dim.withColumn("_dim_year", F.col(year).cast("int"))
    first, last = dim.select(F.min("_dim_year")).scalar(), dim.select(F.max("_dim_year")).scalar()
    w = Window.partitionBy(key).orderBy("_dim_year")
    spans = (dim.withColumn("_from", F.when(F.row_number().over(w) == 1, first).otherwise(F.col("_dim_year")))
             .withColumn("_to", F.coalesce(F.lead("_dim_year").over(w) - 1, last)))
    return (spans.where("_from <= _to")
            .withColumn("_dim_year", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to"))


def as_of_join(df: DataFrame, dim: DataFrame, df_key: str, dim_key: str,
               df_year: str = "year", dim_year: str = "year",
               cols: Sequence[str] = ()) -> DataFrame:
    """Per-key lookup of the last dimension row with year <= the row's year.

    The dimension has one row per (key, year), and a row's year is clamped to the dimension's
    range, so it is an equi-join on both and a hot key is spread over its years.
    """
    years = as_of_years(dim, dim_key, dim_year).select(F.col(dim_key).alias("_k"), "_dim_year", *cols)
    y = F.col(dim_year).cast("int")
    clamped = F.greatest(F.least(F.col(df_year).cast("int"), dim.select(F.max(y)).scalar()),
                         dim.select(F.min(y)).scalar())
    left = df.withColumn("_clamped", clamped)
    return (left.join(years, (F.col(df_key) == F.col("_k")) & (F.col("_clamped") == F.col("_dim_year")), "left")
            .drop("_k", "_dim_year", "_clamped"))


def add_policy_features(df: DataFrame, policy: DataFrame, keys=("commodity", "market"),
                        order: str = "date", crop_col: str = "commodity") -> DataFrame:
    """J2/J3 + P5 + W8/W9: floor price by year, ratio, change, and their lag 7."""
    pol = policy.select(F.col("crop"), F.col("year").alias("_pyear"),
                        F.col("msp_rs_per_quintal").alias("msp_current"))
    df = df.withColumn("_year", F.year(order))
    df = as_of_join(df, pol, crop_col, "crop", "_year", "_pyear", ["msp_current"]).drop("_year")
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.select("*", safe_div(F.col("price_modal"), F.col("msp_current"))
                   .alias("price_to_msp_ratio"),
                   F.coalesce(safe_div(F.col("msp_current"), F.lag("msp_current").over(w)) - 1,
                              F.lit(0.0)).alias("msp_change_pct"))
    return df.select("*", *[F.lag(c, 7).over(w).alias(f"{c}_lag7")
                            for c in ("msp_current", "price_to_msp_ratio", "msp_change_pct")])


def add_cross_features(df: DataFrame, value: str = "price_modal",
                       by: Sequence[str] = ("commodity", "date"), reuse: bool = True
                       ) -> DataFrame:
    """Spread from and ratio to the same-day cross-market mean.

    Partial aggregate on (commodity, date) joined back: a window partitioned
    by date would put every market of a day in one task. The input feeds both
    sides of the join, so with ``reuse`` it is materialised once.
    """
    if reuse:
        df = materialize(df)
    m = df.groupBy(*by).agg(F.avg(value).alias("_day_mean"))
    return (df.join(m, list(by))
            .withColumn("price_spread_from_mean", F.col(value) - F.col("_day_mean"))
            .withColumn("price_relative", safe_div(F.col(value), F.col("_day_mean")))
            .drop("_day_mean"))


def explode_params(df: DataFrame, params: Column, alias: str = "p") -> DataFrame:
    """Attach a literal parameter table to every row without a join."""
    return df.select("*", F.explode(params).alias(alias)).select("*", f"{alias}.*").drop(alias)


def assign_folds(df: DataFrame, folds: Sequence[tuple], order: str = "date") -> DataFrame:
    """Expanding-window fold membership; a row may belong to several folds.

    Each fold (id, train_end, test_start, test_end) is a literal struct; the
    fold array is filtered to a row's own folds before it is exploded, so no row is
    multiplied in vain and no range join or broadcast is planned.
    """
    d = F.col(order)
    arr = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(te).cast("date").alias("train_end"),
                             F.lit(ts).cast("date").alias("test_start"),
                             F.lit(tz).cast("date").alias("test_end"))
                    for i, te, ts, tz in folds])
    own = F.filter(arr, lambda f: (d <= f["train_end"]) | ((d >= f["test_start"]) & (d <= f["test_end"])))
    out = explode_params(df, own, "_fold")
    role = F.when(d <= F.col("train_end"), F.lit("train")).otherwise(F.lit("test"))
    return out.withColumn("role", role).drop("train_end", "test_start", "test_end")


def dense_grid(values: DataFrame, keys: DataFrame, a: str, b: str, lo: str, hi: str,
               value: str) -> DataFrame:
    """Every ``a`` x every integer ``b`` in [lo, hi], ``value`` 0 where absent.

    ``keys`` holds the distinct ``a`` values with their (lo, hi) bounds; the
    ``b`` axis is generated by ``sequence`` per key, so nothing is cross-joined.
    """
    grid = keys.select(a, F.explode(F.sequence(lo, hi)).alias(b))
    dtype = values.schema[value].dataType
    return (grid.join(values, [a, b], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0).cast(dtype))))


def with_series_stat(df: DataFrame, keys: Sequence[str], stat: Column, out: str) -> DataFrame:
    """J10 on series keys: a window over rows that the series windows deal by the same keys anyway."""
    return df.withColumn(out, stat.over(Window.partitionBy(*keys)))
