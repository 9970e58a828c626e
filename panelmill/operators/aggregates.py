"""Grouped aggregates.

All are ``groupBy(...).agg(...)`` so Spark runs a map-side partial
aggregate before the shuffle; a hot key is pre-combined on every mapper and
never collected whole into one task. Exact quantiles use ``percentile``
(linear interpolation, like numpy/pandas); ``percentile_approx`` is not equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelmill.functions.numeric import safe_div
from panelmill.operators.quantiles import exact_quantiles
from panelmill.session import materialize


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns of the schema, minus ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def daily_mean(df: DataFrame, cols: Sequence[str] | None = None,
               keys: Sequence[str] = ("date",)) -> DataFrame:
    """G1: mean over markets of every numeric column, per date (and commodity)."""
    cols = cols or numeric_columns(df, exclude=keys)
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def describe(df: DataFrame, value: str = "price_modal", keys: Sequence[str] = ()) -> DataFrame:
    """N, mean, sd (ddof 1), CV %, min, max."""
    return (df.groupBy(*keys)
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                 F.stddev_samp(value).alias("sd"), F.min(value).alias("min"),
                 F.max(value).alias("max"))
            .withColumn("cv_pct", safe_div(F.col("sd"), F.col("mean")) * 100))


def missing_rate(df: DataFrame, value: str = "price_modal",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Missing count and rate (%)."""
    return (df.groupBy(*keys)
            .agg(F.count_if(F.col(value).isNull()).alias("n_missing"),
                 F.count(F.lit(1)).alias("n_rows"))
            .withColumn("missing_pct", F.col("n_missing") * 100.0 / F.col("n_rows")))


def group_quantile(df: DataFrame, value: str, keys: Sequence[str], q: float,
                   out: str, method: str = "map") -> DataFrame:
    """Exact linear-interpolated quantile per group.

    ``map`` keeps a value -> count map per group in one task: for groups bounded by the calendar, such as the days of a
    month. ``select`` is exact for groups of any size (``quantiles.exact_quantiles``).
    """
    if method == "select":
        return exact_quantiles(df, value, keys, {out: q})
    return df.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), q).alias(out))


def quantile_summary(df: DataFrame, value: str, keys: Sequence[str], method: str = "map") -> DataFrame:
    """Median, p5, p95, CI width and population SD of draws; ``method`` as in ``group_quantile``."""
    wanted = {"ci_lower": 0.05, "median_msp": 0.5, "ci_upper": 0.95}
    if method == "select":
        df = materialize(df)
        sd = df.groupBy(*keys).agg(F.stddev_pop(value).alias("sd"))
        found = exact_quantiles(df, value, keys, wanted).join(sd, list(keys))
    else:
        x = F.percentile(F.col(value).cast("double"), F.array(*map(F.lit, wanted.values())))
        found = (df.groupBy(*keys).agg(x.alias("_q"), F.stddev_pop(value).alias("sd"))
                 .select(*keys, *[F.col("_q")[i].alias(c) for i, c in enumerate(wanted)], "sd"))
    return found.select(*keys, "median_msp", "ci_lower", "ci_upper",
                        (F.col("ci_upper") - F.col("ci_lower")).alias("ci_width"), "sd")


def density_histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int = 40
                      ) -> DataFrame:
    """Equal-width density histogram on each group's own range.

    Bounds come from a grouped min/max joined back on the keys; bin counts
    are a grouped count; empty bins are filled from a generated bin list.
    """
    df = materialize(df)  # read by the bounds and by the bin counts
    bounds = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                   F.count(value).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = (df.join(bounds, list(keys))
              .withColumn("bin", F.least(
                  F.when(F.col("hi") > F.col("lo"),
                         F.floor((F.col(value) - F.col("lo")) / width).cast("int") + 1)
                  .otherwise(F.lit(1)), F.lit(bins)))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt")))
    grid = bounds.select(*keys, "lo", "hi", "n", F.explode(F.sequence(F.lit(1), F.lit(bins)))
                         .alias("bin"))
    return (grid.join(binned, [*keys, "bin"], "left")
            .select(*keys, "bin",
                    (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * width).alias("bin_hi"),
                    F.coalesce("cnt", F.lit(0)).cast("bigint").alias("count"),
                    safe_div(F.coalesce("cnt", F.lit(0)).cast("double"),
                             F.col("n") * width).alias("density")))


def range_profile(df: DataFrame, order: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Rows and date range."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.min(order).alias("first_date"),
                                 F.max(order).alias("last_date"))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G11 (fit part): one-row mean of every column."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def impute_with_means(df: DataFrame, means: DataFrame, cols: Sequence[str]) -> DataFrame:  # noqa: E501
    """G11 (apply part): coalesce each column with its fitted mean.

    Each mean is a scalar subquery of the one-row ``means`` (Spark merges them
    into one aggregate), so no join is planned.
    """
    return df.select(*[F.coalesce(F.col(c), means.select(c).scalar()).alias(c) if c in cols
                       else F.col(c) for c in df.columns])
