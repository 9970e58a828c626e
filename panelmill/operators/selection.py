"""Projections, filters and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

KEY_COLUMNS = ("date", "market", "state", "commodity")
POLICY_COLUMNS = ("msp_current", "price_to_msp_ratio", "msp_change_pct",
                  "msp_current_lag7", "price_to_msp_ratio_lag7", "msp_change_pct_lag7")


def feature_columns(df: DataFrame, policy_neutral: bool = False,
                    target: str = "price_target", value: str = "price_modal") -> list[str]:
    """Numeric columns minus keys, value and target (and policy columns)."""
    exclude = set(KEY_COLUMNS) | {value, target}
    if policy_neutral:
        exclude |= set(POLICY_COLUMNS)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def temporal_split(df: DataFrame, train_end: str, test_start: str | None = None,
                   order: str = "date", out: str = "split") -> DataFrame:
    """Train <= train_end; test >= test_start (or > train_end); between -> val."""
    d = F.col(order).cast("date")
    te = F.lit(train_end).cast("date")
    test = d >= F.lit(test_start).cast("date") if test_start else d > te
    return df.withColumn(out, F.when(d <= te, "train").when(test, "test").otherwise("val"))


# Star thresholds of the reference's coefficient tables:
# "***" p < 0.001, "**" p < 0.01, "*" p < 0.05, else "".
STAR_LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]


def significance_stars(p: Column) -> Column:
    """Stars for a p-value."""
    out = F.when(p < STAR_LEVELS[0][0], STAR_LEVELS[0][1])
    for level, stars in STAR_LEVELS[1:]:
        out = out.when(p < level, stars)
    return out.otherwise("")


def month_dummies(month: Column, first: int = 2, last: int = 12) -> list[Column]:
    """P10: month indicators, January as the dropped base."""
    return [F.when(month == m, 1).otherwise(0).alias(f"month_{m}") for m in range(first, last + 1)]


def dense_codes(df: DataFrame, key: str, out: str = "code") -> DataFrame:
    """0-based code of ``key`` in sorted order.

    The distinct keys are dealt to ranges in one sort-free exchange and written with their range
    number (so it is the same in every later read); a range's start is the running count of the
    ranges before it (a table of one row per range), and keys are numbered within their
    range. No task holds all keys and nothing leaves the executors.
    """
    from panelmill.session import materialize
    keys = df.select(key).distinct().where(F.col(key).isNotNull())
    ranged = materialize(keys.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("_range").agg(F.count("*").alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_range").orderBy(key)
    codes = (ranged.withColumn("_i", F.row_number().over(inside) - 1).join(starts, "_range")
             .select(key, (F.col("_start") + F.col("_i")).cast("long").alias(out)))
    return df.join(codes, key)
