"""Gap filling inside each series.

Interpolation is by *row position*, not by day, like the reference: a series
with rows t = 1..n and values x_t gets, for a missing x_t, the straight line
between the nearest known neighbours; a leading gap takes the first known
value and a trailing gap the last one.

The next known value is read through a date-*descending* running frame
instead of an ``unboundedFollowing`` frame, which Spark evaluates in
quadratic time. That pass runs first and carries each row's position from
the end, so the ascending pass (previous value, interpolation) leaves the
series sorted by date for every later feature window: one exchange on the
series keys and two sorts in all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate_linear(df: DataFrame, value: str = "price_modal",
                       keys: Sequence[str] = ("market",), order: str = "date",
                       out: str | None = None) -> DataFrame:
    out = out or value
    x = F.col(value)
    # Pass 1, date-descending: next known value and its position counted from the end.
    back_w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    back = back_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = df.withColumn("_r", F.row_number().over(back_w))
    known_r = F.when(x.isNotNull(), F.col("_r"))
    staged = (staged.withColumn("_nv", F.last(x, ignorenulls=True).over(back))
              .withColumn("_nr", F.last(known_r, ignorenulls=True).over(back)))
    # Pass 2, date-ascending (the order every later feature window reuses).
    w = Window.partitionBy(*keys).orderBy(order)
    fwd = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = staged.withColumn("_t", F.row_number().over(w))
    known_t = F.when(x.isNotNull(), F.col("_t"))
    staged = (staged.withColumn("_pv", F.last(x, ignorenulls=True).over(fwd))
              .withColumn("_pt", F.last(known_t, ignorenulls=True).over(fwd))
              .withColumn("_nt", F.col("_t") + F.col("_r") - F.col("_nr")))
    pv, nv = F.col("_pv"), F.col("_nv")
    dt = (F.col("_t") - F.col("_pt")).cast("double")
    dn = (F.col("_nt") - F.col("_pt")).cast("double")
    filled = F.coalesce(
        x,
        F.when(F.col("_pt").isNull(), nv)
         .when(F.col("_nt").isNull(), pv)
         .otherwise(pv + (nv - pv) * dt / dn))
    return staged.withColumn(out, filled).drop("_t", "_r", "_pv", "_pt", "_nv", "_nr", "_nt")


def fill_series_mean(df: DataFrame, value: str = "price_modal",
                     keys: Sequence[str] = ("market",), out: str | None = None) -> DataFrame:
    """Remaining gaps (only all-missing series reach here) take the series mean."""
    out = out or value
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.coalesce(F.col(value), F.avg(value).over(w)))


def impute_prices(df: DataFrame, value: str = "price_modal",
                  keys: Sequence[str] = ("market",), order: str = "date") -> DataFrame:
    return fill_series_mean(interpolate_linear(df, value, keys, order), value, keys)


def interpolate_sql(src: str, value: str = "price_modal", keys: str = "market",
                    order: str = "date", cols: str = "*") -> str:
    """DuckDB twin of ``impute_prices`` over relation ``src``."""
    return f"""
      SELECT * EXCLUDE (_t, _pv, _pt, _nv, _nt, filled, {value}),
        coalesce(filled, avg(filled) OVER (PARTITION BY {keys})) AS {value}
      FROM (
        SELECT *, coalesce({value},
            CASE WHEN _pt IS NULL THEN _nv WHEN _nt IS NULL THEN _pv
                 ELSE _pv + (_nv - _pv) * CAST(_t - _pt AS DOUBLE) / CAST(_nt - _pt AS DOUBLE)
            END) AS filled
        FROM (
          SELECT *,
            last_value({value} IGNORE NULLS) OVER wf AS _pv,
            last_value(CASE WHEN {value} IS NOT NULL THEN _t END IGNORE NULLS) OVER wf AS _pt,
            last_value({value} IGNORE NULLS) OVER wb AS _nv,
            last_value(CASE WHEN {value} IS NOT NULL THEN _t END IGNORE NULLS) OVER wb AS _nt
          FROM (SELECT {cols}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _t
                FROM {src}) s0
          WINDOW wf AS (PARTITION BY {keys} ORDER BY {order}
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 wb AS (PARTITION BY {keys} ORDER BY {order} DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ) s1
      ) s2"""
