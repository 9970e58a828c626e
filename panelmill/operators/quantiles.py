"""Exact quantiles by distributed selection.

``percentile`` keeps a map of all distinct values of a group in one task. Here a quantile is two ranks, and for each
rank of each group an interval of values is narrowed: one pass counts the values of the interval in ``BUCKETS`` buckets of equal width
(a grouped count with partial sums, which keeps the least and largest value of each bucket), the bucket that holds the rank is the next
interval, until it has one distinct value or few rows. Few rows are numbered in order. No task sees a group, and no pass
keeps more than ``BUCKETS`` numbers for a rank.

Nulls do not count; NaN is the largest value (as in an ordering by Spark); a group without values has NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import materialize

BUCKETS = 4096
FEW = 4096


def keyed(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(_g, _x): one struct of the keys, which joins nulls too, and the value."""
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    return df.select(group.alias("_g"), *keys, F.col(value).cast("double").alias("_x"))


def exact_quantiles(df: DataFrame, value: str, keys: Sequence[str], qs: dict[str, float], few: int = FEW,
                    buckets: int = BUCKETS) -> DataFrame:
    """keys and a column per name of ``qs``: linearly interpolated quantiles, equal to ``percentile``."""
    keys = list(keys)
    rows = materialize(keyed(df, value, keys))
    groups = materialize(rows.groupBy("_g", *keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    values = rows.where("_x IS NOT NULL").select("_g", "_x")
    spot = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(spot(q)), F.ceil(spot(q))) for q in qs.values()])))
    open_ = groups.where("_n > 0").select("_g", F.explode(ranks).alias("rank"), "lo", "hi", F.col("_n").alias("_rows"),
                                         F.lit(0).cast("long").alias("below"))
    found = []
    while True:
        open_ = materialize(open_)
        found.append(open_.where("lo <=> hi").select("_g", "rank", F.col("lo").alias("_x")))
        small = open_.where(~F.col("lo").eqNullSafe(F.col("hi")) & (F.col("_rows") <= few))
        line = Window.partitionBy("_g", "rank").orderBy("_x")
        inside = values.join(small, "_g").where(F.col("_x").between(F.col("lo"), F.col("hi")))
        found.append(inside.withColumn("_k", F.col("below") + F.row_number().over(line) - 1)
                     .where("_k = rank").select("_g", "rank", "_x"))
        large = open_.where(~F.col("lo").eqNullSafe(F.col("hi")) & (F.col("_rows") > few))
        if large.isEmpty():
            break
        # halves first: hi - lo may overflow; NaN goes with the largest bucket
        share = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.when(F.isnan("_x") | (F.col("_x") == F.col("hi")), F.lit(buckets)).otherwise(
            F.least(F.floor(F.nanvl(share, F.lit(0.0)) * buckets), F.lit(buckets - 1)))
        counts = (values.join(large, "_g").where(F.col("_x").between(F.col("lo"), F.col("hi")))
                  .groupBy("_g", "rank", "below", bucket.cast("int").alias("bucket"))
                  .agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("_rows")))
        up = Window.partitionBy("_g", "rank").orderBy("bucket")
        counts = counts.withColumn("below", F.col("below") + F.sum("_rows").over(up) - F.col("_rows"))
        open_ = counts.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("_rows"))).select(
            "_g", "rank", "lo", "hi", "_rows", "below")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    at = materialize(every).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_x"))).alias("_at"))
    out = groups.join(at, "_g", "left")
    cols = []
    for name, q in qs.items():
        low, high = F.floor(spot(q)), F.ceil(spot(q))
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        cols.append(F.when(low == high, a).otherwise((high - spot(q)) * a + (spot(q) - low) * b).alias(name))
    return out.select(*keys, *cols)
