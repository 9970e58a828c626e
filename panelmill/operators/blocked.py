"""Window features and as-of joins of very long series: blocks of rows.

A window over a series runs in one task, whatever the series' length. Here a series is cut into blocks of ``rows``
consecutive rows, and every block also gets the ``before`` last rows of the block ahead of it and the ``after`` first ones of the next.
Any feature that looks no further than that is the same inside a block, so the usual functions run with (keys, block) as
keys, and the halo rows go. The rows' places in their series come from range partitions (sorted runs of rows, written once) and one
count per (range, series), never from a window over a whole series.

The carry of an interpolation has no bound, so it goes by block summaries: the first and last known value of every block,
carried over the blocks (one row each), then met by the block's rows.

Missing keys make a series of their own. Rows of one series with equal ``order`` stand in any order, as in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import materialize

BLOCK = 1 << 16
HOT = 1 << 20  # rows of a series from which blocks pay

Feature = Callable[[DataFrame, list[str]], DataFrame]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= left[k].eqNullSafe(right[k])
    return out


def numbered(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``df`` with ``_pos``, the row's place (from 0) in its series, as a written table."""
    keys = list(keys)
    spec = [*[F.col(k).asc() for k in keys], F.col(order).asc()]
    placed = materialize(materialize(df).repartitionByRange(*spec).sortWithinPartitions(*spec)
                         .withColumn("_at", F.monotonically_increasing_id())
                         .withColumn("_range", F.shiftright("_at", 33)))
    series = Window.partitionBy(*keys)
    starts = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = materialize(starts.select(*keys, "_range", (F.sum("_n").over(series.orderBy("_range")) - F.col("_n")
                                                         - F.col("_first")).alias("_shift")))
    right = starts.withColumnsRenamed({k: f"_{k}" for k in keys} | {"_range": "__range"})
    on = F.col("_range") == F.col("__range")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(right, on).withColumn("_pos", F.col("_at") + F.col("_shift")).drop(
        "_at", "_range", "__range", "_shift", *[f"_{k}" for k in keys])


def in_blocks(df: DataFrame, keys: Sequence[str], order: str, feature: Feature, before: int, after: int = 0,
              rows: int = BLOCK, placed: bool = False) -> DataFrame:
    """``feature(df, keys)`` computed block by block; it may look at ``before`` rows back and ``after`` rows ahead."""
    if max(before, after) > rows:
        raise ValueError("a halo cannot be longer than a block")
    df = df if placed else numbered(df, keys, order)
    own = F.expr(f"_pos div {rows}")
    at = F.pmod(F.col("_pos"), F.lit(rows))
    every = F.array_compact(F.array(own, F.when(at >= rows - before, own + 1),
                                    F.when((at < after) & (own > 0), own - 1)))
    dealt = df.withColumn("_block", F.explode(every))
    out = feature(dealt, [*keys, "_block"])
    return out.where(F.col("_block") == own).drop("_block", *([] if placed else ["_pos"]))


def interpolate_in_blocks(df: DataFrame, value: str, keys: Sequence[str], order: str, rows: int = BLOCK) -> DataFrame:
    """W5 and W6 over rows with ``_pos``: the same values as ``impute.impute_prices``."""
    keys = list(keys)
    df = df.withColumn("_block", F.expr(f"_pos div {rows}"))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("t"), F.col(value).alias("v")))
    # one row per block: its first and last known value, and what the series' mean needs
    blocks = df.groupBy(*keys, "_block").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    line = Window.partitionBy(*keys).orderBy("_block")
    back = Window.partitionBy(*keys).orderBy(F.col("_block").desc())
    rest = Window.unboundedPreceding
    blocks = blocks.select(*keys, "_block", F.last("last", True).over(line.rowsBetween(rest, -1)).alias("_before"),
                           F.last("first", True).over(back.rowsBetween(rest, -1)).alias("_after"))
    right = blocks.withColumnsRenamed({k: f"_{k}" for k in keys} | {"_block": "__block"})
    on = F.col("_block") == F.col("__block")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = df.join(right, on).drop("__block", *[f"_{k}" for k in keys])
    inside = Window.partitionBy(*keys, "_block").orderBy("_pos")
    turned = Window.partitionBy(*keys, "_block").orderBy(F.col("_pos").desc())
    joined = joined.withColumn("_known", known)
    joined = joined.withColumn("_nx", F.coalesce(F.last("_known", True).over(
        turned.rowsBetween(rest, Window.currentRow)), F.col("_after")))
    joined = joined.withColumn("_pv", F.coalesce(F.last("_known", True).over(
        inside.rowsBetween(rest, Window.currentRow)), F.col("_before")))
    p, n = F.col("_pv"), F.col("_nx")
    share = (F.col("_pos") - p["t"]).cast("double"), (n["t"] - p["t"]).cast("double")
    filled = F.coalesce(F.col(value), F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"])
                        .otherwise(p["v"] + (n["v"] - p["v"]) * share[0] / share[1]))
    # a series without any known value has no mean either, so nothing else is left to fill
    return joined.withColumn(value, filled).drop("_known", "_nx", "_pv", "_before", "_after", "_block")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str],
          rows: int = BLOCK) -> DataFrame:
    """J3 at any grain: every row of ``left`` with ``as_of`` and ``cols`` of the last row of ``right`` at or before its date.

    The rows of both sides are one series by date (of equal dates ``right`` comes first; of equal rows there the greatest
    ``cols`` counts), in which the last known dimension row is carried forward: inside blocks by a running window,
    across blocks by one summary row each. Rows without an earlier dimension row, or with a null key or date, have nulls.
    """
    keys, cols = list(keys), list(cols)
    dim = F.struct(F.col(date).alias("as_of"), *cols)
    fact = left.select(*keys, F.col(date).alias("_date"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    usable = F.col(date).isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    known = right.where(usable).select(*keys, F.col(date).alias("_date"), F.lit(0).alias("_side"), dim.alias("_dim"))
    both = fact.unionByName(known, allowMissingColumns=True)
    both = both.withColumn("_order", F.struct("_date", "_side", "_dim"))
    placed = numbered(both, keys, "_order").withColumn("_block", F.expr(f"_pos div {rows}"))
    last = F.max(F.when(F.col("_side") == 0, F.struct("_pos", "_dim"))).alias("_last")
    line = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (placed.groupBy(*keys, "_block").agg(last)
              .select(*keys, "_block", F.last("_last", True).over(line)["_dim"].alias("_carry")))
    own = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("_seen", F.last("_dim", True).over(own)).where("_side = 1")
    found = found.join(blocks, [*keys, "_block"], "left")  # a null key meets no block, and has no dimension row
    return found.withColumn("_at", F.coalesce("_seen", "_carry")).select("_row.*", "_at.*")


def longest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest series."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def add_features(df: DataFrame, keys: Sequence[str], order: str, feature: Feature, before: int, after: int = 0,
                 hot: int = HOT, rows: int = BLOCK) -> DataFrame:
    """``feature`` by plain windows, one task per series, or in blocks if a series has more than ``hot`` rows."""
    df = materialize(df)
    if longest(df, keys) <= hot:
        return feature(df, list(keys))
    return in_blocks(df, keys, order, feature, before, after, rows)
