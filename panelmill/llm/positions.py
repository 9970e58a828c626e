"""Places of rows in an order, counted on Spark without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch

WITHIN = 33  # bits that monotonically_increasing_id keeps for a row's place in its partition


def ranked(rows: DataFrame, group: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos`` (from 0) in their group (never null) by ``order``, and the group's size ``n``.

    The rows are range-partitioned and sorted by group and order, and written with a number that ascends in that order;
    counts per (range, group), one row each, give every range its first place. Rows that are equal in ``order`` are
    told apart by a number written before, so a range is never larger for them.
    """
    # written first: Spark samples the rows to find the ranges, and a repeated task must see the same numbers
    rows = scratch.put(rows.withColumn("_row", F.monotonically_increasing_id()))
    keys = [F.col(group).asc(), *order, F.col("_row").asc()]
    number = F.monotonically_increasing_id()
    placed = scratch.put(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
                         .withColumn("_at", number)
                         .withColumn("_range", F.shiftright("_at", WITHIN)))
    ranges = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    starts = scratch.put(ranges.select(
        group, "_range", F.sum("_n").over(whole).alias("n"),
        (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_shift")))
    return (placed.join(starts, [group, "_range"])
            .withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift"))
