"""Dimension and panel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY_SCHEMA = ("year int, crop string, msp_rs_per_quintal double, "
                 "fci_procurement_mmt double, source_notes string")


def read_policy_csv(spark: SparkSession, path: str) -> DataFrame:
    """The yearly policy table; notes contain ';' and no quotes, so ',' is the only delimiter."""
    return spark.read.option("header", True).schema(POLICY_SCHEMA).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("commodity",),
                fmt: str = "parquet") -> None:
    """Overwrite a table, partitioned so readers prune by key."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], order: str, buckets: int, path: str | None = None) -> DataFrame:
    """S8 as a table that is shuffled once and for all: bucketed by the series keys, sorted by date inside.

    Windows and joins by ``keys`` read it without an exchange (``path``: files outside the warehouse). One task writes a bucket, so
    it has one file.
    """
    w = (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, *keys).sortBy(*keys, order))
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def read_panel(spark: SparkSession, path: str, commodity: str | None = None) -> DataFrame:
    """The processed panel, pruned to one commodity's partition when given.

    Raises when the table is absent (the reference's error).
    """
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"processed panel not found at {path}") from e
    return df.where(F.col("commodity") == commodity) if commodity is not None else df
