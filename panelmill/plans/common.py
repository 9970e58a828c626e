"""Shared building blocks for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelmill import bindings as B
from panelmill.functions.numeric import r4, r4_sql
from panelmill.operators.impute import impute_prices, interpolate_sql


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column half-up to 4 decimals (the comparison rule)."""
    return df.select(*[r4(f.name).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def imputed_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_prices(B.spine(spark, sf_dir))


B.register_cte("imputed", interpolate_sql("spine"), ("spine",))


def r(expr: str, alias: str | None = None) -> str:
    """SQL half-up rounding to 4 decimals (twin of ``rounded``)."""
    s = r4_sql(expr)
    return f"{s} AS {alias}" if alias else s
