"""Numeric column helpers (F3) shared by operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_cents(c) -> Column:
    """Money as integer cents, so sums are exact and order-independent."""
    return F.round(col(c) * 100).cast("bigint")


def r4(c) -> Column:
    """Half-up rounding to 4 decimals, bit-identical with its SQL twin ``r4_sql``.

    Magnitudes of 1e11 and more already carry no 4th decimal; they pass
    unchanged (and the 64-bit floor cannot overflow).

    Exact decimal ties (common: prices are cents / quantity) would otherwise
    fall on either side of the boundary depending on the last bit of a sum,
    which differs between engines; a nudge far above summation error
    (1e-6 + |x| 1e-8 units of the 4th decimal) sends every tie up in both.
    """
    c = col(c)
    scaled = ((c * 1e4 + 0.5) + 1e-6) + F.abs(c) * 1e-8
    return F.when(F.abs(c) < 1e11, F.floor(scaled).cast("double") / 1e4).otherwise(c)


def r4_sql(expr: str) -> str:
    x = f"({expr})"
    return (f"(CASE WHEN abs({x}) < 1e11 THEN floor((({x} * 1e4 + 0.5) + 1e-6) + abs({x}) * 1e-8)"
            f" / 1e4 ELSE {x} END)")


def safe_div(a, b) -> Column:
    """x / 0 -> NULL (the reference yields inf; ANSI Spark would raise)."""
    return F.try_divide(col(a), col(b))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 where a missing comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")
