"""Calendar and date functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.numeric import col


def calendar_cols(date="date") -> list[Column]:
    """Monday=0 weekday, ISO week; every part as int."""
    d = col(date)
    return [F.weekday(d).cast("int").alias("day_of_week"),
            F.dayofmonth(d).cast("int").alias("day_of_month"),
            F.month(d).cast("int").alias("month"),
            F.quarter(d).cast("int").alias("quarter"),
            F.weekofyear(d).cast("int").alias("week_of_year"),
            F.year(d).cast("int").alias("year")]


def cyclical_month(month="month") -> list[Column]:
    """sin/cos of 2*pi*month/12."""
    m = col(month)
    return [F.sin(F.lit(2 * math.pi) * m / 12).alias("month_sin"),
            F.cos(F.lit(2 * math.pi) * m / 12).alias("month_cos")]


def add_temporal_features(df: DataFrame, date: str = "date") -> DataFrame:
    df = df.select("*", *calendar_cols(date))
    return df.select("*", *cyclical_month("month"))


CALENDAR_SQL = """CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week,
  CAST(day({d}) AS INTEGER) AS day_of_month, CAST(month({d}) AS INTEGER) AS month,
  CAST(quarter({d}) AS INTEGER) AS quarter, CAST(week({d}) AS INTEGER) AS week_of_year,
  CAST(year({d}) AS INTEGER) AS year"""

CYCLICAL_SQL = """sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos"""


MONTH_NAMES = "janfebmaraprmayjunjulaugsepoctnovdec"
_SEP = r"[/.\- ,]+"


def parse_day_first(c) -> Column:
    """day-first text -> date; unparseable -> NULL (never raises under ANSI).

    Day and month of one or two digits or a month name, in any order that is unambiguous
    (day-month-year, month name-day-year, year-month-day), any of ``/ . - ,`` or blanks between them, years of
    four or two digits (00-68 are 20xx), and an optional time of day that is ignored.
    """
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"[T ]+\d{1,2}:\d{2}.*$", "")
    numeric = rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}})$"
    iso = rf"^(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})$"
    named = rf"^(\d{{1,2}}){_SEP}([A-Za-z]{{3,9}}){_SEP}(\d{{4}}|\d{{2}})$"
    named_first = rf"^([A-Za-z]{{3,9}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}})$"

    def group(pattern, i):
        return F.regexp_extract(text, pattern, i)

    def year(y):
        short = F.when(y.try_cast("int") <= 68, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
        return F.when(F.length(y) == 2, short).otherwise(y)

    def month(m):
        at = F.position(F.lower(F.substring(m, 1, 3)), F.lit(MONTH_NAMES))
        return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int").cast("string"))

    def date(y, m, d):
        return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d")).cast("date")

    return (F.when(text.rlike(numeric), date(year(group(numeric, 3)), group(numeric, 2), group(numeric, 1)))
            .when(text.rlike(iso), date(group(iso, 1), group(iso, 2), group(iso, 3)))
            .when(text.rlike(named) & month(group(named, 2)).isNotNull(),
                  date(year(group(named, 3)), month(group(named, 2)), group(named, 1)))
            .when(text.rlike(named_first) & month(group(named_first, 1)).isNotNull(),
                  date(year(group(named_first, 3)), month(group(named_first, 1)), group(named_first, 2))))


def parse_compact(c) -> Column:
    """``yyyyMMdd`` text -> date."""
    return F.try_to_timestamp(col(c).cast("string"), F.lit("yyyyMMdd")).cast("date")


def days_between(end, start) -> Column:
    """F6."""
    return F.datediff(col(end), col(start))
