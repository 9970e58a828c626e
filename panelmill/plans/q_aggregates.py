"""Queries for descriptive aggregates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.functions.calendar import days_between, parse_day_first
from panelmill.operators import aggregates as A
from panelmill.operators.windows import series_window
from panelmill.plans.common import r, rounded
from panelmill.plans.features import ALL_FEATURES
import panelmill.plans.q_joins  # noqa: F401
from panelmill.plans.q_joins import feature_panel
from panelmill.plans.registry import query


@query("g2_describe", B.sql_with("panel") + f"""
  SELECT state, count(price_modal) AS n, {r('avg(price_modal)', 'mean')},
    {r('stddev_samp(price_modal)', 'sd')}, {r('min(price_modal)', 'min')},
    {r('max(price_modal)', 'max')},
    {r('CASE WHEN avg(price_modal) = 0 THEN NULL ELSE stddev_samp(price_modal) / avg(price_modal) END * 100', 'cv_pct')}
  FROM panel GROUP BY state""")
def g2_describe(spark, sf_dir):
    return rounded(A.describe(B.market_panel(spark, sf_dir), "price_modal", ["state"]))


@query("g3_missing_rate", B.sql_with("spine") + f"""
  SELECT market, CAST(count_if(price_modal IS NULL) AS BIGINT) AS n_missing, count(*) AS n_rows,
    {r('count_if(price_modal IS NULL) * 100.0 / count(*)', 'missing_pct')}
  FROM spine GROUP BY market""")
def g3_missing_rate(spark, sf_dir):
    return rounded(A.missing_rate(B.spine(spark, sf_dir), "price_modal", ["market"]))


@query("g19_range_profile", B.sql_with("panel") + """
  SELECT market, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
  FROM panel GROUP BY market""")
def g19_range_profile(spark, sf_dir):
    return A.range_profile(B.market_panel(spark, sf_dir), "date", ["market"])


@query("g20_distinct_states", B.sql_with("panel") + "SELECT DISTINCT state FROM panel")
def g20_distinct_states(spark, sf_dir):
    return B.market_panel(spark, sf_dir).select("state").distinct()


_NUM = ["price_modal", *ALL_FEATURES, "price_target"]


@query("p7_daily_agg", B.sql_with("fpanel") + "SELECT commodity, date, "
       + ", ".join(r(f"sum({c}) / count({c})", c) for c in _NUM)
       + " FROM fpanel GROUP BY commodity, date")
def p7_daily_agg(spark, sf_dir):
    """P7 + G1 on the full panel: every numeric column averaged over markets (daily_agg sink)."""
    fp = feature_panel(spark, sf_dir)
    cols = A.numeric_columns(fp, exclude=("commodity", "date"))
    return rounded(A.daily_mean(fp, cols, ["commodity", "date"]))


@query("f3_math", B.sql_with("panel") + f"""
  SELECT market, date, {r('abs(price_modal - 1500)', 'abs_dev')},
    CAST(sign(price_modal - 1500) AS DOUBLE) AS sign_dev, {r('sqrt(price_modal)', 'sqrt_price')},
    CAST(floor(price_modal) AS BIGINT) AS floor_price, {r('pow(price_modal / 1000, 3)', 'cube_k')},
    {r('greatest(price_modal, 1000.0)', 'at_least_1000')},
    {r('least(price_modal, 2000.0)', 'at_most_2000')}
  FROM panel""")
def f3_math(spark, sf_dir):
    p = F.col("price_modal")
    df = B.market_panel(spark, sf_dir)
    return rounded(df.select("market", "date", F.abs(p - 1500).alias("abs_dev"),
                             F.signum(p - 1500).alias("sign_dev"),
                             F.sqrt(p).alias("sqrt_price"),
                             F.floor(p).cast("bigint").alias("floor_price"),
                             F.pow(p / 1000, 3).alias("cube_k"),
                             F.greatest(p, F.lit(1000.0)).alias("at_least_1000"),
                             F.least(p, F.lit(2000.0)).alias("at_most_2000")))


@query("f4_strings", B.sql_with("panel") + """
  SELECT DISTINCT market, lower(market) AS lower_name, trim('  ' || market || ' ') AS trimmed,
    replace(market, '_', ' ') AS spaced, contains(lower(state), 'east') AS eastern,
    CAST(length(market) AS INTEGER) AS name_len,
    array_to_string(list_transform(string_split(lower(replace(state || '_' || market, '_', ' ')), ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') AS title
  FROM panel""")
def f4_strings(spark, sf_dir):
    df = B.market_panel(spark, sf_dir)
    return df.select("market", F.lower("market").alias("lower_name"),
                     F.trim(F.concat(F.lit("  "), F.col("market"), F.lit(" "))).alias("trimmed"),
                     F.replace(F.col("market"), F.lit("_"), F.lit(" ")).alias("spaced"),
                     F.contains(F.lower("state"), F.lit("east")).alias("eastern"),
                     F.length("market").cast("int").alias("name_len"),
                     F.initcap(F.replace(F.concat_ws("_", "state", "market"), F.lit("_"), F.lit(" ")))
                     .alias("title")).distinct()


@query("f5_parse_dates", B.sql_with("panel") + "SELECT market, date, date AS parsed FROM panel")
def f5_parse_dates(spark, sf_dir):
    """Day-first text (nine spellings by row) parsed back to dates."""
    df = B.market_panel(spark, sf_dir)
    spellings = ["dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "d/M/yyyy", "dd-MMM-yyyy", "d MMM yyyy", "dd/MM/yy",
                 "yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy"]
    which = F.pmod(F.dayofyear("date") + F.length("market"), F.lit(len(spellings)))
    txt = F.date_format("date", spellings[0])
    for i, s in enumerate(spellings[1:], 1):
        txt = F.when(which == i, F.date_format("date", s)).otherwise(txt)
    return df.select("market", "date", parse_day_first(txt).alias("parsed"))


@query("f6_day_gaps", B.sql_with("panel") + """
  SELECT market, date, CAST(date - lag(date) OVER (PARTITION BY market ORDER BY date) AS INTEGER)
    AS gap_days FROM panel""")
def f6_day_gaps(spark, sf_dir):
    df = B.market_panel(spark, sf_dir)
    w = series_window(("market",), "date")
    return df.select("market", "date", days_between(F.col("date"), F.lag("date").over(w))
                     .alias("gap_days"))
