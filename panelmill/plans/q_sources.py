"""Queries for sources and sinks (S1-S8). Fixture files are written under the
shared checkpoint folder (``spark.checkpoint.dir``), then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.plans.common import r, rounded
from panelmill.plans.registry import query
from panelmill.session import scratch_path
from panelmill.sources import prices_csv, tables, weather

_BAD = "substr(md5(market || '|' || CAST(date AS VARCHAR)), 1, 1)"


@query("s1_s2_price_files", B.sql_with("panel") + f"""
  SELECT state, market, date, {r('price_modal', 'price_modal')} FROM panel
  WHERE {_BAD} NOT IN ('0', '1')""")
def s1_s2_price_files(spark, sf_dir):
    """Write the panel as CSV in three header spellings with bad cells; read it back."""
    root = scratch_path(spark, "prices")
    prices_csv.write_price_files(B.market_panel(spark, sf_dir), root, "all")
    return rounded(prices_csv.read_price_files(spark, root, "all"))


_COV = ("state, date, " + ", ".join(r(c, c) for c in
                                    ["max_temp", "min_temp", "rainfall_daily", "humidity"]))


@query("s4_weather_json", B.sql_with("covariates") + f"SELECT {_COV} FROM covariates")
def s4_weather_json(spark, sf_dir):
    """Covariates as monthly API payloads per state, parsed back to rows."""
    root = scratch_path(spark, "weather-json")
    weather.write_weather_json(B.covariates(spark, sf_dir), root)
    df = weather.read_weather_json(spark, root)
    return rounded(df.select("state", "date", "max_temp", "min_temp", "rainfall_daily", "humidity"))


@query("s3_source_fallback", B.sql_with("covariates") + f"""SELECT {_COV} FROM (
  SELECT state, date, max_temp + CASE WHEN year(date) <= 1998 THEN 1.5e0 ELSE 0.0e0 END AS max_temp, min_temp,
    rainfall_daily, humidity FROM covariates)""")
def s3_source_fallback(spark, sf_dir):
    """Missing first source is skipped; of two present sources, which differ, the first wins per key."""
    cov = B.covariates(spark, sf_dir)
    jroot, croot = scratch_path(spark, "wx-json"), scratch_path(spark, "wx-csv")
    weather.write_weather_json(cov, jroot)
    cov.where(F.year("date") <= 1998).select(
        "date", "state", (F.col("max_temp") + 1.5).alias("max_temp"), "min_temp", "rainfall_daily", "humidity"
    ).write.mode("overwrite").option("header", True).csv(croot)
    primary = weather.first_existing(spark, [(croot + "-missing", weather.read_weather_csv),
                                             (croot, weather.read_weather_csv)])
    backup = weather.first_existing(spark, [(jroot, weather.read_weather_json)])
    df = weather.prefer_sources([primary, backup], ["state", "date"])
    return rounded(df.select("state", "date", "max_temp", "min_temp", "rainfall_daily", "humidity"))


@query("s6_policy_csv", B.sql_with("policy") + f"""
  SELECT year, crop, {r('msp_rs_per_quintal', 'msp_rs_per_quintal')},
    {r('fci_procurement_mmt', 'fci_procurement_mmt')},
    'mean unit price; ' || crop AS source_notes FROM policy""")
def s6_policy_csv(spark, sf_dir):
    path = scratch_path(spark, "policy-csv")
    pol = B.policy(spark, sf_dir).withColumn(
        "source_notes", F.concat(F.lit("mean unit price; "), F.col("crop")))
    pol.write.mode("overwrite").option("header", True).csv(path)
    return rounded(tables.read_policy_csv(spark, path))


@query("s7_s8_panel_roundtrip", B.sql_with("cpanel") + f"""
  SELECT commodity, state, market, date, {r('price_modal', 'price_modal')} FROM cpanel""")
def s7_s8_panel_roundtrip(spark, sf_dir):
    """Write the panel partitioned by commodity and read the table back.

    ``read_panel(path, commodity)`` prunes to one partition (checked in tests).
    """
    path = scratch_path(spark, "panel")
    tables.write_table(B.commodity_panel(spark, sf_dir), path, ["commodity"])
    df = tables.read_panel(spark, path)
    return rounded(df.select("commodity", "state", "market", "date", "price_modal"))


@query("s7_bucketed_windows", B.sql_with("pfeat") + "SELECT market, date, "
       + ", ".join(r(c, c) for c in ("price_modal", "price_lag7", "price_ma30", "price_std7", "price_target")) + " FROM pfeat")
def s7_bucketed_windows(spark, sf_dir):
    """The imputed spine as a bucketed table; all window features of a series are read from it without an exchange."""
    from uuid import uuid4
    from panelmill.operators import windows as W
    from panelmill.plans.common import imputed_spine
    df = tables.write_bucketed(imputed_spine(spark, sf_dir), f"panel_{uuid4().hex[:8]}", ["market"], "date", 8,
                               scratch_path(spark, "bucketed"))
    df = W.add_lead_target(W.add_price_features(df, keys=["market"]), keys=["market"])
    return rounded(df.select("market", "date", "price_modal", "price_lag7", "price_ma30", "price_std7", "price_target"))


@query("f7_event_props", """
  SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events""")
def f7_event_props(spark, sf_dir):
    ev = B.table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return ev.select("event_id", "event_type",
                     F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("s1_stream_ingest", B.sql_with("panel") + f"""
  SELECT state, market, date, {r('price_modal', 'price_modal')} FROM panel
  WHERE {_BAD} NOT IN ('0', '1')""")
def s1_stream_ingest(spark, sf_dir):
    """The price files ingested incrementally by Structured Streaming, then read as a table."""
    from panelmill.sources.files import glob
    from panelmill.streaming.ingest import ingest_sites
    root = scratch_path(spark, "prices-stream")
    prices_csv.write_price_files(B.market_panel(spark, sf_dir), root, "all")
    table, ckpt = scratch_path(spark, "panel-stream"), scratch_path(spark, "stream-ckpt")
    ingest_sites(spark, glob(spark, f"{root}/*_all"), table, ckpt)
    return rounded(spark.read.parquet(table).select("state", "market", "date", "price_modal"))
