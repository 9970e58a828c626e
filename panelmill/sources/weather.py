"""Weather sources.

S4: API payloads (``properties.parameter`` = variable -> yyyyMMdd -> value)
become rows with two ``explode`` steps and a pivot over the four known
variables (listing the pivot values avoids an extra distinct job). The state
comes from the folder layout (``state=<name>``) through partition discovery,
the analogue of the reference's per-call state literal.

S3: the first source that exists, resolved when the plan is built; or, when
several exist, a per-key priority (``row_number() = 1``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from panelmill.functions.calendar import parse_compact
from panelmill.sources.files import exists

# The weather API's variable names and their canonical names.
VARIABLES = {"T2M_MAX": "max_temp", "T2M_MIN": "min_temp", "PRECTOTCORR": "rainfall_daily",
             "RH2M": "humidity"}

PAYLOAD_SCHEMA = StructType([StructField("properties", StructType([
    StructField("parameter", MapType(StringType(), MapType(StringType(), DoubleType())))]))])


def parse_payloads(docs: DataFrame, state_col: str = "state") -> DataFrame:
    """Rows of JSON documents (already parsed to ``PAYLOAD_SCHEMA``) -> weather table."""
    long = (docs.select(state_col, F.explode("properties.parameter").alias("var", "series"))
            .select(state_col, "var", F.explode("series").alias("day", "value")))
    wide = (long.groupBy(state_col, "day").pivot("var", list(VARIABLES)).agg(F.first("value")))
    return wide.select(F.col(state_col).alias("state"), parse_compact("day").alias("date"),
                       *[F.col(k).alias(v) for k, v in VARIABLES.items()])


def read_weather_json(spark: SparkSession, root: str) -> DataFrame:
    """Folder of JSON payload files partitioned as ``state=<name>``."""
    schema = StructType(PAYLOAD_SCHEMA.fields + [StructField("state", StringType())])
    docs = spark.read.schema(schema).json(root)
    return parse_payloads(docs)


def parse_payload_text(df: DataFrame, text_col: str, state_col: str = "state") -> DataFrame:
    """S4/F7 on a string column holding the JSON text."""
    docs = df.select(state_col, F.from_json(text_col, PAYLOAD_SCHEMA).alias("doc"))
    return parse_payloads(docs.select(state_col, "doc.properties"), state_col)


def write_weather_json(cov: DataFrame, root: str) -> None:
    """Fixture writer: one payload per (state, month) under ``state=<name>`` folders.

    Grouping by month bounds every document to at most 31 days per variable.
    """
    long = cov.select("state", F.date_format("date", "yyyyMM").alias("ym"),
                      F.date_format("date", "yyyyMMdd").alias("day"),
                      F.explode(F.create_map(*[x for k, v in VARIABLES.items()
                                               for x in (F.lit(k), F.col(v).cast("double"))]))
                      .alias("var", "value"))
    per_var = (long.groupBy("state", "ym", "var")
               .agg(F.map_from_entries(F.collect_list(F.struct("day", "value"))).alias("series")))
    docs = (per_var.groupBy("state", "ym")
            .agg(F.map_from_entries(F.collect_list(F.struct("var", "series"))).alias("parameter"))
            .select("state", F.struct(F.col("parameter")).alias("properties")))
    docs.write.mode("overwrite").partitionBy("state").json(root)


def first_existing(spark: SparkSession, sources: Sequence[tuple[str, callable]]) -> DataFrame | None:
    """S3: read the first (path, reader) whose path exists."""
    for path, reader in sources:
        if exists(spark, path):
            return reader(spark, path)
    return None


def prefer_sources(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """S3 (many sources present): keep, per key, the row of the highest-priority source."""
    tagged = [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_prio")
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_prio")


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ("date date, state string, max_temp double, min_temp double, "
              "rainfall_daily double, humidity double")
    return spark.read.option("header", True).schema(schema).csv(path)
