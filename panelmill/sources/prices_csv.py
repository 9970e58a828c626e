"""Heterogeneous market-price CSV files -> typed panel.

Files exported by different sites spell and order their headers
differently. One glob read would apply the first file's header positions
to every file, so a distributed scan takes the first line of every file, files are
grouped by that line, each group is read as all-string CSV in one distributed scan, renamed
to canonical names, and the groups are combined with ``unionByName``. Typing is
permissive: bad dates or prices become NULL and the row is dropped. A row with more
fields than its header is skipped; one with fewer has NULLs at its end.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.calendar import parse_day_first
from panelmill.functions.numeric import nan_to_null
from panelmill.sources.files import list_files

CANONICAL = ["date", "state", "market", "price_modal"]


def canonical_name(header: str) -> str | None:
    """Header canonicalisation (first rule that matches wins; the words are fixed values)."""
    h = header.lower().strip()
    if "date" in h or "arrival" in h:
        return "date"
    if "modal" in h and "price" in h:
        return "price_modal"
    if "market" in h:
        return "market"
    if "state" in h:
        return "state"
    return None


def header_mapping(headers: Sequence[str]) -> dict[str, str]:
    """Raw header -> canonical name, one raw column per canonical name.

    When two headers map to the same name (an arrival date and an arrival
    quantity both -> ``date``), a header containing ``date`` beats one that
    only says ``arrival``; otherwise the first one wins (decision D1).
    """
    chosen: dict[str, str] = {}
    for h in headers:
        c = canonical_name(h)
        if c is None:
            continue
        if c not in chosen:
            chosen[c] = h
        elif c == "date" and "date" in h.lower() and "date" not in chosen[c].lower():
            chosen[c] = h
    return {raw: can for can, raw in chosen.items()}


def first_lines(lines: DataFrame) -> DataFrame:
    """(path, header) from text rows that carry ``path`` and ``block`` (start of the file split)."""
    return (lines.where("block = 0").groupBy("path")
            .agg(F.first("value").alias("header")))


def header_groups(heads: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Files by header fields; the driver holds file names only."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, line in sorted(tuple(r) for r in heads.select("path", "header").collect()):
        header = tuple(next(csv.reader(io.StringIO((line or "").lstrip("\ufeff"))), []))
        groups.setdefault(header, []).append(path)
    return groups


def read_group(spark: SparkSession, header: Sequence[str], paths: list[str]) -> DataFrame:
    """Canonical string columns of files with one header; rows with surplus fields are skipped."""
    names = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{c} string" for c in [*names, "surplus"])
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
           .csv(paths).where("surplus is null"))
    mapping = header_mapping(list(header))
    out = raw.select(*[F.col(names[list(header).index(r)]).alias(c) for r, c in mapping.items()])
    for c in CANONICAL:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*CANONICAL)


def read_groups(spark: SparkSession, groups: dict[tuple[str, ...], list[str]]) -> DataFrame:
    parts = [read_group(spark, header, paths) for header, paths in groups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return type_prices(out)


def text_lines(source) -> DataFrame:
    """Text rows with the file they come from."""
    return source.select("value", F.col("_metadata.file_path").alias("path"),
                         F.col("_metadata.file_block_start").alias("block"))


def read_price_files(spark: SparkSession, pattern: str, commodity: str | None = None
                     ) -> DataFrame | None:
    """S1 + S2: all files matching ``pattern`` (``*_{commodity}*`` when given)."""
    if commodity is not None:
        pattern = pattern.rstrip("/") + f"/*_{commodity}*"
    files = list_files(spark, pattern, ".csv")
    if not files:
        return None
    return read_groups(spark, header_groups(first_lines(text_lines(spark.read.text(files)))))


def type_prices(df: DataFrame) -> DataFrame:
    """Day-first dates, numeric prices, NaN -> NULL, drop rows missing either."""
    price = nan_to_null(F.trim(F.col("price_modal")).try_cast("double"))
    typed = df.select(parse_day_first("date").alias("date"), F.trim("state").alias("state"),
                      F.trim("market").alias("market"), price.alias("price_modal"))
    return typed.na.drop(subset=["date", "price_modal"]).select(*CANONICAL)


# Header spellings used to write test fixtures (three site formats).
VARIANTS = {
    "site1": (["Arrival_Date", "State", "Market", "Modal_Price"], "dd/MM/yyyy"),
    "site2": (["Market Name", "Arrivals (Tonnes)", "State Name", "Price Date",
               "Modal Price (Rs./Quintal)", "Min Price"], "dd-MM-yyyy"),
    "site3": (["date", "state", "market", "modal_price"], "yyyy-MM-dd"),
}


def write_price_files(panel: DataFrame, root: str, commodity: str = "all") -> None:
    """Fixture writer: the panel as CSV in three header spellings, with some bad cells.

    States are spread over the three formats; a hash of (market, date) marks
    1/16 of the rows with an unparseable price and 1/16 with a bad date.
    """
    tag = F.substring(F.md5(F.concat_ws("|", "market", F.col("date").cast("string"))), 1, 1)
    site = F.pmod(F.hash("state"), F.lit(3))
    base = panel.select("state", "market", "date",
                        F.when(tag == "0", F.lit("NA"))
                        .otherwise(F.col("price_modal").cast("string")).alias("price"),
                        (tag == "1").alias("bad_date"), site.alias("site"))
    for i, (name, (headers, fmt)) in enumerate(VARIANTS.items()):
        d = base.where(F.col("site") == i)
        date_txt = F.when(F.col("bad_date"), F.lit("31/02/x")).otherwise(F.date_format("date", fmt))
        values = {"date": date_txt, "state": F.col("state"), "market": F.col("market"),
                  "price_modal": F.col("price")}
        cols = []
        for h in headers:
            c = canonical_name(h)
            if h == "Arrivals (Tonnes)":
                cols.append(F.lit("12.5").alias(h))
            elif h == "Min Price":
                cols.append(F.col("price").alias(h))
            else:
                cols.append(values[c].alias(h))
        (d.select(*cols).write.mode("overwrite").option("header", True)
         .csv(f"{root}/{name}_{commodity}"))
