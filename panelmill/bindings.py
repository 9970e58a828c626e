"""Bindings of the provided tables to the panel schema (FIXTURES §2).

The test tables carry no price panel, so one of the same shape is derived:

* ``market_panel``  (state, market, date, price_modal): lineitem -> orders ->
  customer -> nation -> region; state = region name, market = nation name,
  date = ship day, price = exact cents / quantity.
* ``spine``         every market x every day of the global range, left joined
  to the panel (missing prices appear here).
* ``commodity_panel`` the same per commodity (part type), each series on all its days.
* ``covariates``    (state, date, max_temp, min_temp, rainfall_daily, humidity)
  from lineitem -> supplier -> nation -> region.
* ``policy``        (year, crop, msp_rs_per_quintal, fci_procurement_mmt).

Plans aggregate on the fact table *before* touching the small dimensions:
lineitem is joined to the order -> customer map (the only shuffle joins),
reduced by a partial aggregate to (nation, day), and only that small
result is joined to nation/region (auto-broadcast by their statistics).
Every SQL twin sits beside its DataFrame version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.numeric import exact_cents
from panelmill.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.col("n_nationkey").alias("nationkey"),
                    F.col("r_name").alias("state"), F.col("n_name").alias("market")))


def _order_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    # customers, parts and orders grow with the facts: sorted, as a broadcast passes through the driver
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").hint("merge")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .select("o_orderkey", F.col("c_nationkey").alias("nationkey")).hint("merge"))


def _price(cents: str = "cents", qty: str = "qty"):
    return (F.col(cents).cast("double") / F.col(qty).cast("double") / 100.0)


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice",
               "l_quantity")
    on = _order_nation(spark, sf_dir)
    daily = (li.join(on, li.l_orderkey == on.o_orderkey)
             .groupBy("nationkey", F.col("l_shipdate").cast("date").alias("date"))
             .agg(F.sum(exact_cents("l_extendedprice")).alias("cents"),
                  F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    return (daily.join(_geo(spark, sf_dir), "nationkey")
            .select("state", "market", "date", _price().alias("price_modal")))


def spine(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Markets x every day of the global range, left joined to the panel.

    The day list is generated per market with ``sequence`` between the global
    first and last day (scalar subqueries), so nothing is collected to the
    driver and no join multiplies data. The aggregated panel (markets x days, small) feeds
    three branches, so it is materialised once instead of rescanning the
    fact table per branch.
    """
    panel = panel if panel is not None else materialize(market_panel(spark, sf_dir))
    d0 = panel.select(F.min("date")).scalar()  # scalar subqueries, merged into one aggregate
    d1 = panel.select(F.max("date")).scalar()
    markets = panel.select("state", "market").distinct()
    cells = markets.select("state", "market", F.explode(F.sequence(d0, d1)).alias("date"),
                           F.lit(None).cast("double").alias("price_modal"))
    # Left join expressed as union + max: ONE exchange, by market, which also
    # satisfies every later per-market window (no join exchanges, no join sorts).
    rows = cells.unionByName(panel.select("state", "market", "date", "price_modal"))
    return (rows.repartition("market").groupBy("state", "market", "date")
            .agg(F.max("price_modal").alias("price_modal")))


def commodity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact (commodity, nation, day) sums of cents and quantity.

    Bounded by types x nations x days whatever the fact-table size; both the
    daily commodity panel and the yearly policy table are re-aggregations of
    it, so a plan needing both scans and joins the fact table once.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_shipdate",
               "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part", "p_partkey", "p_type").hint("merge")
    on = _order_nation(spark, sf_dir)
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(on, li.l_orderkey == on.o_orderkey)
            .groupBy(F.col("p_type").alias("commodity"), "nationkey",
                     F.col("l_shipdate").cast("date").alias("day"))
            .agg(F.sum(exact_cents("l_extendedprice")).alias("cents"),
                 F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))


def commodity_panel(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None
                    ) -> DataFrame:
    """(commodity, state, market, date, price_modal) per day, with gaps.

    Every series has all days from its own first to its own last one; a day without sales has a NULL
    price. Days and prices are one union with a ``max`` under one exchange on the series keys,
    which every later series window reuses.
    """
    cube = cube if cube is not None else materialize(commodity_cube(spark, sf_dir))
    prices = (cube.join(_geo(spark, sf_dir), "nationkey")
              .select("commodity", "state", "market", F.col("day").alias("date"), _price().alias("price_modal")))
    spans = prices.groupBy("commodity", "state", "market").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    cells = spans.select("commodity", "state", "market", F.explode(F.sequence("d0", "d1")).alias("date"),
                         F.lit(None).cast("double").alias("price_modal"))
    return (cells.unionByName(prices).repartition("commodity", "market")
            .groupBy("commodity", "state", "market", "date")
            .agg(F.max("price_modal").alias("price_modal")))


#: The covariates are standardised day means, so their distribution is the same at every table size.
#: Mean and standard deviation of one row: quantities 1..50, discounts 0..10 cents (fixed values of the tables).
QTY_MEAN, QTY_SD, DISC_MEAN, DISC_SD = 25.5, 14.43, 5.0, 3.16


def _z(total, n, mean: float, sd: float):
    return ((total.cast("double") - F.lit(mean) * n.cast("double"))
            / (F.lit(sd) * F.sqrt(n.cast("double"))))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_quantity",
               "l_discount", "l_tax")
    sup = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    daily = (li.join(sup, li.l_suppkey == sup.s_suppkey)
             .groupBy(F.col("s_nationkey").alias("nationkey"),
                      F.col("l_shipdate").cast("date").alias("date"))
             .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
                  F.sum(exact_cents("l_discount")).alias("disc"),
                  F.sum(exact_cents("l_tax")).alias("tax"),
                  F.count(F.lit(1)).alias("n")))
    by_state = (daily.join(_geo(spark, sf_dir), "nationkey")
                .groupBy("state", "date")
                .agg(*[F.sum(c).alias(c) for c in ("qty", "disc", "tax", "n")]))
    by_state = by_state.select("*", _z(F.col("qty"), F.col("n"), QTY_MEAN, QTY_SD).alias("zq"),
                               _z(F.col("disc"), F.col("n"), DISC_MEAN, DISC_SD).alias("zd"))
    return by_state.select(
        "state", "date", (F.lit(35.0) + F.lit(5.0) * F.col("zq")).alias("max_temp"),
        (F.lit(25.0) + F.lit(5.0) * F.col("zq") - F.lit(2.0) * F.abs("zd")).alias("min_temp"),
        F.greatest(F.lit(0.0), F.lit(10.0) + F.lit(10.0) * F.col("zd")).alias("rainfall_daily"),
        (F.col("tax").cast("double") * 10.0 / F.col("n").cast("double")).alias("humidity"))


def policy(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """(year, crop, msp_rs_per_quintal, fci_procurement_mmt) by ship year and part type.

    Without a cube only lineitem -> part is needed (no order/customer join).
    """
    if cube is None:
        li = table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice",
                   "l_quantity")
        part = table(spark, sf_dir, "part", "p_partkey", "p_type")
        yearly = (li.join(part, li.l_partkey == part.p_partkey)
                  .groupBy(F.year("l_shipdate").cast("int").alias("year"),
                           F.col("p_type").alias("crop"))
                  .agg(F.sum(exact_cents("l_extendedprice")).alias("cents"),
                       F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    else:
        yearly = (cube.groupBy(F.year("day").cast("int").alias("year"),
                               F.col("commodity").alias("crop"))
                  .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty")))
    return yearly.select("year", "crop", _price().alias("msp_rs_per_quintal"),
                         (F.col("qty").cast("double") / 1000.0).alias("fci_procurement_mmt"))


# ---------------------------------------------------------------------------
# DuckDB twins, as named CTE bodies.  ``sql_with`` resolves dependencies.
# ---------------------------------------------------------------------------

CENTS = "CAST(round({c} * 100) AS BIGINT)"

SQL_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "geo": ("""SELECT n.n_nationkey AS nationkey, r.r_name AS state, n.n_name AS market
               FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""", ()),
    "order_nation": ("""SELECT o.o_orderkey, c.c_nationkey AS nationkey
               FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""", ()),
    "panel": (f"""SELECT g.state, g.market, d.date,
                 CAST(d.cents AS DOUBLE) / CAST(d.qty AS DOUBLE) / 100.0 AS price_modal
               FROM (SELECT o.nationkey, CAST(l.l_shipdate AS DATE) AS date,
                       sum({CENTS.format(c='l.l_extendedprice')}) AS cents,
                       sum(CAST(l.l_quantity AS BIGINT)) AS qty
                     FROM lineitem l JOIN order_nation o ON l.l_orderkey = o.o_orderkey
                     GROUP BY 1, 2) d
               JOIN geo g ON d.nationkey = g.nationkey""", ("geo", "order_nation")),
    "spine": ("""SELECT m.state, m.market, s.date, p.price_modal
               FROM (SELECT DISTINCT state, market FROM panel) m
               CROSS JOIN (SELECT min(date) AS d0, max(date) AS d1 FROM panel) b
               CROSS JOIN LATERAL (SELECT b.d0 + CAST(i AS INTEGER) AS date
                                   FROM generate_series(0, b.d1 - b.d0) t(i)) s
               LEFT JOIN panel p ON p.state = m.state AND p.market = m.market
                                AND p.date = s.date""", ("panel",)),
    "cdaily": (f"""SELECT d.commodity, g.state, g.market, d.date,
                 CAST(d.cents AS DOUBLE) / CAST(d.qty AS DOUBLE) / 100.0 AS price_modal
               FROM (SELECT p.p_type AS commodity, o.nationkey, CAST(l.l_shipdate AS DATE) AS date,
                       sum({CENTS.format(c='l.l_extendedprice')}) AS cents,
                       sum(CAST(l.l_quantity AS BIGINT)) AS qty
                     FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                     JOIN order_nation o ON l.l_orderkey = o.o_orderkey
                     GROUP BY 1, 2, 3) d
               JOIN geo g ON d.nationkey = g.nationkey""", ("geo", "order_nation")),
    "cpanel": ("""SELECT s.commodity, s.state, s.market, s.date, p.price_modal
               FROM (SELECT b.commodity, b.state, b.market, b.d0 + CAST(i AS INTEGER) AS date
                     FROM (SELECT commodity, state, market, min(date) AS d0, max(date) AS d1
                           FROM cdaily GROUP BY 1, 2, 3) b,
                     LATERAL generate_series(0, b.d1 - b.d0) t(i)) s
               LEFT JOIN cdaily p ON p.commodity = s.commodity AND p.state = s.state
                 AND p.market = s.market AND p.date = s.date""", ("cdaily",)),
    "covariates": (f"""SELECT state, date, 35.0e0 + 5.0e0 * zq AS max_temp,
                 25.0e0 + 5.0e0 * zq - 2.0e0 * abs(zd) AS min_temp,
                 greatest(0.0e0, 10.0e0 + 10.0e0 * zd) AS rainfall_daily,
                 CAST(tax AS DOUBLE) * 10.0 / CAST(n AS DOUBLE) AS humidity
               FROM (SELECT *,
                   (CAST(qty AS DOUBLE) - 25.5e0 * CAST(n AS DOUBLE)) / (14.43e0 * sqrt(CAST(n AS DOUBLE))) AS zq,
                   (CAST(disc AS DOUBLE) - 5.0e0 * CAST(n AS DOUBLE)) / (3.16e0 * sqrt(CAST(n AS DOUBLE))) AS zd
                 FROM (SELECT g.state, CAST(l.l_shipdate AS DATE) AS date,
                         sum(CAST(l.l_quantity AS BIGINT)) AS qty,
                         sum({CENTS.format(c='l.l_discount')}) AS disc,
                         sum({CENTS.format(c='l.l_tax')}) AS tax, count(*) AS n
                       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                       JOIN geo g ON s.s_nationkey = g.nationkey GROUP BY 1, 2))""", ("geo",)),
    "policy": (f"""SELECT CAST(year(l.l_shipdate) AS INTEGER) AS year, p.p_type AS crop,
                 CAST(sum({CENTS.format(c='l.l_extendedprice')}) AS DOUBLE)
                   / CAST(sum(CAST(l.l_quantity AS BIGINT)) AS DOUBLE) / 100.0
                   AS msp_rs_per_quintal,
                 CAST(sum(CAST(l.l_quantity AS BIGINT)) AS DOUBLE) / 1000.0
                   AS fci_procurement_mmt
               FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
               GROUP BY 1, 2""", ()),
}


def register_cte(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    SQL_CTES[name] = (body, deps)


def sql_with(*names: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in SQL_CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_CTES[n][0]})" for n in order) + "\n"
