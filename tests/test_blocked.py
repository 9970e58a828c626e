"""Blocked windows against plain ones, and quantiles by selection against percentile."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelmill.operators import blocked as BL
from panelmill.operators import windows as W
from panelmill.operators.impute import impute_prices
from panelmill.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def series(spark):
    """Series of 1 to 400 rows with gaps, one without any value, one without a key."""
    rnd = random.Random(5)
    rows = []
    for m, n in (("a", 400), ("b", 37), ("c", 1), ("d", 64), (None, 90), ("none", 20)):
        gap = 0
        for i in range(n):
            gap = gap - 1 if gap else (rnd.randint(1, 45) if rnd.random() < 0.08 else 0)
            rows.append((m, 2 * i, None if gap or m == "none" else rnd.uniform(50, 150)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "market string, day int, price_modal double")


def values(df, cols):
    near = lambda v: v if v is None else round(v, 8)
    return sorted((tuple([r.market is None, r.market or "", r.day, *[near(r[c]) for c in cols]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [32, 64, 1000])
def test_places_interpolation_and_features(spark, series, rows):
    numbered = BL.numbered(series, ["market"], "day")
    plain = W.add_position(series, ["market"], "day")
    assert values(numbered.withColumn("rn", F.col("_pos") + 1), ["rn"]) == values(plain, ["rn"])
    filled = BL.interpolate_in_blocks(numbered, "price_modal", ["market"], "day", rows)
    want = impute_prices(series, keys=["market"], order="day")
    assert values(filled, ["price_modal"]) == values(want, ["price_modal"])

    def feature(df, keys):
        df = W.add_lead_target(W.add_price_features(df, keys=keys, order="day"), keys=keys, order="day")
        return W.seasonal_naive(df, keys=keys, order="day")
    got = BL.in_blocks(filled, ["market"], "day", feature, 30, 1, rows, placed=True)
    cols = [c for c in feature(want, ["market"]).columns if c not in ("market", "day")]
    assert values(got, cols) == values(feature(want, ["market"]), cols)


def test_size_decides_and_halos_have_a_bound(spark, series):
    def feature(df, keys):
        return W.add_rolling_sum(df, "price_modal", keys, "day", 7, "s")
    a = BL.add_features(series, ["market"], "day", feature, 7)
    b = BL.add_features(series, ["market"], "day", feature, 7, hot=50, rows=40)
    assert values(a, ["s"]) == values(b, ["s"])
    assert BL.longest(series, ["market"]) == 400 and a.columns == b.columns
    with pytest.raises(ValueError):
        BL.in_blocks(series, ["market"], "day", feature, 30, 0, 8)
    assert BL.in_blocks(series.limit(0), ["market"], "day", feature, 7, 0, 8).count() == 0


def test_one_series_is_dealt_to_all_tasks(spark):
    df = spark.range(40000).select(F.lit("m").alias("market"), F.col("id").alias("day"), F.rand(1).alias("price_modal"))

    def feature(d, keys):
        return W.add_price_features(d, keys=keys, order="day").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = BL.in_blocks(df, ["market"], "day", feature, 30, 0, 1000)
        n = [r.n for r in out.groupBy("task").agg(F.count("*").alias("n"), F.max("price_ma7")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(n) == 40000 and len(n) == 4 and max(n) < 25000  # four shuffle partitions in the tests


@pytest.mark.parametrize("few,buckets", [(4096, 4096), (3, 16)])
def test_selection_equals_percentile(spark, few, buckets):
    rnd = random.Random(8)
    rows = [("one", 4.25), ("null", None), (None, 1.0), (None, None), (None, 7.0)]
    rows += [("ties", float(rnd.randint(0, 3))) for _ in range(200)] + [("spread", rnd.choice([-1, 1]) * 10 ** rnd.uniform(-3, 9)) for _ in range(150)]
    rows += [("even", float(i)) for i in range(100)] + [("flat", 2.0)] * 30
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "v", ["g"], qs, few, buckets).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", q).alias(c) for c, q in qs.items()]).collect()}
    assert set(got) == set(want)
    for g, r in want.items():
        for c in qs:
            assert (r[c] is None and got[g][c] is None) or math.isclose(r[c], got[g][c], rel_tol=1e-12), (g, c)
    whole = exact_quantiles(df.where("g = 'even'"), "v", [], {"m": 0.5}, few, buckets).collect()
    assert whole[0].m == 49.5 and exact_quantiles(df.limit(0), "v", ["g"], qs).count() == 0


@pytest.mark.parametrize("rows", [2, 7, 1000])
def test_as_of_takes_the_last_row_at_or_before(spark, rows):
    rnd = random.Random(rows)
    left = [(rnd.choice(["a", "b", "c", None]), rnd.randint(0, 60), i) for i in range(150)] + [("a", None, 999)]
    right = [(rnd.choice(["a", "b", None]), rnd.randint(5, 55), rnd.randint(0, 9)) for _ in range(40)] + [("a", 5, None), ("a", None, 3)]
    got = BL.as_of(spark.createDataFrame(left, "k string, day int, i int"), spark.createDataFrame(right, "k string, day int, v int"),
                   ["k"], "day", ["v"], rows).collect()
    value = lambda x: (x is not None, x or 0)
    want = {}
    for k, d, i in left:
        own = [(e, value(v), v) for q, e, v in right if k is not None and q == k and d is not None and e is not None and e <= d]
        best = max(own, key=lambda x: x[:2], default=(None, None, None))
        want[i] = (best[0], best[2])
    assert {r.i: (r.as_of, r.v) for r in got} == want and len(got) == len(left)


def test_a_bucketed_table_needs_no_exchange(spark, series):
    from panelmill.session import scratch_path
    from panelmill.sources.tables import write_bucketed
    df = write_bucketed(series, "t_bucketed", ["market"], "day", 4, scratch_path(spark, "t-bucketed"))
    out = W.add_lead_target(W.add_price_features(df, keys=["market"], order="day"), keys=["market"], order="day")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = W.add_price_features(series, keys=["market"], order="day")
    assert values(out, ["price_lag7", "price_ma30"]) == values(want, ["price_lag7", "price_ma30"])
    spark.sql("DROP TABLE t_bucketed")


def test_the_whole_feature_panel_in_blocks(spark):
    """One series of 150 days beside a short one, with weather and policy."""
    from panelmill.plans.features import ALL_FEATURES, build_feature_panel
    rnd = random.Random(2)
    day = "date_add(date'2000-11-01', cast({} as int))"
    rows = [("c", "s", m, i, None if rnd.random() < 0.2 else rnd.uniform(90, 110)) for m, n in (("m", 150), ("n", 40)) for i in range(n)]
    panel = spark.createDataFrame(rows, "commodity string, state string, market string, i int, price_modal double").withColumn(
        "date", F.expr(day.format("i"))).drop("i")
    cov = spark.range(150).select(F.lit("s").alias("state"), F.expr(day.format("id")).alias("date"), (F.rand(1) * 20 + 30).alias("max_temp"),
                                  (F.rand(2) * 10).alias("min_temp"), (F.rand(3) * 5).alias("rainfall_daily"), F.rand(4).alias("humidity"))
    policy = spark.createDataFrame([("c", 2000, 100.0), ("c", 2001, 104.0)], "crop string, year int, msp_rs_per_quintal double")
    plain = build_feature_panel(panel, cov, policy)
    blocked = build_feature_panel(panel, cov, policy, block_rows=32)
    assert blocked.columns == plain.columns
    read = lambda df: sorted(tuple([r.market, r.date, *[None if r[c] is None else round(float(r[c]), 8) for c in ALL_FEATURES]])
                             for r in df.collect())
    assert read(blocked) == read(plain) and blocked.count() > 170
