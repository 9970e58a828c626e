"""Property tests."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions.welfare import welfare_sql
from panelmill.operators import metrics as M
from panelmill.functions.special import normal_two_sided
from panelmill.operators import regression as R
from panelmill.operators.impute import impute_prices
from panelmill.operators.joins import as_of_join, assign_folds
from panelmill.operators.policy import gradient, optimal_floor
from panelmill.params import FOLDS
from panelmill.sources.prices_csv import header_mapping


def _welfare_np(m, p, es, ed, q0, Q, a, b, g, d, eta, kappa=0.15, u=10.0):
    gap = m - p
    q = q0 + eta * gap / 100 if eta > 0 else q0
    ps = gap * q * u + 0.5 * es * (gap ** 2 / p) * Q * u
    qc = Q - q
    cs = (np.abs(gap) * qc * u) * (gap > 0) + 0.5 * abs(ed) * (gap ** 2 / p) * qc * u
    gc = gap * q * (1 + kappa) * u
    dwl = 0.5 * (es + abs(ed)) * (gap ** 2 / p) * Q * u
    return a * ps - b * cs - g * gc - d * dwl


def test_v3_closed_form_beats_dense_grid(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        rows.append((f"c{i}", float(rng.uniform(800, 4000)), float(rng.uniform(0.1, 1.0)),
                     float(-rng.uniform(0.1, 1.0)), float(rng.uniform(5, 60)),
                     float(rng.uniform(80, 200)), *[float(x) for x in rng.dirichlet([1, 1, 1, 1])],
                     float(rng.choice([0.0, rng.uniform(0, 3)]))))
    df = spark.createDataFrame(rows, "commodity string, p double, eps_s double, eps_d double, "
                                     "q_proc double, q_total double, alpha double, beta double, "
                                     "gamma double, delta double, eta double")
    out = {r.commodity: r for r in optimal_floor(df).collect()}
    grid = np.linspace(-200, 1500, 17001)
    for c, p, es, ed, q0, Q, a, b, g, d, eta in rows:
        w = _welfare_np(p + grid, p, es, ed, q0, Q, a, b, g, d, eta)
        assert out[c].w_star >= w.max() - 1e-6 * max(1.0, abs(w.max()))
        assert -200 - 1e-9 <= out[c].m_star - p <= 1500 + 1e-9


def test_v1_matches_numpy(spark):
    df = spark.createDataFrame([(2350.0, 2500.0, 0.45, -0.32, 26.64, 112.0, .3, .3, .3, .1, 1.0)],
                               "p double, m double, eps_s double, eps_d double, q_proc double, "
                               "q_total double, alpha double, beta double, gamma double, "
                               "delta double, eta double")
    got = df.select(F.expr(welfare_sql("m")).alias("w")).first().w
    assert got == pytest.approx(_welfare_np(2500.0, 2350.0, .45, -.32, 26.64, 112.0,
                                            .3, .3, .3, .1, 1.0))


def test_w17_gradient_matches_numpy(spark):
    x = np.cumsum(np.random.default_rng(1).uniform(0.5, 2.0, 40))
    y = np.sin(x) * 100
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "k string, i int, m double, w double")
    got = [r.d for r in gradient(df, "w", "m", ["k"], out="d").orderBy("i").collect()]
    assert np.allclose(got, np.gradient(y, x), rtol=1e-9, atol=1e-9)


def _dm_numpy(d):
    T = len(d)
    b = int(round(T ** (1 / 3)))
    while b ** 3 > T:
        b -= 1
    while (b + 1) ** 3 <= T:
        b += 1
    g = np.var(d, ddof=1) + sum(2 * (1 - k / (b + 1)) * np.cov(d[k:], d[:-k])[0, 1]
                                for k in range(1, b + 1))
    v = g / T
    return np.mean(d) / np.sqrt(v) if v > 0 else np.nan


def test_g12_dm_matches_numpy_and_is_antisymmetric(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, T in [("a", 125), ("b", 64), ("c", 30)]:
        for t in range(1, T + 1):
            rows.append((s, t, float(rng.normal(0.2, 1.0))))
    d = spark.createDataFrame(rows, "s string, t int, d double")
    got = {r.s: r.dm_stat for r in M.diebold_mariano(d, ["s"]).collect()}
    neg = {r.s: r.dm_stat for r in
           M.diebold_mariano(d.withColumn("d", -F.col("d")), ["s"]).collect()}
    for s in "abc":
        arr = np.array([x for k, _, x in sorted(rows) if k == s])
        assert got[s] == pytest.approx(_dm_numpy(arr), rel=1e-9)
        assert neg[s] == pytest.approx(-got[s], rel=1e-12)


def test_dm_pvalue(spark):
    df = spark.createDataFrame([(0.0,), (1.959963984540054,), (None,)], "z double")
    p = [r.p for r in df.select(normal_two_sided(F.col("z")).alias("p")).collect()]
    assert p[0] == pytest.approx(1.0) and p[1] == pytest.approx(0.05) and p[2] is None


def test_w5_exact_on_linear_series(spark):
    vals = [3.0 * i + 1.0 if i % 3 else None for i in range(1, 30)]
    vals[-1] = 3.0 * 29 + 1.0
    d0 = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("m", d0 + dt.timedelta(days=i), v) for i, v in enumerate(vals)],
                               "market string, date date, price_modal double")
    got = [r.price_modal for r in impute_prices(df).orderBy("date").collect()]
    assert got == pytest.approx([3.0 * i + 1.0 for i in range(1, 30)])


def test_cv_folds_never_leak(spark):
    d0 = dt.date(1998, 1, 1)
    df = spark.createDataFrame([(d0 + dt.timedelta(days=i),) for i in range(1200)], "date date")
    out = assign_folds(df, FOLDS).collect()
    bounds = {f: (dt.date.fromisoformat(te), dt.date.fromisoformat(ts)) for f, te, ts, _ in FOLDS}
    for r in out:
        te, ts = bounds[r.fold]
        if r.role == "train":
            assert r.date <= te
        else:
            assert r.date >= ts
    assert {r.role for r in out} == {"train", "test"}


def test_as_of_join_fills_outside_years(spark):
    dim = spark.createDataFrame([("w", 2000, 10.0), ("w", 2002, 12.0)],
                                "crop string, year int, v double")
    df = spark.createDataFrame([("w", y) for y in (1998, 2000, 2001, 2002, 2005)],
                               "commodity string, year int")
    got = {r.year: r.v for r in as_of_join(df, dim, "commodity", "crop", cols=["v"]).collect()}
    assert got == {1998: 10.0, 2000: 10.0, 2001: 10.0, 2002: 12.0, 2005: 12.0}


def test_header_canonicalisation_prefers_date_over_arrival():
    m = header_mapping(["Market Name", "Arrivals (Tonnes)", "State Name", "Price Date",
                        "Modal Price (Rs./Quintal)", "Min Price"])
    assert m == {"Market Name": "market", "Price Date": "date", "State Name": "state",
                 "Modal Price (Rs./Quintal)": "price_modal"}


def test_m10_equals_dummy_ols_with_clustered_se(spark):
    rng = np.random.default_rng(11)
    G, T, k = 6, 80, 3
    rows, X, y, mk = [], [], [], []
    for gi in range(G):
        fe = rng.normal(0, 5)
        for t in range(T):
            x = rng.normal(size=k)
            yy = fe + x @ np.array([1.5, -2.0, 0.5]) + rng.normal(0, 1 + 0.3 * gi)
            rows.append(("c", f"m{gi}", t, float(yy), *[float(v) for v in x]))
            X.append(x), y.append(yy), mk.append(gi)
    names = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(rows, "commodity string, market string, t int, y double, "
                                     + ", ".join(f"{n} double" for n in names))
    got = {r.variable: r for r in R.fit_fixed_effects(df, names, y="y").collect()}
    X, y, mk = np.array(X), np.array(y), np.array(mk)
    D = np.eye(G)[mk][:, 1:]
    Z = np.hstack([np.ones((len(y), 1)), D, X])
    beta, *_ = np.linalg.lstsq(Z, y, rcond=None)
    u = y - Z @ beta
    inv = np.linalg.inv(Z.T @ Z)
    meat = sum(np.outer(Z[mk == g].T @ u[mk == g], Z[mk == g].T @ u[mk == g]) for g in range(G))
    n, K = len(y), Z.shape[1]
    cov = (G / (G - 1)) * ((n - 1) / (n - K)) * inv @ meat @ inv
    for i, name in enumerate(names):
        j = 1 + (G - 1) + i
        assert got[name].coefficient == pytest.approx(beta[j], rel=1e-8)
        assert got[name].std_error == pytest.approx(np.sqrt(cov[j, j]), rel=1e-6)
    assert got["x0"].stars == "***"


def test_layout_independent_draws(spark):
    import __spark_entry__ as E
    q = E.queries()["v9_v10_draws"]
    from tests.conftest import SF_SMALL
    a = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def plain_smoothing(y, grid, steps, period=7):
    """The recursion by loops; returns the forecast of the set with the least one-step SSE."""
    best = None
    for a, b, g, phi in grid:
        if len(y) >= 2 * period:
            level = sum(y[:period]) / period
            trend, s, m = (sum(y[period:2 * period]) / period - level) / period, [v - level for v in y[:period]], period
        else:
            level, trend, s, m, g = y[0], y[1] - y[0], [0.0], 1, 0.0
        sse = 0.0
        for t, v in enumerate(y):
            si, ahead = s[t % m], level + phi * trend
            sse += (v - ahead - si) ** 2
            new = a * (v - si) + (1 - a) * ahead
            trend = b * (new - level) + (1 - b) * phi * trend
            s[t % m] = g * (v - new) + (1 - g) * si
            level = new
        fc = [level + trend * sum(phi ** k for k in range(1, h + 1)) + s[(len(y) + h - 1) % m] for h in range(1, steps + 1)]
        if best is None or sse < best[0]:
            best = sse, fc
    return best[1]


def test_smoothing_in_the_jvm_equals_the_loops(spark):
    from panelmill.operators.series import ETS_GRID, ets_forecasts
    rng = np.random.default_rng(11)
    data = {f"s{n}": (100 + np.cumsum(rng.normal(0, 1, n)) + 5 * np.sin(2 * np.pi * np.arange(n) / 7)).tolist() for n in (3, 9, 14, 60, 200)}
    d0 = dt.date(2020, 1, 1)
    rows = [(k, d0 + dt.timedelta(days=i), v, d0 + dt.timedelta(days=len(ys) + 9)) for k, ys in data.items() for i, v in enumerate(ys)]
    train = spark.createDataFrame(rows, "market string, date date, y double, horizon_end date")
    df = ets_forecasts(train, ["market"])
    got = {}
    for r in df.orderBy("market", "date").collect():
        got.setdefault(r.market, []).append(r.y_hat)
    for k, ys in data.items():
        assert np.allclose(got[k], plain_smoothing(ys, ETS_GRID, 10)), k
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_series_forecasts_track_a_clean_seasonal_series():
    from panelmill.operators.series import ETS_GRID, sarima_fit_forecast
    t = np.arange(400)
    y = 1000 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 7)
    truth = 1000 + 0.5 * (400 + np.arange(14)) + 20 * np.sin(2 * np.pi * (400 + np.arange(14)) / 7)
    fc = plain_smoothing(y.tolist(), ETS_GRID, 14)
    assert np.max(np.abs(fc - truth)) < 15
    fc2, _, status = sarima_fit_forecast(y + np.random.default_rng(0).normal(0, 0.1, 400), 14)
    assert status == "ok" and np.max(np.abs(fc2 - truth)) < 5


def test_short_and_constant_series_keep_their_rows(spark):
    from panelmill.operators.series import forecast_series
    d0, end = dt.date(2020, 1, 1), dt.date(2021, 2, 10)
    rng = np.random.default_rng(3)
    rows = []
    for name, n, value in (("good", 400, None), ("short", 40, None), ("flat", 400, 7.0), ("two", 2, None)):
        start = dt.date(2021, 2, 3) - dt.timedelta(days=n)
        for i in range(n):
            v = value if value is not None else 100 + 3 * (i % 7) + float(rng.normal())
            rows.append((name, start + dt.timedelta(days=i), v, end))
    train = spark.createDataFrame(rows, "market string, date date, y double, horizon_end date")
    got = forecast_series(train, ["market"], ["ets", "sarima", "sarima_aic"]).collect()
    by = {}
    for r in got:
        by.setdefault((r.market, r.model), []).append(r)
    assert len(by) == 12 and all(len(v) == 8 for v in by.values())
    for model in ("sarima_fix", "sarima_aic"):
        assert all(r.y_hat is None and r.status == "too short" for r in by["short", model])
        assert all(r.y_hat == pytest.approx(7.0) and r.status == "ok" for r in by["flat", model])
        assert all(r.y_hat is not None for r in by["good", model])
    assert all(r.y_hat is None and r.status == "too short" for r in by["two", "ets"])
    assert all(r.y_hat is not None for r in by["short", "ets"])


def test_aic_candidates_share_one_sample():
    from panelmill.operators.series import ORDERS, innovations, sarima_fit
    y = np.cumsum(np.random.default_rng(5).normal(0, 50, 300)) + 1000
    w, e = innovations(y)
    assert len({len(sarima_fit(w, e, p, q)[1]) for p, q in ORDERS}) == 1


def test_no_truncated_draw_is_lost(spark):
    from panelmill.operators.uncertainty import truncated_draw_sql
    d = spark.range(1000).selectExpr("'c' AS commodity", "cast(id as int) AS draw", "-1.0D AS m", "1.0D AS s", "-9.0D AS far")
    out = d.select(F.expr(truncated_draw_sql("m", "s", "+", 7, "a")).alias("x"),
                   F.expr(truncated_draw_sql("far", "s", "+", 7, "b")).alias("y"),
                   F.expr(truncated_draw_sql("m", "s", "-", 7, "c")).alias("z")).collect()
    assert all(r.x > 0 and r.y > 0 and r.z < 0 for r in out)
    # mean of a normal(-1, 1) above 0: -1 + phi(1) / (1 - Phi(1)) = 0.525
    assert np.mean([r.x for r in out]) == pytest.approx(0.525, abs=0.05)
    assert np.mean([r.z for r in out]) == pytest.approx(-1.288, abs=0.08)


def test_regressor_units_do_not_matter(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(5):
        for t in range(60):
            a, b = rng.normal(), rng.normal()
            rows.append(("c", f"m{g}", float(3 * a - 2 * b + g + rng.normal()), float(a), float(b), float(b) * 1e5,
                         4.0, float(a + b)))
    df = spark.createDataFrame(rows, "commodity string, market string, y double, a double, b double, big double, "
                                     "flat double, both double")
    one = {r.variable: r for r in R.fit_fixed_effects(df, ["a", "b", "flat"], y="y").collect()}
    two = {r.variable: r for r in R.fit_fixed_effects(df, ["a", "big", "flat"], y="y").collect()}
    assert one["flat"].coefficient is None and one["a"].coefficient == pytest.approx(two["a"].coefficient, rel=1e-9)
    assert one["b"].coefficient == pytest.approx(two["big"].coefficient * 1e5, rel=1e-9)
    assert one["b"].std_error == pytest.approx(two["big"].std_error * 1e5, rel=1e-9)
    dup = {r.variable: r for r in R.fit_fixed_effects(df, ["a", "b", "both"], y="y").collect()}
    assert sum(r.coefficient is None for r in dup.values()) == 1
    assert dup["a"].adj_r2_within == pytest.approx(one["a"].adj_r2_within, rel=1e-9)
