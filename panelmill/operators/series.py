"""Many-series statistical forecasts (M5, M6, M7).

Spark selects each series' training window (the last ``history`` points up
to ``train_end``: a per-series row_number, no driver work).

* M5 damped-trend additive Holt-Winters (period 7): the recursion is ``aggregate`` over a series' ordered values, one row per
  series and parameter set of the grid, no Python; the lowest one-step SSE wins; series
  shorter than two seasons use the non-seasonal damped trend.
* M6 seasonal ARIMA (p,1,q)(1,1,1)_7 by Hannan-Rissanen two-pass least
  squares on the differenced series (conditional LS, not Kalman MLE), then a
  recursive forecast integrated back to levels. ``sar`` is the model with the seasonal autoregression alone.
* M7 the (p, q) in 0..3 with the lowest AIC: every (series, order) is a group of its own, the least (AIC, order)
  of a series is an aggregate, and the chosen order is fitted once more for the forecast. All candidates use the same
  sample (one common start), so their AICs compare.

A series that cannot be fitted (too short, no finite forecast) keeps one row per step with a NULL
forecast and the reason in ``status``; no series disappears. A perfect fit (residual variance
0) has AIC minus infinity and is a valid forecast.

A group holds at most ``history`` rows, so no group can grow with the data.
Forecasts are produced for every day up to the panel's last date and joined
to the evaluation rows by date (decision D11).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.params import SARIMA_ORDER, SARIMA_SEASONAL
from panelmill.session import materialize, ship_code

PERIOD = SARIMA_SEASONAL[3]
ETS_GRID = list(itertools.product([0.1, 0.3, 0.5, 0.7, 0.9], [0.01, 0.1, 0.3],
                                  [0.01, 0.1, 0.3], [0.8, 0.9, 0.98]))


def training_windows(df: DataFrame, keys: Sequence[str], value: str, train_end: str,
                     history: int = 730, order: str = "date", reuse: bool = True) -> DataFrame:
    """O4 per series + the global last date (a scalar subquery) as the horizon end."""
    if reuse:
        df = materialize(df)  # read by the horizon subquery and by the windows
    end = df.select(F.max(order)).scalar()
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    tr = (df.where(F.col(order) <= F.lit(train_end).cast("date"))
          .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= history)
          .drop("_rn"))
    return tr.select(*keys, order, F.col(value).alias("y"), end.alias("horizon_end"))


# ---------------------------------------------------------------- ETS -----

ETS_FIXED = (0.3, 0.1, 0.1, 0.9)  # one parameter set, for a forecast that SQL can follow


def ets_states(train: DataFrame, keys: Sequence[str], grid=ETS_GRID, period: int = PERIOD) -> DataFrame:
    """The recursion of every series and parameter set: keys, last (date), horizon_end, n, i, params, phi, end
    (level, trend, season with the next day first, sse)."""
    sets = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(c) for c, v in zip(("a", "b", "g", "phi"), p)],
                              F.lit("alpha={},beta={},gamma={},phi={}".format(*map(float, p))).alias("text"))
                     for i, p in enumerate(grid)])
    line = train.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "y"))).alias("line"),
                                    F.max("date").alias("last"), F.max("horizon_end").alias("horizon_end"))
    line = line.withColumn("ys", F.transform("line", lambda p: p["y"].cast("double"))).drop("line")
    line = line.withColumn("n", F.size("ys"))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / period
    first, second = F.slice("ys", 1, period), F.slice("ys", period + 1, period)
    seasonal = F.col("n") >= 2 * period
    line = line.withColumn("l0", F.when(seasonal, mean(first)).otherwise(F.get("ys", F.lit(0))))
    line = line.withColumns({
        "b0": F.when(seasonal, (mean(second) - F.col("l0")) / period)
               .otherwise(F.coalesce(F.get("ys", F.lit(1)) - F.get("ys", F.lit(0)), F.lit(0.0))),
        "s0": F.when(seasonal, F.transform(first, lambda v: v - F.col("l0"))).otherwise(F.array(F.lit(0.0)))})
    # a fixed number of tasks: the recursions are the work, and their few rows would be put into one task
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = line.repartition(tasks, *keys).withColumn("p", F.explode(sets))
    a, b, phi = F.col("p.a"), F.col("p.b"), F.col("p.phi")
    g = F.when(seasonal, F.col("p.g")).otherwise(0.0)

    def step(acc, y):
        si, ahead = acc["season"][0], acc["level"] + phi * acc["trend"]
        level = a * (y - si) + (1 - a) * ahead
        e = y - (ahead + si)
        return F.struct(level.alias("level"), (b * (level - acc["level"]) + (1 - b) * phi * acc["trend"]).alias("trend"),
                        F.concat(F.slice(acc["season"], 2, period), F.array(g * (y - level) + (1 - g) * si)).alias("season"),
                        (acc["sse"] + e * e).alias("sse"))

    start = F.struct(F.col("l0").alias("level"), F.col("b0").alias("trend"), F.col("s0").alias("season"), F.lit(0.0).alias("sse"))
    text = F.concat("p.text", F.when(seasonal, "").otherwise(",ns"))
    return rows.select(*keys, "last", "horizon_end", "n", "p.i", "p.phi", text.alias("params"),
                       F.aggregate("ys", start, step).alias("end"))


def ets_forecasts(train: DataFrame, keys: Sequence[str], kind: str = "ets", grid=ETS_GRID) -> DataFrame:
    """M5 for every series: the set with the least SSE (the first of equal ones), one row per day ahead."""
    states = ets_states(train, keys, grid)
    own = states.columns[len(keys):]
    best = (states.groupBy(*keys).agg(F.min_by(F.struct(*own), F.struct(F.col("end.sse"), F.col("i"))).alias("x"))
            .select(*keys, "x.*"))
    steps = F.greatest(F.datediff("horizon_end", "last"), F.lit(0))
    ahead = best.withColumn("h", F.explode(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))))
    phi, h = F.col("phi"), F.col("h")
    damp = F.when(phi == 1, h.cast("double")).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))
    season = F.get("end.season", F.pmod(h - 1, F.size("end.season")))
    value = F.col("end.level") + damp * F.col("end.trend") + season
    short, fine = F.col("n") < 3, ~F.isnan(value) & (F.abs(value) < float("inf"))
    return ahead.select(*keys, F.date_add("last", h).alias("date"), F.when(~short & fine, value).alias("y_hat"),
                        F.lit(kind).alias("model"), F.when(short, "").otherwise(F.col("params")).alias("params"),
                        F.when(short, "too short").when(F.coalesce(fine, F.lit(False)), "ok").otherwise("not finite").alias("status"))


# ------------------------------------------------------------- SARIMA -----

def _lags(p: int, seasonal: bool = True) -> list[int]:
    base = list(range(1, p + 1))
    return sorted(set(base + ([PERIOD] + [PERIOD + i for i in base] if seasonal else [])))


def _lagmat(x: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    return np.column_stack([x[start - k:len(x) - k] for k in lags]) if lags else \
        np.empty((len(x) - start, 0))


LONG_AR = 3 * PERIOD
START = LONG_AR + PERIOD + 3  # first usable residual of the largest candidate (p = q = 3)


def innovations(y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(differenced series, long-AR innovations); None if the series is too short."""
    if len(y) < PERIOD + 1 + START + 1:
        return None
    w = y[PERIOD + 1:] - y[PERIOD:-1] - y[1:-PERIOD] + y[:-PERIOD - 1]
    x = _lagmat(w, list(range(1, LONG_AR + 1)), LONG_AR)
    coef, *_ = np.linalg.lstsq(x, w[LONG_AR:], rcond=None)
    e = np.zeros(len(w))
    e[LONG_AR:] = w[LONG_AR:] - x @ coef
    return w, e


def sarima_fit(w: np.ndarray, e: np.ndarray, p: int, q: int):
    """(coefficients, residuals from START on, AIC) of (p,1,q)(1,1,1)_7; None with fewer rows than parameters."""
    ar, ma = _lags(p), _lags(q)
    if len(w) - START < len(ar) + len(ma) + 1:
        return None
    x = np.hstack([_lagmat(w, ar, START), _lagmat(e, ma, START)])
    coef, *_ = np.linalg.lstsq(x, w[START:], rcond=None)
    resid = w[START:] - x @ coef
    sigma2 = float(resid @ resid) / len(resid)
    aic = len(resid) * np.log(sigma2) + 2 * (len(coef) + 1) if sigma2 > 0 else -np.inf
    return coef, resid, float(aic)


def sarima_forecast(y: np.ndarray, w: np.ndarray, fit, steps: int, p: int, q: int) -> np.ndarray:
    """Recursive forecast of the differenced series, integrated back to levels."""
    ar, ma = _lags(p), _lags(q)
    coef, resid, _ = fit
    a, m = coef[:len(ar)], coef[len(ar):]
    ahead_w, ahead_y = list(w), list(y)
    ahead_e = [*np.zeros(len(w) - len(resid)), *resid]
    for _ in range(steps):
        nxt = sum(c * ahead_w[-k] for c, k in zip(a, ar)) + sum(c * ahead_e[-k] for c, k in zip(m, ma))
        ahead_w.append(nxt)
        ahead_e.append(0.0)
        ahead_y.append(nxt + ahead_y[-1] + ahead_y[-PERIOD] - ahead_y[-PERIOD - 1])
    return np.array(ahead_y[len(y):])


def sarima_fit_forecast(y: np.ndarray, steps: int, orders: Sequence[tuple[int, int]] = ((1, 1),)):
    """(forecast, description, status) of the order with the lowest AIC; the forecast is None if there is none."""
    y = np.asarray(y, dtype=float)
    base = innovations(y)
    if base is None:
        return None, "", "too short"
    w, e = base
    fits = {}
    for p, q in orders:
        try:
            fit = sarima_fit(w, e, p, q)
        except np.linalg.LinAlgError:
            continue
        if fit is not None:
            fits[p, q] = fit
    if not fits:
        return None, "", "too short"
    p, q = min(fits, key=lambda o: (fits[o][2], o))
    with np.errstate(all="ignore"):
        fc = sarima_forecast(y, w, fits[p, q], steps, p, q)
    text = f"order=({p},1,{q}),aic={fits[p, q][2]:.4f}"
    if not np.all(np.isfinite(fc)):
        return None, text, "not finite"
    return fc, text, "ok"


def seasonal_ar(y: np.ndarray, steps: int):
    """(0,1,0)(1,1,0)_7: one coefficient by least squares on the differenced series."""
    y = np.asarray(y, dtype=float)
    if len(y) < 2 * PERIOD + 3:
        return None, "", "too short"
    w = y[PERIOD + 1:] - y[PERIOD:-1] - y[1:-PERIOD] + y[:-PERIOD - 1]
    square = float(w[:-PERIOD] @ w[:-PERIOD])
    a = float(w[PERIOD:] @ w[:-PERIOD]) / square if square else 0.0
    ahead_w, ahead_y = list(w), list(y)
    for _ in range(steps):
        ahead_w.append(a * ahead_w[-PERIOD])
        ahead_y.append(ahead_w[-1] + ahead_y[-1] + ahead_y[-PERIOD] - ahead_y[-PERIOD - 1])
    return np.array(ahead_y[len(y):]), f"a={a:.6f}", "ok"


ORDERS = list(itertools.product(range(4), range(4)))


def select_orders(train: DataFrame, keys: Sequence[str], orders=ORDERS) -> DataFrame:
    """M7: keys, p, q, aic of the order with the lowest AIC per series; a series that no order fits has no row.

    Every (series, order) is one group, so the candidates of one series run side by side.
    """
    ship_code(train.sparkSession)
    every = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in orders])).alias("o")
    kschema = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in keys)

    def run(name, pdf):
        p, q = (int(x) for x in name[-2:])
        base = innovations(pdf.sort_values("date")["y"].to_numpy(dtype=float))
        try:
            fit = sarima_fit(*base, p, q) if base is not None else None
        except np.linalg.LinAlgError:
            fit = None
        out = pd.DataFrame([name], columns=[*keys, "p", "q"])
        return out.assign(aic=fit[2]) if fit is not None and not np.isnan(fit[2]) else out.iloc[:0].assign(aic=0.0)

    fits = (train.select(*keys, "date", "y", every).select(*keys, "date", "y", "o.p", "o.q")
            .groupBy(*keys, "p", "q").applyInPandas(run, f"{kschema}, p int, q int, aic double"))
    return fits.groupBy(*keys).agg(F.min(F.struct("aic", "p", "q")).alias("x")).select(*keys, "x.p", "x.q", "x.aic")


def fit_kind(y: np.ndarray, steps: int, kind: str, order=None):
    """(model name, forecast or None, parameters, status)."""
    if kind == "sarima":
        return "sarima_fix", *sarima_fit_forecast(y, steps, [(SARIMA_ORDER[0], SARIMA_ORDER[2])])
    if kind == "sar":
        return "sar", *seasonal_ar(y, steps)
    return "sarima_aic", *(sarima_fit_forecast(y, steps, [order]) if order else (None, "", "too short"))


def _job(keys: Sequence[str], kinds: Sequence[str]):
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["y"].to_numpy(dtype=float)
        last = pd.Timestamp(pdf["date"].iloc[-1])
        steps = max(int((pd.Timestamp(pdf["horizon_end"].iloc[0]) - last).days), 0)
        dates = [(last + pd.Timedelta(days=h)).date() for h in range(1, steps + 1)]
        order = None
        if "p" in pdf and not pd.isna(pdf["p"].iloc[0]):
            order = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        parts = []
        for kind in kinds if steps else []:
            model, fc, params, status = fit_kind(y, steps, kind, order)
            parts.append(pd.DataFrame({
                **{k: [pdf[k].iloc[0]] * steps for k in keys}, "date": dates,
                "y_hat": np.full(steps, np.nan) if fc is None else np.asarray(fc, dtype=float),
                "model": model, "params": params, "status": status}))
        if parts:
            return pd.concat(parts, ignore_index=True)
        return pd.DataFrame({**{k: pdf[k].iloc[:0] for k in keys}, "date": pd.Series([], dtype=object),
                             "y_hat": pd.Series([], dtype=float),
                             **{c: pd.Series([], dtype=object) for c in ("model", "params", "status")}})
    return run


def forecast_series(train: DataFrame, keys: Sequence[str], kinds: str | Sequence[str]) -> DataFrame:
    """Run ``ets`` | ``ets_fixed`` | ``sarima`` | ``sarima_aic`` | ``sar`` (one or several) over every series."""
    ship_code(train.sparkSession)
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    parts = [ets_forecasts(train, keys, k, ETS_GRID if k == "ets" else [ETS_FIXED]) for k in kinds if k.startswith("ets")]
    others = [k for k in kinds if not k.startswith("ets")]
    if others:
        rows = train
        if "sarima_aic" in others:
            rows = train.join(materialize(select_orders(train, keys)).drop("aic"), list(keys), "left")
        kschema = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in keys)
        schema = f"{kschema}, date date, y_hat double, model string, params string, status string"
        out = rows.groupBy(*keys).applyInPandas(_job(keys, others), schema)
        parts.append(out.withColumn("y_hat", F.when(~F.isnan("y_hat"), F.col("y_hat"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
