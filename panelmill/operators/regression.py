"""Fixed-effects panel regression with market-clustered errors.

Plan, per group (commodity) with entity = market:

1. ``prepare_panel``: lag-7 covariates, lags 1/7 of price, time trend, month
   dummies 2-12 (one shared window exchange on the series keys), drop rows
   missing any regressor.
2. ``entity_moments``: one pass over the rows gives, per (group, entity), the count and the centred cross
   products of regressors and target (numpy per Arrow batch, one row per entity and task: 190 aggregates in the JVM take
   four times as long), merged on Spark without cancellation, one column per pair. What follows is Catalyst expressions.
3. ``solved``: one row per group. The centred cross
   products ARE the within (entity-demeaned) sums, so their total is the Gram
   matrix. A sweep operator over an array of arrays turns it into the inverse, the coefficients and the residual sum at once:
   pivots are taken in the order of what is left on the diagonal, and none that is too small.
4. ``fit_fixed_effects``: the cluster scores follow from the entities' products without a second
   look at the data: s_g = X'y_g - X'X_g beta. The diagonal of
   c (X'X)^-1 (sum s_g s_g') (X'X)^-1 is c sum ((X'X)^-1 s_g)^2, one vector per entity, with
   c = G/(G-1) (N-1)/(N-K), K = regressors used + G.

The Gram matrix is scaled to a unit diagonal before it is solved, so units do not
matter. A regressor that is constant within every entity, or a linear
combination of others (what the sweep leaves of its unit diagonal), has NULL results and does not
count in K. Market dummies are never built (M12 is only a test).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.selection import month_dummies, significance_stars
from panelmill.session import materialize, ship_code

WEATHER_LAGGED = ["rainfall_7d_cum", "temp_anomaly", "extreme_heat_days", "drought_indicator"]
MONTHS = [f"month_{m}" for m in range(2, 13)]
COLLINEAR = 1e-10  # share of a scaled regressor's variance that the others leave unexplained


def regressors(weather: Sequence[str] = WEATHER_LAGGED) -> list[str]:
    return [f"{w}_lag7" for w in weather] + ["price_lag1", "price_lag7", "time_trend"] + MONTHS


def prepare_panel(df: DataFrame, keys=("commodity", "market"), order: str = "date",
                  weather: Sequence[str] = WEATHER_LAGGED, value: str = "price_modal",
                  reuse: bool = True) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    present = [c for c in weather if c in df.columns]
    if reuse:
        df = materialize(df)
    d0 = df.select(F.min(order)).scalar()
    out = df.select(*keys, order, value,
                    *[F.lag(c, 7).over(w).alias(f"{c}_lag7") for c in present],
                    F.lag(value, 1).over(w).alias("price_lag1"),
                    F.lag(value, 7).over(w).alias("price_lag7"))
    out = out.withColumn("time_trend", F.datediff(order, d0).cast("double"))
    out = out.select("*", *month_dummies(F.month(order)))
    need = [f"{c}_lag7" for c in present] + ["price_lag1", "price_lag7"]
    return out.na.drop(subset=need)


def merge_moments(a, b):
    """Count, means, centred cross products and largest magnitudes of two disjoint sets of rows."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return (n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n),
            np.maximum(a[3], b[3]))


def task_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, n, mean, cross, top): moments of ``cols`` per entity, one row per entity and task."""
    keys, cols = list(keys), list(cols)

    def run(batches):
        held: dict[tuple, tuple] = {}
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])
            names = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            number = {k: i for i, k in enumerate(dict.fromkeys(names))}
            code = np.fromiter((number[k] for k in names), np.int64, len(names))
            for key, i in number.items():
                rows = x[code == i]
                mean = rows.mean(axis=0)
                own = (len(rows), mean, (rows - mean).T @ (rows - mean), np.abs(rows).max(axis=0))
                held[key] = merge_moments(held[key], own) if key in held else own
        out = [pa.array(list(c)) for c in zip(*held)] if held else [pa.array([], pa.string())] * len(keys)
        values = list(held.values())
        lists = [pa.array([v[i].ravel().tolist() for v in values], pa.list_(pa.float64())) for i in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays(
            [*out, pa.array([v[0] for v in values], pa.int64()), *lists], [*keys, "n", "mean", "cross", "top"])

    ship_code(df.sparkSession)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    return rows.mapInArrow(run, f"{kinds}, n long, mean array<double>, cross array<double>, top array<double>")


def pairs(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def entity_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, n, top<i>, p<i>_<j>): count, largest magnitudes and centred cross products of ``cols`` per entity.

    The tasks' products are centred on their own means; merging moves them to the entity's mean,
    so there is no difference of large sums.
    """
    m = len(cols)
    parts = materialize(task_moments(df, keys, cols))  # one row per entity and task
    means = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.array(*[
        F.sum(F.col("n") * F.col("mean")[i]) / F.sum("n") for i in range(m)]).alias("_mean"))
    moved = parts.join(means, list(keys)).withColumn("off", F.zip_with("mean", "_mean", lambda a, b: a - b))
    return moved.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.max(F.col("top")[i]).alias(f"top{i}") for i in range(m)],
        *[F.sum(F.col("cross")[i * m + j] + F.col("n") * F.col("off")[i] * F.col("off")[j]).alias(f"p{i}_{j}")
          for i, j in pairs(m)])


def matrix(m: int) -> Column:
    """The symmetric array of arrays of the pair columns."""
    return F.array(*[F.array(*[F.col(f"p{min(i, j)}_{max(i, j)}") for j in range(m)]) for i in range(m)])


def swept(a: Column, p: Column) -> Column:
    """Matrix ``a`` after a sweep of pivot ``p``."""
    d, row_p = a[p][p], a[p]
    return F.transform(a, lambda row, i: F.transform(row, lambda v, j: (
        F.when((i == p) & (j == p), 1 / d).when(i == p, v / d).when(j == p, -v / d).otherwise(v - row[p] * row_p[j] / d))))


def sweep_step(k: int):
    """One step of the sweep over (a, open): the open regressor with the largest rest is swept, if the rest is no rounding."""

    def step(state: Column, _: Column) -> Column:
        rests = F.transform(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: state["open"][i]),
                            lambda i: F.struct(state["a"][i][i].alias("rest"), (-i).alias("place")))
        best = F.array_max(rests)
        # an array of one pivot or none, so that the pivot is found once
        pivot = F.when(best["rest"] > COLLINEAR, F.array(-best["place"])).otherwise(F.array().cast("array<int>"))
        done = F.transform(pivot, lambda p: F.struct(swept(state["a"], p).alias("a"), F.transform(
            state["open"], lambda o, i: o & (i != p)).alias("open")))
        return F.coalesce(F.get(done, F.lit(0)), state)

    return step


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def gram(entities: DataFrame, group: Sequence[str], m: int) -> DataFrame:
    """(group, n, g, cross, top) from the entities' moments."""
    sums = entities.groupBy(*group).agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), F.array(*[F.max(f"top{i}") for i in range(m)]).alias("top"),
        *[F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in pairs(m)])
    return sums.select(*group, "n", "g", "top", matrix(m).alias("cross"))


def varies(i: Column | int) -> Column:
    """Whether a column moves within entities by more than rounding."""
    return F.get("cross", F.lit(i))[F.lit(i)] > F.col("n") * F.pow(F.lit(1e-12) * F.get("top", F.lit(i)), F.lit(2.0))


def solved(entities: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """(group, n, g, kept, beta, inverse, ssr, yy); zeros in ``beta`` and ``inverse`` for regressors that are left out."""
    rows = gram(entities, group, k + 1).withColumn("moves", F.array(*[varies(i) for i in range(k)]))
    size = F.array(*[F.when(F.get("moves", F.lit(i)), F.sqrt(F.get(F.get("cross", F.lit(i)), F.lit(i)))).otherwise(1.0)
                     for i in range(k)], F.greatest(F.sqrt(F.get(F.get("cross", F.lit(k)), F.lit(k))), F.lit(1e-300)))
    rows = rows.withColumn("size", size)
    scaled = F.transform("cross", lambda row, i: F.transform(row, lambda v, j: v / (F.get("size", i) * F.get("size", j))))
    start = F.struct(scaled.alias("a"), F.col("moves").alias("open"))
    rows = rows.withColumn("end", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, sweep_step(k)))
    rows = rows.withColumn("kept", F.zip_with("moves", "end.open", lambda m, o: m & ~o))
    places = F.sequence(F.lit(0), F.lit(k - 1))
    kept = lambda i: F.get("kept", i)
    beta = F.transform(places, lambda i: F.when(kept(i), F.col("end.a")[i][k] * F.get("size", F.lit(k)) / F.get("size", i)).otherwise(0.0))
    inverse = F.transform(places, lambda i: F.transform(places, lambda j: F.when(
        kept(i) & kept(j), F.col("end.a")[i][j] / (F.get("size", i) * F.get("size", j))).otherwise(0.0)))
    yy = F.get(F.get("cross", F.lit(k)), F.lit(k))
    return rows.select(*group, "n", "g", "kept", beta.alias("beta"), inverse.alias("inverse"), yy.alias("yy"),
                       F.greatest(F.col("end.a")[k][k] * yy, F.lit(0.0)).alias("ssr"))


def within_slopes(panel: DataFrame, xcols: Sequence[str], y: str = "price_modal",
                  group: Sequence[str] = ("commodity",), entity: str = "market") -> DataFrame:
    """(group, variable, slope): one-regressor within slopes; NULL for a constant regressor."""
    k = len(xcols)
    rows = gram(entity_moments(panel, [*group, entity], [*xcols, y]), group, k + 1)
    cell = lambda i, j: F.get(F.get("cross", F.lit(i)), F.lit(j))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.when(varies(i), cell(i, k) / cell(i, i)).alias("slope"))
                               for i, c in enumerate(xcols)])).alias("x")
    return rows.select(*group, each).select(*group, "x.*")


def fit_fixed_effects(panel: DataFrame, xcols: Sequence[str], y: str = "price_modal",
                      group: Sequence[str] = ("commodity",), entity: str = "market"
                      ) -> DataFrame:
    """M10 + M11 + M13: within estimator, clustered SEs, coefficient table."""
    from panelmill.functions.special import normal_two_sided
    k = len(xcols)
    entities = materialize(entity_moments(panel, [*group, entity], [*xcols, y]))  # one row per entity
    fits = materialize(solved(entities, group, k))
    own = entities.select(*group, matrix(k + 1).alias("cross")).join(fits.select(*group, "beta", "inverse"), list(group))
    score = F.transform(F.slice("cross", 1, k), lambda row: row[k] - dot(F.slice(row, 1, k), F.col("beta")))
    own = own.withColumn("score", score)
    part = F.transform("inverse", lambda row: dot(row, F.col("score")))
    meat = own.select(*group, F.posexplode(part).alias("place", "z")).groupBy(*group, "place").agg(F.sum(F.col("z") ** 2).alias("meat"))
    n, g, rank = F.col("n"), F.col("g"), F.size(F.filter("kept", lambda v: v))
    free = n - rank - g
    r2 = F.when(F.col("yy") > 0, 1 - F.col("ssr") / F.col("yy"))
    names = F.array(*map(F.lit, xcols))
    out = fits.withColumns({"free": free, "r2_within": r2}).select(
        "*", F.posexplode("kept").alias("place", "used")).join(meat, [*group, "place"])
    scale = (g / (g - 1)) * ((n - 1) / F.col("free"))
    out = out.select(
        *group, F.get(names, F.col("place")).alias("variable"), F.when(F.col("used"), F.get("beta", F.col("place"))).alias("coefficient"),
        F.when(F.col("used") & (g > 1) & (F.col("free") > 0), F.sqrt(F.when((g > 1) & (F.col("free") > 0), scale) * F.col("meat")))
        .alias("std_error"),
        n.alias("nobs"), "r2_within", F.when(F.col("free") > 0, 1 - (1 - F.col("r2_within")) * (n - g)
                                             / F.when(F.col("free") > 0, F.col("free"))).alias("adj_r2_within"))
    z = F.try_divide(F.col("coefficient"), F.col("std_error"))
    out = out.withColumn("p_value", normal_two_sided(z))
    return out.select(*group, "variable", "coefficient", "std_error", "p_value",
                      F.when(F.col("p_value").isNull(), "").otherwise(significance_stars(F.col("p_value"))).alias("stars"),
                      "nobs", "r2_within", "adj_r2_within")
