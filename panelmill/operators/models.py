"""Tree-ensemble forecasts.

Regime A uses every feature, regime B drops the policy columns (P2). One model per commodity, regime and learner
(and fold), all fitted by one Spark job over one binned design (``operators.ensembles``). A commodity with more training rows than one
group holds is fitted by MLlib's distributed trees instead. Predictions
come back long: (keys, date, regime, model, y, y_hat).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators import ensembles as E
from panelmill.operators.selection import feature_columns, temporal_split
from panelmill.session import materialize

GROUP = "commodity"


def mllib(learner, target: str):
    """The distributed learner with the same settings. All features are tried at every split (the reference's setting);
    min_samples_split 10 ~ 5 rows per leaf."""
    if isinstance(learner, E.Forest):
        return RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=learner.trees, maxDepth=learner.max_depth,
                                     featureSubsetStrategy="all", minInstancesPerNode=max(learner.min_split // 2, 1),
                                     seed=learner.seed, maxMemoryInMB=512)
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=learner.rounds, maxDepth=learner.max_depth,
                        stepSize=learner.rate, subsamplingRate=learner.subsample, seed=learner.seed)


def fit_large(df: DataFrame, made: E.Design, learners: dict, regimes: dict[str, Sequence[str]], target: str):
    """(predictions, importances) of the models above a group's size, one MLlib fit each; empty lists without one."""
    preds, imps = [], []
    for name in E.large_models(made).collect():  # each has tens of thousands of rows at least
        own = df.where(" AND ".join("true" if name[k] is None else f"`{k}` <=> cast('{name[k]}' AS {df.schema[k].dataType.simpleString()})"
                                    for k in made.keys))
        train = own.where("split = 'train'")
        means = train.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in made.features]).first()
        for regime, feats in regimes.items():
            vectors = (VectorAssembler(inputCols=list(feats), outputCol="features")
                       .transform(own.fillna({f: means[f] for f in feats}))
                       .select(*made.keys, *made.ids, "split", target, "features").checkpoint(eager=True))
            for model, learner in learners.items():
                fitted = mllib(learner, target).fit(vectors.where("split = 'train'"))
                preds.append(fitted.transform(vectors.where("split = 'test'")).select(
                    *made.keys, *made.ids, F.lit(regime).alias("regime"), F.lit(model).alias("model"),
                    F.col(target).cast("double").alias("y"), F.col("prediction").alias("y_hat")))
                imps += [(*[name[k] for k in made.keys], regime, model, f, float(w))
                         for f, w in zip(feats, fitted.featureImportances.toArray())]
    return preds, imps


def fit_models(df: DataFrame, made: E.Design, learners: dict, regimes: dict[str, Sequence[str]], target: str):
    """(predictions, importances) of every learner and regime for every model of ``df`` (column ``split``) and its design."""
    preds, imps, _ = E.fit(made, learners, regimes)
    more, shares = fit_large(df, made, learners, regimes, target)
    for p in more:
        preds = preds.unionByName(p)
    if shares:
        imps = imps.union(df.sparkSession.createDataFrame(shares, imps.schema))
    return preds, imps


def standardize(df: DataFrame, cols: Sequence[str], fit_filter=None, reuse: bool = True
                ) -> DataFrame:
    """M4: (x - mean) / sd with population SD from the fit rows; sd 0 -> 1."""
    if reuse:
        df = materialize(df)  # read by the statistics and by the rows
    fit = df.where(fit_filter) if fit_filter is not None else df
    out = df
    for c in cols:  # scalar subqueries; Spark merges them into one aggregate over ``fit``
        mu, sd = fit.select(F.avg(c)).scalar(), fit.select(F.stddev_pop(c)).scalar()
        sd = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        out = out.withColumn(f"{c}_z", (F.col(c) - mu) / sd)
    return out


def unstandardize(df: DataFrame, col: str, z: str, out: str, fit_rows: DataFrame) -> DataFrame:
    """Inverse of M4: z * sd + mean with the statistics of ``col`` over ``fit_rows``; sd 0 counts as 1."""
    mu, sd = fit_rows.select(F.avg(col)).scalar(), fit_rows.select(F.stddev_pop(col)).scalar()
    return df.withColumn(out, F.col(z) * F.when(sd == 0, F.lit(1.0)).otherwise(sd) + mu)


def regime_features(panel: DataFrame, regimes: Sequence[str], target: str) -> dict[str, list[str]]:
    return {r: feature_columns(panel, policy_neutral=(r == "B"), target=target) for r in regimes}


def regime_design(panel: DataFrame, train_end: str, test_start: str | None, keys: Sequence[str] = ("commodity", "market"),
                  target: str = "price_target") -> tuple[DataFrame, E.Design]:
    """The split panel and its binned design, one model per commodity."""
    df = temporal_split(panel, train_end, test_start)
    by = [k for k in keys if k == GROUP]
    return df, E.design(df, feature_columns(panel, target=target), by, [*[k for k in keys if k not in by], "date"], target)


def fit_regimes(panel: DataFrame, train_end: str, test_start: str | None, learners: dict,
                regimes: Sequence[str] = ("A", "B"), keys: Sequence[str] = ("commodity", "market"),
                target: str = "price_target"):
    """M9: every learner on every regime for every commodity; returns (predictions, importances per commodity)."""
    df, made = regime_design(panel, train_end, test_start, keys, target)
    return fit_models(df, made, learners, regime_features(panel, regimes, target), target)


def top_features(importances: DataFrame, n: int = 3) -> DataFrame:
    """M3 + O3: the ``n`` most important features per (commodity, regime, model) and the top share."""
    by = [c for c in importances.columns if c not in ("feature", "importance")]
    w = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return (importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def in_folds(panel: DataFrame, folds: Sequence[tuple]) -> DataFrame:
    """The rows of every fold (number, train end, test start, test end) with their ``split``."""
    day = lambda d: F.lit(d).cast("date")
    every = F.array(*[F.struct(F.lit(n).alias("fold"), day(a).alias("train_end"), day(b).alias("test_start"),
                               day(c).alias("test_end")) for n, a, b, c in folds])
    rows = panel.withColumn("_f", F.explode(every)).withColumn("fold", F.col("_f.fold"))
    date = F.col("date")
    split = (F.when(date <= F.col("_f.train_end"), "train")
             .when(date.between(F.col("_f.test_start"), F.col("_f.test_end")), "test"))
    return rows.withColumn("split", split).where("split IS NOT NULL").drop("_f")


def rolling_cv(panel: DataFrame, folds: Sequence[tuple], learners: dict,
               keys: Sequence[str] = ("commodity", "market"), target: str = "price_target",
               naive: str | None = "price_lag7") -> DataFrame:
    """M8: expanding-window folds; every learner refit per fold and commodity, all of them in one job; fold MAPE rows.

    The seasonal naive (column ``naive``) is scored on the same test rows.
    """
    rows = in_folds(panel, folds)
    by = ["fold", *[k for k in keys if k == GROUP]]
    feats = feature_columns(panel, target=target)
    made = E.design(rows, feats, by, [*[k for k in keys if k not in by], "date"], target)
    preds, _ = fit_models(rows, made, learners, {"A": feats}, target)
    preds = preds.select(*by, "model", "y", "y_hat")
    if naive:
        preds = preds.unionByName(rows.where("split = 'test'").select(
            *by, F.lit("naive").alias("model"), F.col(target).alias("y"), F.col(naive).alias("y_hat")))
    e = F.abs((F.col("y") - F.col("y_hat")) / F.col("y"))
    return preds.groupBy(*by, "model").agg((F.avg(F.when(F.col("y") != 0, e)) * 100).alias("mape"))


def save_models(made: E.Design, trees: DataFrame, path: str) -> None:
    """Trees, edges and feature names as tables, written with overwrite."""
    trees.write.mode("overwrite").parquet(f"{path}/trees")
    made.stats.write.mode("overwrite").parquet(f"{path}/design")
    names = [(i, f) for i, f in enumerate(made.features)]
    made.stats.sparkSession.createDataFrame(names, "place int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def apply_saved(path: str, df: DataFrame, keys: Sequence[str], ids: Sequence[str], target: str = "price_target") -> DataFrame:
    """Predictions of written models for the rows of ``df``."""
    spark = df.sparkSession
    features = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    made = E.apply_design(df, spark.read.parquet(f"{path}/design"), features, keys, ids, target)
    return E.predict(spark.read.parquet(f"{path}/trees"), made)
