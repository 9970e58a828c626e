"""Queries for the tree forecasts and for all models side by side.

``long_predictions`` is the one table every comparison runs on: (commodity, market, date, regime, model, y, y_hat) of
the seasonal naive, both seasonal ARIMAs and the smoothing model (fitted on the daily commodity mean and
joined by date, the same in both regimes), and the forest and the boosted trees of regimes A and B.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill import bindings as B
from panelmill.functions.special import normal_two_sided
from panelmill.operators import ensembles as E
from panelmill.operators import metrics as M
from panelmill.operators import models as ML
from panelmill.operators import series as S
from panelmill.operators.impute import impute_prices
from panelmill.operators.selection import feature_columns, temporal_split
from panelmill.params import FOLDS, HORIZONS, TEST_START, TRAIN_END
from panelmill.plans.common import r, rounded
import panelmill.plans.q_joins  # noqa: F401
from panelmill.plans.q_joins import feature_panel
from panelmill.plans.registry import query
from panelmill.session import ensure_checkpoint_dir, materialize, remembered, scratch_path
from panelmill.sources.files import listing

SERIES_KINDS = ("sarima", "sarima_aic", "ets")
KEYS = ["commodity", "market"]

def once(spark, sf_dir, name, make):
    """A fitted table that several queries read: made once for the same files, as long as its scratch tables stand."""
    return remembered(spark, (sf_dir, name, repr(learners(spark)), listing(spark, sf_dir)), make)


def learners(spark):
    """The calibrated boosting and forest; the forest of the registered queries has 50 of its 200 trees (README), unless
    ``spark.panelmill.forest.trees`` says otherwise."""
    trees = int(spark.conf.get("spark.panelmill.forest.trees", "50"))
    return {"rf": E.Forest(trees=trees), "gb": E.Boosted()}


def cube(spark, sf_dir):
    """The (commodity, nation, day) sums: the facts are joined once for the panel, the series and the policy."""
    return once(spark, sf_dir, "cube", lambda: materialize(B.commodity_cube(spark, sf_dir)))


def panel(spark, sf_dir):
    return once(spark, sf_dir, "panel", lambda: materialize(feature_panel(spark, sf_dir, cube(spark, sf_dir))))


def design(spark, sf_dir):
    return once(spark, sf_dir, "design", lambda: ML.regime_design(panel(spark, sf_dir), TRAIN_END, TEST_START))


def regime_piece(spark, sf_dir, regime, model):
    """(predictions, importances) of one learner and regime, all commodities, as written tables: a run that was
    stopped goes on after the pieces it has."""
    def make():
        df, made = design(spark, sf_dir)
        feats = ML.regime_features(panel(spark, sf_dir), [regime], "price_target")
        preds, imps = ML.fit_models(df, made, {model: learners(spark)[model]}, feats, "price_target")
        return materialize(preds), materialize(imps)
    return once(spark, sf_dir, f"trees-{regime}-{model}", make)


def regime_predictions(spark, sf_dir):
    """(predictions, importances) of both trees and regimes."""
    ensure_checkpoint_dir(spark)
    pieces = [regime_piece(spark, sf_dir, g, m) for g in ("A", "B") for m in learners(spark)]
    out = pieces[0]
    for p in pieces[1:]:
        out = tuple(a.unionByName(b) for a, b in zip(out, p))
    return out


def naive_predictions(spark, sf_dir):
    test = panel(spark, sf_dir).where(F.col("date") >= F.lit(TEST_START).cast("date"))
    return test.select(*KEYS, "date", F.lit("naive").alias("model"), F.col("price_target").alias("y"),
                       F.col("price_lag7").alias("y_hat"))


def series_predictions(spark, sf_dir):
    """The statistical models on the daily commodity mean, for every market of the commodity."""
    fp = panel(spark, sf_dir)
    daily = impute_prices(B.commodity_panel(spark, sf_dir, cube(spark, sf_dir)), keys=KEYS).groupBy("commodity", "date").agg(
        F.avg("price_modal").alias("price_modal"))
    train = S.training_windows(daily, ["commodity"], "price_modal", TRAIN_END, 730)
    fc = S.forecast_series(train, ["commodity"], SERIES_KINDS).select("commodity", "date", "model", "y_hat")
    rows = fp.where(F.col("date") >= F.lit(TEST_START).cast("date")).select(
        *KEYS, "date", F.col("price_target").alias("y"))
    return rows.join(fc, ["commodity", "date"]).select(*KEYS, "date", "model", "y", "y_hat")


def series_and_naive(spark, sf_dir):
    both = naive_predictions(spark, sf_dir).unionByName(series_predictions(spark, sf_dir))
    return both.withColumn("regime", F.explode(F.array(F.lit("A"), F.lit("B"))))


def long_predictions(spark, sf_dir):
    def make():
        return materialize(series_and_naive(spark, sf_dir).unionByName(regime_predictions(spark, sf_dir)[0]))
    return once(spark, sf_dir, "long", make)


NAIVE_SQL = f"""SELECT commodity, market, date, regime, price_target AS y, price_lag7 AS y_hat
  FROM fpanel, (VALUES ('A'), ('B')) v(regime) WHERE date >= DATE '{TEST_START}'"""


@query("j7_naive_regimes", B.sql_with("fpanel") + f"""
  SELECT commodity, market, date, regime, {r('y', 'y')}, {r('y_hat', 'y_hat')} FROM ({NAIVE_SQL})""")
def j7_naive_regimes(spark, sf_dir):
    """The naive rows of the long table: keys, target and values are exact."""
    rows = naive_predictions(spark, sf_dir).withColumn("regime", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return rounded(rows.select(*KEYS, "date", "regime", "y", "y_hat"))


@query("j7_series_keys", B.sql_with("fpanel") + f"""
  SELECT commodity, market, date, model, {r('price_target', 'y')} FROM fpanel,
    (VALUES ('sarima_fix'), ('sarima_aic'), ('ets')) v(model) WHERE date >= DATE '{TEST_START}'""")
def j7_series_keys(spark, sf_dir):
    """Every test row has one forecast of every statistical model."""
    return rounded(series_predictions(spark, sf_dir).select(*KEYS, "date", "model", "y"))


@query("m1_m2_m9_regime_predictions")
def m1_m2_m9_regime_predictions(spark, sf_dir):
    """Forest and boosted trees, regimes A (all features) and B (policy-neutral), test rows, long."""
    return regime_predictions(spark, sf_dir)[0]


@query("m1_m2_m9_keys", B.sql_with("fpanel") + f"""
  SELECT commodity, market, date, regime, model, {r('price_target', 'y')}, true AS inside FROM fpanel,
    (VALUES ('A'), ('B')) v(regime), (VALUES ('rf'), ('gb')) w(model) WHERE date >= DATE '{TEST_START}'""")
def m1_m2_m9_keys(spark, sf_dir):
    """Keys and targets of the tree forecasts; every forecast lies near the range of the training targets.

    A forest's mean cannot leave the range; boosting may overshoot it, here by at most a tenth of its width.
    """
    preds, _ = regime_predictions(spark, sf_dir)
    train = panel(spark, sf_dir).where(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    lo, hi = train.select(F.min("price_target")).scalar(), train.select(F.max("price_target")).scalar()
    room = F.when(F.col("model") == "rf", F.lit(1e-9)).otherwise(F.lit(0.1)) * (hi - lo)
    inside = (F.col("y_hat") >= lo - room) & (F.col("y_hat") <= hi + room)
    return rounded(preds.select(*KEYS, "date", "regime", "model", "y", inside.alias("inside")))


@query("m3_importance_sum", B.sql_with("fpanel") + """
  SELECT commodity, regime, model, 1.0e0 AS total, CASE regime WHEN 'A' THEN 39 ELSE 33 END AS n_features
  FROM (SELECT DISTINCT commodity FROM fpanel), (VALUES ('A'), ('B')) v(regime), (VALUES ('rf'), ('gb')) w(model)""")
def m3_importance_sum(spark, sf_dir):
    """Importances of every commodity, regime and learner: shares of all its features."""
    _, imp = regime_predictions(spark, sf_dir)
    return imp.groupBy("commodity", "regime", "model").agg(
        F.round(F.sum("importance"), 6).alias("total"), F.countDistinct("feature").cast("int").alias("n_features"))


MODELS = ["naive", "sarima_aic", "sarima_fix", "ets", "rf", "gb"]


@query("j7_predictions_models", B.sql_with("fpanel") + f"""
  SELECT commodity, market, date, regime, {r('price_target', 'actual')}, {r('price_lag7', 'naive')}, 5 AS n_others
  FROM fpanel, (VALUES ('A'), ('B')) v(regime) WHERE date >= DATE '{TEST_START}'""")
def j7_predictions_models(spark, sf_dir):
    """One row per test day with one column per model; the twin checks actual, naive and that no model is missing."""
    wide = predictions_wide(spark, sf_dir)
    others = sum(F.col(m).isNotNull().cast("int") for m in MODELS[1:])
    return rounded(wide.select(*KEYS, "date", "regime", "actual", "naive", others.alias("n_others")))


@query("m9_predictions_wide")
def predictions_wide(spark, sf_dir):
    """The reference's prediction table: date, actual and one column per model."""
    p = long_predictions(spark, sf_dir)
    return (p.groupBy(*KEYS, "date", "regime").pivot("model", MODELS).agg(F.max("y_hat"))
            .join(p.where("model = 'naive'").select(*KEYS, "date", "regime", F.col("y").alias("actual")),
                  [*KEYS, "date", "regime"]).select(*KEYS, "date", "regime", "actual", *MODELS))


@query("m9_regime_metrics")
def m9_regime_metrics(spark, sf_dir):
    """G5-G8 of every model, regime and commodity."""
    return M.accuracy(long_predictions(spark, sf_dir), ["commodity", "regime", "model"], ["market"])


@query("o2_leaderboard")
def o2_leaderboard(spark, sf_dir):
    """Models ranked by MAPE within commodity and regime."""
    w = Window.partitionBy("commodity", "regime").orderBy(F.asc_nulls_last("mape"), "model")
    return m9_regime_metrics(spark, sf_dir).withColumn("rank", F.row_number().over(w))


@query("g9_model_horizons")
def g9_model_horizons(spark, sf_dir):
    return M.multihorizon(long_predictions(spark, sf_dir), HORIZONS, ["commodity", "regime", "model"], ["market"])


@query("j8_regime_pairs")
def j8_regime_pairs(spark, sf_dir):
    """Regime A beside regime B per commodity and model, with the change in MAPE."""
    m = m9_regime_metrics(spark, sf_dir)
    wide = m.groupBy("commodity", "model").pivot("regime", ["A", "B"]).agg(F.max("mape"))
    return wide.select("commodity", "model", F.col("A").alias("mape_a"), F.col("B").alias("mape_b"),
                       (F.col("B") - F.col("A")).alias("mape_change"))


@query("g12_models_vs_naive")
def g12_models_vs_naive(spark, sf_dir):
    """Diebold-Mariano of every model against the naive, per commodity and regime, both losses.

    The loss differential of a day is its mean over the commodity's markets.
    """
    keys = ["commodity", "regime", "model", "loss"]
    p = long_predictions(spark, sf_dir)
    naive = p.where("model = 'naive'").select(*KEYS, "date", "regime", F.col("y_hat").alias("naive"))
    rows = p.where("model <> 'naive' AND y_hat IS NOT NULL").join(naive, [*KEYS, "date", "regime"])
    losses = F.explode(F.array(*[F.struct(F.lit(x).alias("loss"), M.loss_differential(
        F.col("naive"), F.col("y_hat"), F.col("y"), x).alias("d")) for x in ("squared", "absolute")]))
    daily = (rows.select("commodity", "regime", "model", "date", losses.alias("l"))
             .groupBy("commodity", "regime", "model", F.col("l.loss").alias("loss"), "date")
             .agg(F.avg("l.d").alias("d")))
    t = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    dm = M.diebold_mariano(daily.select(*keys, t.alias("t"), "d"), keys)
    return dm.withColumn("p_value", normal_two_sided(F.col("dm_stat")))


@query("g17_model_prices")
def g17_model_prices(spark, sf_dir):
    """G17 by regime and model: mean forecast and RMSE per commodity; the policy uses the forest of regime B."""
    e = F.col("y") - F.col("y_hat")
    return (long_predictions(spark, sf_dir).groupBy("commodity", "regime", "model")
            .agg(F.avg("y_hat").alias("forecast_price"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.avg("y").alias("actual_price")))


@query("m3_o3_top_features")
def m3_o3_top_features(spark, sf_dir):
    _, imp = regime_predictions(spark, sf_dir)
    return ML.top_features(imp, 3)


M4_COLS = ["price_lag1", "price_ma7", "price_target"]


@query("m4_standardize", B.sql_with("fpanel") + """
  , st AS (SELECT """ + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in M4_COLS)
       + f" FROM fpanel WHERE date <= DATE '{TRAIN_END}')"
       + "\n  SELECT commodity, market, date, " + ", ".join(
    r(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END", f"{c}_z")
    for c in M4_COLS) + " FROM fpanel, st")
def m4_standardize(spark, sf_dir):
    fp = panel(spark, sf_dir)
    z = ML.standardize(fp, M4_COLS, F.col("date") <= F.lit(TRAIN_END).cast("date"), reuse=False)
    return rounded(z.select("commodity", "market", "date", *[f"{c}_z" for c in M4_COLS]))


@query("m4_inverse", B.sql_with("fpanel") + f"""
  SELECT commodity, market, date, {r('price_target', 'price_target')}, {r('price_target', 'restored')} FROM fpanel""")
def m4_inverse(spark, sf_dir):
    """The standardised target, transformed back."""
    fp = panel(spark, sf_dir)
    train = F.col("date") <= F.lit(TRAIN_END).cast("date")
    z = ML.standardize(fp, ["price_target"], train, reuse=False)
    out = ML.unstandardize(z, "price_target", "price_target_z", "restored", fp.where(train))
    return rounded(out.select("commodity", "market", "date", "price_target", "restored"))


@query("m8_rolling_cv_models")
def m8_rolling_cv_models(spark, sf_dir):
    """Expanding-window CV of forest, boosting and naive per commodity: mean and population SD of fold MAPE."""
    ensure_checkpoint_dir(spark)
    fp, fm = panel(spark, sf_dir), None
    for i, (name, learner) in enumerate(learners(spark).items()):  # the naive is scored once
        piece = once(spark, sf_dir, f"cv-{name}", lambda: materialize(ML.rolling_cv(
            fp, FOLDS, {name: learner}, naive=None if i else "price_lag7")))
        fm = piece if fm is None else fm.unionByName(piece)
    return M.cv_summary(fm, ["commodity", "model"])


@query("s10_model_persistence", B.sql_with("fpanel") + f"""
  SELECT commodity, market, date, {r('price_target', 'y')}, true AS same FROM fpanel WHERE date >= DATE '{TEST_START}'""")
def s10_model_persistence(spark, sf_dir):
    """Fit the policy-neutral forests, write them, load them and score the test rows: as the fitted ones do."""
    fp = panel(spark, sf_dir)
    feats = feature_columns(fp, policy_neutral=True)
    df = temporal_split(fp, TRAIN_END, TEST_START)
    made = E.design(df, feats, ["commodity"], ["market", "date"], "price_target")
    preds, _, trees = E.fit(made, {"rf": E.Forest(trees=20)}, {"B": feats}, keep=True)
    path = scratch_path(spark, "model")
    ML.save_models(made, trees, path)
    again = ML.apply_saved(path, df.where("split = 'test'"), ["commodity"], ["market", "date"])
    both = again.join(preds.select("commodity", "market", "date", F.col("y_hat").alias("fitted")), ["commodity", "market", "date"])
    return rounded(both.select(*KEYS, "date", "y", (F.abs(F.col("y_hat") - F.col("fitted")) < 1e-6).alias("same")))


SPLIT_FEATURES = ["month", "day_of_week", "year", "extreme_heat_days", "drought_indicator"]


def _tree_sql() -> str:
    """A tree of depth 2 by hand: the best split of every node by the decrease of the squared error over whole numbers."""
    level = """
      t{n} AS (SELECT commodity, node, count(*) AS n, sum(q) AS s FROM r{n} GROUP BY 1, 2),
      c{n} AS (SELECT commodity, node, f, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl FROM (
                 SELECT commodity, node, f, v[f] AS x, count(*) AS n, sum(q) AS s FROM r{n}, range(1, {k}) g(f) GROUP BY 1, 2, 3, 4)
               WINDOW w AS (PARTITION BY commodity, node, f ORDER BY x)),
      g{n} AS (SELECT commodity, node, f, x, n, s, CASE WHEN nl < n THEN
                 pow(sl - nl * (CAST(s AS DOUBLE) / n), 2) / (nl * (n - nl)) * n ELSE 0 END AS gain
               FROM c{n} JOIN t{n} USING (commodity, node)),
      b{n} AS (SELECT * FROM g{n} QUALIFY row_number() OVER (PARTITION BY commodity, node ORDER BY gain DESC, f, x) = 1),"""
    k, names = len(SPLIT_FEATURES) + 1, ", ".join(f"CAST({f} AS DOUBLE)" for f in SPLIT_FEATURES)
    return B.sql_with("fpanel") + f""",
      r1 AS (SELECT commodity, 'root' AS node, [{names}] AS v, CAST(floor(price_target + 0.5) AS BIGINT) AS q
             FROM fpanel WHERE date <= DATE '{TRAIN_END}'), {level.format(n=1, k=k)}
      r2 AS (SELECT r1.commodity, CASE WHEN v[f] <= x THEN 'left' ELSE 'right' END AS node, v, q FROM r1 JOIN b1 USING (commodity)),
      {level.format(n=2, k=k)}
      every AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
      SELECT commodity, node, [{", ".join(f"'{f}'" for f in SPLIT_FEATURES)}][f] AS feature, CAST(x AS DOUBLE) AS threshold,
        {r('CAST(s AS DOUBLE) / n', 'mean')} FROM every"""


@query("m1_tree_splits", _tree_sql())
def m1_tree_splits(spark, sf_dir):
    """The splits of a regression tree of depth 2 per commodity, grown on all training rows (target in whole units)."""
    fp = panel(spark, sf_dir)
    df = fp.withColumn("whole", F.floor(F.col("price_target") + 0.5)).withColumn(
        "split", F.when(F.col("date") <= F.lit(TRAIN_END).cast("date"), "train"))
    made = E.design(df, SPLIT_FEATURES, ["commodity"], ["market", "date"], "whole")
    one = E.Forest(trees=1, max_depth=2, min_split=2, sampled=False)
    _, _, trees = E.fit(made, {"tree": one}, {"A": SPLIT_FEATURES}, keep=True)
    first = F.col("left")[0]
    spots = F.explode(F.array(*[F.struct(F.lit(name).alias("node"), at.alias("at")) for name, at in
                                (("root", F.lit(0)), ("left", first), ("right", first + 1))])).alias("spot")
    nodes = trees.join(made.stats.select("commodity", "edges"), "commodity").select(
        "commodity", "feature", "bin", "value", "edges", spots)
    at = F.col("spot.at")
    f = F.get("feature", at)
    name = F.get(F.array(*map(F.lit, SPLIT_FEATURES)), f)
    return rounded(nodes.select("commodity", F.col("spot.node").alias("node"), name.alias("feature"),
                                F.get(F.get("edges", f), F.get("bin", at)).alias("threshold"), F.get("value", at).alias("mean")))
