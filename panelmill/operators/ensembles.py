"""Forests and boosted trees, many models side by side.

A model is a group of rows (``keys``: a commodity, a fold and a commodity, ...). All models, learners and regimes are fitted by one Spark
job: the rows are binned once per model (``design``: train means for nulls, quantile edges, one byte per feature), and every
(model, regime, learner, part of the forest) is a task of its own with its own partition, the longest first. Test rows ride along and
come back as sums of the parts' predictions, so no forest is moved; ``keep`` gives the trees as a table, which ``predict`` applies to
blocks of new rows.

A group is at most ``GROUP_ROWS`` training rows, so a task holds a bounded design (39 features: 2.4 MB). ``large_models`` names the models
above that; ``models.fit_regimes`` gives them to MLlib's distributed trees.
Sampling is by hashes of the rows' ids, so a repeated task grows the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators import trees as T
from panelmill.params import GB_PARAMS, RF_PARAMS
from panelmill.session import ensure_checkpoint_dir, materialize

GROUP_ROWS = 62_000  # a bootstrap sample of them stays below trees.LIMIT by ten standard deviations
BLOCK_ROWS = 50_000  # rows that are binned or predicted in one task
MOST_TASKS = 50_000


class Forest(NamedTuple):
    trees: int = RF_PARAMS["num_trees"]
    max_depth: int = RF_PARAMS["max_depth"]
    min_split: int = RF_PARAMS["min_samples_split"]
    seed: int = RF_PARAMS["seed"]
    chunk: int = 25  # trees of one task
    sampled: bool = True  # a bootstrap sample for each tree

    def parts(self) -> list[tuple[int, int]]:
        return [(lo, min(lo + self.chunk, self.trees)) for lo in range(0, self.trees, self.chunk)]

    def grow(self, columns, y, rows, part):
        return T.forest_trees(columns, y, rows, range(*part), self.max_depth, self.min_split, self.seed, self.sampled)

    @property
    def weight(self) -> float:  # of a tree in the prediction
        return 1.0 / self.trees


class Boosted(NamedTuple):
    rounds: int = GB_PARAMS["max_iter"]
    max_depth: int = GB_PARAMS["max_depth"]
    rate: float = GB_PARAMS["step_size"]
    subsample: float = GB_PARAMS["subsample"]
    seed: int = GB_PARAMS["seed"]

    def parts(self) -> list[tuple[int, int]]:
        return [(0, self.rounds)]

    def grow(self, columns, y, rows, part):
        return T.boosted_trees(columns, y, rows, self.rounds, self.max_depth, self.rate, self.subsample, self.seed)

    @property
    def weight(self) -> float:
        return 1.0


class Design(NamedTuple):
    rows: DataFrame  # keys, ids, row (hash of the ids), train, y, bins (one byte per feature)
    stats: DataFrame  # keys, n (training rows), means, edges, blocks
    keys: list[str]
    ids: list[str]
    features: list[str]


def design(df: DataFrame, features: Sequence[str], keys: Sequence[str], ids: Sequence[str], target: str) -> Design:
    """Bins of the train and test rows of ``df`` (column ``split``), per model; nulls take the train means."""
    ensure_checkpoint_dir(df.sparkSession)
    features, keys, ids = list(features), list(keys), list(ids)
    plain = materialize(df.where(F.col("split").isin("train", "test")).select(
        *keys, *ids, (F.col("split") == "train").alias("train"), F.col(target).cast("double").alias("y"),
        *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]))
    columns = [f"f{i}" for i in range(len(features))]
    cuts = F.array(*[F.lit(k / T.BINS) for k in range(1, T.BINS)])
    own = lambda c: F.when(F.col("train"), F.col(c))
    # percentile_approx keeps a bounded summary per group and column, whatever the group's size
    stats = plain.groupBy(*keys).agg(
        F.count(F.when(F.col("train"), 1)).alias("n"), F.avg(own("y")).alias("y_mean"),
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"),
        F.array(*[F.coalesce(F.avg(own(c)), F.lit(0.0)) for c in columns]).alias("means"),
        F.array(*[F.coalesce(F.array_distinct(F.percentile_approx(own(c), cuts, 2000)), F.array().cast("array<double>"))
                  for c in columns]).alias("edges"))
    return with_bins(plain, materialize(stats.where("n > 0")), keys, ids, features)


def apply_design(df: DataFrame, stats: DataFrame, features: Sequence[str], keys: Sequence[str], ids: Sequence[str],
                 target: str) -> Design:
    """New rows binned by the means and edges of a fitted design."""
    keys = list(keys)
    plain = df.select(*keys, *ids, F.lit(False).alias("train"), F.col(target).cast("double").alias("y"),
                      *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    sizes = plain.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    return with_bins(plain, materialize(stats.drop("blocks").join(sizes, keys)), keys, list(ids), list(features))


def with_bins(plain: DataFrame, stats: DataFrame, keys: list[str], ids: list[str], features: list[str]) -> Design:
    columns = [f"f{i}" for i in range(len(features))]
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, *ids]], "row long, train boolean, y double, bins binary"])
    dealt = blocks_of(plain.withColumn("row", F.xxhash64(*ids)), stats.select(*keys, "blocks"), keys)

    def run(name, left, right):
        return bin_block(left, right, [*keys, *ids], columns)

    rows = (dealt.groupBy(*keys, "block")
            .cogroup(every_block(stats, "blocks").select(*keys, "block", "y_mean", "means", "edges").groupBy(*keys, "block"))
            .applyInPandas(run, schema))
    return Design(materialize(rows), stats, keys, ids, features)


def blocks_of(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(blocks, keys).withColumn("block", F.pmod("row", F.col("blocks")).cast("int")).drop("blocks")


def every_block(df: DataFrame, blocks: str) -> DataFrame:
    return df.withColumn("block", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))


def bin_block(rows: pd.DataFrame, stats: pd.DataFrame, names: list[str], columns: list[str]) -> pd.DataFrame:
    out = rows[names].copy()
    out["row"], out["train"] = rows["row"], rows["train"]
    if not len(rows):
        return out.assign(y=0.0, bins=b"")
    own = stats.iloc[0]
    out["y"] = rows["y"].fillna(own["y_mean"])
    bins = np.empty((len(rows), len(columns)), np.uint8)
    for i, c in enumerate(columns):
        x = rows[c].to_numpy(np.float64, na_value=np.nan)
        bins[:, i] = T.binned(np.where(np.isnan(x), own["means"][i], x), np.asarray(own["edges"][i], float))
    out["bins"] = [bytes(b) for b in bins]
    return out


def large_models(made: Design) -> DataFrame:
    """Keys of the models with more training rows than a group may have."""
    return made.stats.where(F.col("n") > GROUP_ROWS).select(*made.keys)


def matrix(bins: pd.Series, features: int) -> np.ndarray:
    """uint8 by feature and row."""
    return np.ascontiguousarray(np.frombuffer(b"".join(bins), np.uint8).reshape(-1, features).T)


TREE = "feature array<int>, bin array<int>, `left` array<int>, value array<double>, gain array<double>"


class Task(NamedTuple):
    regime: str
    model: str
    part: tuple[int, int]


def fit(made: Design, learners: dict, regimes: dict[str, Sequence[str]], keep: bool = False
        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions of the test rows, importances, trees) of all models with a group's size; ``regimes``: name -> features.

    Predictions: keys, ids, regime, model, y, y_hat. Importances sum to one per (keys, regime, model).
    Trees (if ``keep``): keys, regime, model, tree, weight and the arrays of its nodes, over the design's features.
    """
    keys, ids, features = made.keys, made.ids, made.features
    # boosting is sequential and takes longest, so it starts first
    tasks = sorted((Task(r, m, p) for r in regimes for m, x in learners.items() for p in x.parts()),
                   key=lambda t: len(learners[t.model].parts()))
    # one row per model is numbered
    models = materialize(made.stats.where(F.col("n") <= GROUP_ROWS).select(
        *keys, (F.row_number().over(Window.orderBy(*keys)) - 1).alias("_model")))
    n = models.count()
    slots = min(max(n * len(tasks), 1), MOST_TASKS)
    rows = (made.rows.join(models, keys)
            .withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1))))
            .withColumn("slot", F.pmod(F.col("task") * n + F.col("_model"), F.lit(slots)).cast("int"))
            .withColumns({c: F.when(~F.col("train"), F.col(c)) for c in ids})
            .drop("_model").repartitionById(slots, F.col("slot")).sortWithinPartitions("task", *keys, "row"))
    kinds = {f.name: f.dataType.simpleString() for f in made.rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, *ids]], "regime string, model string, kind string, y double, "
                        "y_hat double, name string, amount double, tree int, weight double", TREE])
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    chosen = {r: np.array([features.index(f) for f in own], np.int64) for r, own in regimes.items()}

    def grow(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        task = tasks[group["task"].iloc[0]]
        learner, own = learners[task.model], chosen[task.regime]
        train, test = group[group["train"]], group[~group["train"]]
        columns, unseen = matrix(train["bins"], len(features))[own], matrix(test["bins"], len(features))[own]
        sums, shares, kept = np.zeros(len(test)), np.zeros(len(own)), []
        for t, tree in learner.grow(columns, train["y"].to_numpy(), train["row"].to_numpy(), task.part):
            sums += learner.weight * tree["value"][T.leaves(tree, unseen)]
            gain = T.importance(tree, len(own))
            shares += gain / gain.sum() if learner.weight < 1 and gain.sum() > 0 else gain
            if keep:
                inner = tree["feature"] >= 0
                feature = np.where(inner, own[tree["feature"]], -1)
                kept.append((t, learner.weight, feature, *[tree[k] for k in ("bin", "left", "value", "gain")]))
        head = {k: group[k].iloc[0] for k in keys} | {"regime": task.regime, "model": task.model}
        yield test[[*ids, "y"]].assign(**head, kind="prediction", y_hat=sums)
        yield pd.DataFrame({"name": [features[f] for f in own], "amount": shares}).assign(**head, kind="importance")
        if keep:
            yield pd.DataFrame(kept, columns=["tree", "weight", "feature", "bin", "left", "value", "gain"]).assign(
                **head, kind="tree")

    def run(batches):
        for group in groups(batches, ["task", *keys]):
            for out in grow(group):
                if len(out):
                    yield out.assign(**{c: None for c in names if c not in out})[names]

    out = materialize(rows.mapInPandas(run, schema))
    preds = (out.where("kind = 'prediction'").groupBy(*keys, *ids, "regime", "model")
             .agg(F.first("y").alias("y"), F.sum("y_hat").alias("y_hat")))
    raw = out.where("kind = 'importance'").groupBy(*keys, "regime", "model", "name").agg(F.sum("amount").alias("amount"))
    whole = F.sum("amount").over(Window.partitionBy(*keys, "regime", "model"))
    imps = raw.select(*keys, "regime", "model", F.col("name").alias("feature"),
                      F.when(whole > 0, F.col("amount") / whole).otherwise(0.0).alias("importance"))
    return preds, imps, out.where("kind = 'tree'").select(
        *keys, "regime", "model", "tree", "weight", "feature", "bin", "left", "value", "gain")


def groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal ``by`` in sorted batches, put together across batches."""
    held: list[pd.DataFrame] = []
    name = None
    for batch in batches:
        for own, rows in batch.groupby(by, sort=False, dropna=False):
            if held and own != name:
                yield pd.concat(held, ignore_index=True)
                held = []
            name = own
            held.append(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def predict(trees: DataFrame, made: Design) -> DataFrame:
    """The rows of ``made`` with the predictions of a table of trees: keys, ids, regime, model, y, y_hat.

    Rows are dealt to blocks, and each block meets its model's trees.
    """
    keys, ids, features = made.keys, made.ids, made.features
    blocks = made.stats.select(*keys, "blocks")
    rows = blocks_of(made.rows, blocks, keys)
    own = every_block(trees.join(blocks, keys), "blocks").drop("blocks")
    kinds = {f.name: f.dataType.simpleString() for f in made.rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, *ids]], "regime string, model string, y double, y_hat double"])

    def run(name, left, right):
        columns, out = matrix(left["bins"], len(features)), []
        for (regime, model), some in right.groupby(["regime", "model"]):
            sums = np.zeros(len(left))
            for _, t in some.sort_values("tree").iterrows():
                tree = {k: np.asarray(t[k]) for k in ("feature", "bin", "left", "value")}
                sums += t["weight"] * tree["value"][T.leaves(tree, columns)]
            out.append(left[[*keys, *ids, "y"]].assign(regime=regime, model=model, y_hat=sums))
        names = [*keys, *ids, "regime", "model", "y", "y_hat"]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return rows.groupBy(*keys, "block").cogroup(own.groupBy(*keys, "block")).applyInPandas(run, schema)

