"""Histogram trees: against brute force, against MLlib, and as Spark jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import ensembles as E
from panelmill.operators import models as ML
from panelmill.operators import trees as T

RNG = np.random.default_rng(3)


def plain_tree(columns, y, depth, min_split=2):
    """Best split by trying every feature and threshold; returns predictions."""
    if depth == 0 or len(y) < min_split or len(set(y)) == 1:
        return np.full(len(y), y.mean())
    best = (0.0, None)
    for f in range(len(columns)):
        for b in np.unique(columns[f])[:-1]:
            left = columns[f] <= b
            off = (y[left] - y.mean()).sum()
            gain = off * off / (left.sum() * (~left).sum()) * len(y)
            if gain > best[0] * (1 + 1e-12):
                best = (gain, (f, b))
    if best[1] is None:
        return np.full(len(y), y.mean())
    f, b = best[1]
    left = columns[f] <= b
    out = np.empty(len(y))
    out[left] = plain_tree(columns[:, left], y[left], depth - 1, min_split)
    out[~left] = plain_tree(columns[:, ~left], y[~left], depth - 1, min_split)
    return out


@pytest.mark.parametrize("n,depth,min_split", [(400, 3, 2), (60, 20, 10), (1, 5, 2), (3000, 4, 2)])
def test_tree_equals_brute_force(n, depth, min_split):
    columns = RNG.integers(0, 20, (5, n)).astype(np.uint8)
    y = (columns[0] * 7 + columns[1] * columns[2] + RNG.integers(0, 50, n)).astype(float)
    target, low, step = T.whole(y)
    assert step == 1.0
    tree = T.grow(columns, target, np.ones(n, np.int64), depth, min_split)
    got = low + tree["value"][T.leaves(tree, columns)]
    assert np.allclose(got, plain_tree(columns, y, depth, min_split))
    assert (tree["gain"] >= 0).all() and (tree["feature"] < 5).all()


def test_weights_are_repetitions_and_rows_without_weight_do_not_count():
    columns = RNG.integers(0, 9, (3, 300)).astype(np.uint8)
    y = RNG.integers(0, 1000, 300).astype(float)
    weight = RNG.integers(0, 4, 300)
    twice = np.repeat(np.arange(300), weight)
    a = T.grow(columns, y, weight, 4)
    b = T.grow(columns[:, twice], y[twice], np.ones(len(twice), np.int64), 4)
    assert all((a[k] == b[k]).all() for k in a)


def test_order_of_rows_does_not_matter_and_large_groups_are_refused():
    columns, y = RNG.integers(0, 32, (4, 5000)).astype(np.uint8), RNG.normal(size=5000)
    target, _, _ = T.whole(y)
    turn = RNG.permutation(5000)
    one = np.ones(5000, np.int64)
    a, b = T.grow(columns, target, one, 12), T.grow(columns[:, turn], target[turn], one, 12)
    assert all((a[k] == b[k]).all() for k in a)
    with pytest.raises(ValueError):
        T.grow(columns, target, one * 20, 2)


def test_samples():
    rows = np.arange(20000) * 7919
    n = np.bincount(T.bootstrap(rows, 42, 3))
    assert abs((n * np.arange(len(n))).sum() / 20000 - 1) < 0.03 and abs(n[0] / 20000 - np.exp(-1)) < 0.02
    assert (T.bootstrap(rows, 42, 3) == T.bootstrap(rows, 42, 3)).all() and (T.bootstrap(rows, 42, 4) != T.bootstrap(rows, 42, 3)).any()
    assert abs((T.uniforms(rows, 42, 0) < 0.8).mean() - 0.8) < 0.02


def test_boosting_lowers_the_error_and_constant_targets_are_leaves():
    columns = RNG.integers(0, 32, (4, 2000)).astype(np.uint8)
    y = np.sin(columns[0] / 5.0) * columns[1] + RNG.normal(size=2000)
    rows, now, errors = np.arange(2000), np.zeros(2000), []
    for _, tree in T.boosted_trees(columns, y, rows, 60, 4, 0.1, 0.8, 42):
        now = now + tree["value"][T.leaves(tree, columns)]
        errors.append(np.mean((y - now) ** 2))
    assert errors[-1] < 0.1 * errors[0] and len(errors) == 61
    flat = [t for _, t in T.forest_trees(columns, np.full(2000, 3.5), rows, range(2), 5, 2, 1)]
    assert all(len(t["value"]) == 1 and t["value"][0] == 3.5 for t in flat)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(c, f"m{i % 7}", i, "train" if i % 5 else "test", float(i % 13), float((i * 7) % 29), None if i % 11 == 0 else float(i % 3),
             float((i % 13) * 10 + ((i * 7) % 29) * (1 + (c == "b")) + i % 3)) for c in "ab" for i in range(900)]
    return spark.createDataFrame(rows, "commodity string, market string, day int, split string, x double, z double, w double, y double")


def test_one_tree_equals_mllib(spark, small):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    feats = ["x", "z", "w"]
    made = E.design(small, feats, ["commodity"], ["market", "day"], "y")
    preds, _, _ = E.fit(made, {"rf": E.Forest(trees=1, max_depth=4, min_split=2, sampled=False)}, {"A": feats})
    got = {(r.commodity, r.day): r.y_hat for r in preds.collect()}
    for c in "ab":
        own = small.where(F.col("commodity") == c)
        mean = own.where("split = 'train'").agg(F.avg("w")).first()[0]
        vec = VectorAssembler(inputCols=feats, outputCol="features").transform(own.fillna({"w": mean}))
        model = DecisionTreeRegressor(labelCol="y", maxDepth=4, maxBins=32).fit(vec.where("split = 'train'"))
        want = model.transform(vec.where("split = 'test'")).select("day", "prediction").collect()
        near = [abs(got[c, r.day] - r.prediction) < 1e-6 for r in want]
        assert len(want) == 180 and sum(near) >= 0.97 * len(near)  # equal gains may be cut elsewhere


def test_all_models_in_one_job_and_saved_models(spark, small, tmp_path):
    feats = ["x", "z", "w"]
    learners = {"rf": E.Forest(trees=7, max_depth=6, min_split=4, chunk=3), "gb": E.Boosted(rounds=30, max_depth=3)}
    made = E.design(small, feats, ["commodity"], ["market", "day"], "y")
    preds, imps, trees = E.fit(made, learners, {"A": feats, "B": ["x", "z"]}, keep=True)
    rows = preds.collect()
    assert len(rows) == 360 * 4 and len({(r.commodity, r.day, r.regime, r.model) for r in rows}) == len(rows)
    for m in ("rf", "gb"):
        own = [(r.y, r.y_hat) for r in rows if r.model == m and r.regime == "A"]
        assert np.mean([(a - b) ** 2 for a, b in own]) < 0.05 * np.var([a for a, _ in own])
    sums = imps.groupBy("commodity", "regime", "model").agg(F.sum("importance").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 8 and all(abs(r.s - 1) < 1e-9 and r.n == (3 if r.regime == "A" else 2) for r in sums)
    assert trees.count() == 4 * 7 + 4 * 31
    # other parts of the forest, other partitions: the same forest
    again, _, _ = E.fit(made, {"rf": learners["rf"]._replace(chunk=7)}, {"A": feats})
    want = {(r.commodity, r.day): r.y_hat for r in rows if r.model == "rf" and r.regime == "A"}
    assert all(abs(want[r.commodity, r.day] - r.y_hat) < 1e-9 for r in again.collect())
    ML.save_models(made, trees, str(tmp_path))
    loaded = ML.apply_saved(str(tmp_path), small.where("split = 'test'"), ["commodity"], ["market", "day"], "y")
    first = {(r.commodity, r.day, r.regime, r.model): r.y_hat for r in rows}
    own = loaded.collect()
    assert len(own) == len(first) and all(abs(first[r.commodity, r.day, r.regime, r.model] - r.y_hat) < 1e-9 for r in own)


def test_models_above_a_groups_size_go_to_mllib(spark, small, monkeypatch):
    monkeypatch.setattr(E, "GROUP_ROWS", 700)
    more = small.where("commodity = 'a' OR day < 800")  # 720 and 640 training rows
    made = E.design(more, ["x", "z", "w"], ["commodity"], ["market", "day"], "y")
    preds, imps = ML.fit_models(more, made, {"rf": E.Forest(3, 4)}, {"A": ["x", "z", "w"]}, "y")
    n = {r.commodity: r["count"] for r in preds.groupBy("commodity").count().collect()}
    assert n == {"a": 180, "b": 160} and imps.count() == 6 and preds.where("y_hat IS NULL").count() == 0
    e = preds.agg(F.avg(F.pow(F.col("y") - F.col("y_hat"), 2)) / F.var_pop("y")).first()[0]
    assert e < 0.2


def test_blocks_of_rows_and_models_without_test_or_train_rows(spark, small, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 100)
    extra = small.union(small.where("day < 20").withColumn("commodity", F.lit("only train")).withColumn("split", F.lit("train")))
    extra = extra.union(small.where("day < 20").withColumn("commodity", F.lit("only test")).withColumn("split", F.lit("test")))
    made = E.design(extra, ["x", "z"], ["commodity"], ["market", "day"], "y")
    preds, imps, _ = E.fit(made, {"gb": E.Boosted(5, 2)}, {"A": ["x", "z"]})
    assert {r.commodity for r in preds.select("commodity").distinct().collect()} == {"a", "b"}
    assert {r.commodity for r in imps.select("commodity").distinct().collect()} == {"a", "b", "only train"}
    assert made.rows.where("commodity = 'a'").count() == 900


def test_folds(spark, small):
    panel = small.withColumn("date", F.expr("date_add(date'2000-01-01', day)")).drop("split")
    folds = [(1, "2000-12-31", "2001-01-01", "2001-12-31"), (2, "2001-06-30", "2001-07-01", "2001-12-31")]
    rows = ML.in_folds(panel, folds)
    n = {(r.fold, r.split): r["count"] for r in rows.groupBy("fold", "split").count().collect()}
    assert n == {(1, "train"): 2 * 366, (1, "test"): 2 * 365, (2, "train"): 2 * 547, (2, "test"): 2 * 184}


def test_remembered_results_go_with_their_scratch_tables(spark, small):
    from panelmill.session import materialize, remembered, scratch_scope
    make = lambda: materialize(small)
    with scratch_scope(spark):
        a = remembered(spark, ("t",), make)
        assert remembered(spark, ("t",), make) is a and a.count() == 1800
    assert remembered(spark, ("t",), make).count() == 1800
