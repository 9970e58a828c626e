import numpy as np

from panelmill.llm.toxicity import CumulativeLink, keep_clean, learn, score
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

SF = SF_SMALL.replace("sf0.001", "sf0.01")


def test_fit_recovers_ordered_thresholds():
    rnd = np.random.default_rng(1)
    n, d = 6000, 8
    x = rnd.random((n, d)) < 0.3
    w, t = np.array([2.0, 1.5, 1.0, 0, 0, 0, -1.0, -2.0]), np.array([-0.5, 0.8, 2.0])
    latent = x @ w + rnd.logistic(size=n)
    grades = (latent[:, None] > t).sum(axis=1)
    rows, columns = np.nonzero(x)
    model = CumulativeLink(d, 4).fit(rows, columns, grades, 0.0, 800)
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.abs(model.thresholds - t).max() < 0.25 and np.abs(model.weights - w).max() < 0.3
    p = model.exceed(np.array([0.0, 1.0]))
    assert np.all(np.diff(p, axis=1) < 0) and np.all(p[1] > p[0])


def test_gradient_is_that_of_the_likelihood():
    """One small step along Adam's direction never raises the loss by much; the optimum has no slope."""
    rnd = np.random.default_rng(2)
    x = rnd.random((400, 4)) < 0.5
    grades = np.minimum((x.sum(axis=1) + rnd.integers(0, 2, 400)) // 2, 2)
    rows, columns = np.nonzero(x)
    model = CumulativeLink(4, 3).fit(rows, columns, grades, 1e-3, 3000, rate=0.02)

    def loss(m):
        p = np.column_stack([np.ones(400), m.exceed(np.bincount(rows, m.weights[columns], 400)), np.zeros(400)])
        return -np.log(p[np.arange(400), grades] - p[np.arange(400), grades + 1]).mean() + 0.5e-3 * (m.weights ** 2).sum()

    best = loss(model)
    for i in range(4):
        for step in (-0.01, 0.01):
            model.weights[i] += step
            assert loss(model) >= best - 1e-6
            model.weights[i] -= step
    model.first += 0.01
    assert loss(model) >= best - 1e-6


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 3 != 0"), {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in score(docs, learn(docs, train)).collect()}
    assert len(got) == docs.count()
    toxic = [got[i].rejected for i, t in held.items() if t == 1]
    clean = [got[i].rejected for i, t in held.items() if t == 0]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.01
    assert all(0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1 and r.grade in (0, 1, 2) for r in got.values())
    assert np.mean([got[i].severity for i, t in held.items() if t == 1]) > 5 * np.mean([got[i].severity for i, t in held.items() if t == 0])


def test_small_and_one_sided_labels_reject_nothing_without_a_reason(spark):
    """No word tells toxic from clean texts: nothing is selected, so nothing goes, though most labels are toxic."""
    rnd = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(list("abcdefgh"), 12))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 25)) for i in range(40)], "doc_id long, toxic int")
    model = learn(docs, labels)
    assert keep_clean(docs, model).count() == 40 and not any(r.rejected for r in score(docs, model).collect())


def test_few_labels_still_teach_something(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    model = learn(docs, labels)
    got = {r.doc_id: r.rejected for r in score(docs, model).collect()}
    assert model.chosen and sum(got[i] for i, t in toxic.items() if t == 1) >= 0.6 * sum(toxic.values())
    assert sum(got[i] for i, t in toxic.items() if t == 0) <= 0.02 * len(toxic)


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (6, 7), (None, 1), (999, 1), (10, 0), (13, 0)], "doc_id long, toxic int")
    for use in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = learn(docs, use)
        out = score(docs, model).collect()
        assert len(out) == len(edge_rows()) and all(r.severity is not None for r in out)
        assert keep_clean(docs, model).columns == docs.columns
        assert keep_clean(docs, model).count() == sum(not r.rejected for r in out)
    assert score(empty_docs(spark), model).count() == 0 and keep_clean(empty_docs(spark), model).count() == 0
