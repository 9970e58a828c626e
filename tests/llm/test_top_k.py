import math

import numpy as np

from panelmill.llm.top_k import cover_tree, top_k
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, rank int, score int, v string, dim string, qb int, ids string"


def brute(rows, every=20, k=20, scale=64):
    vectors = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
               if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in vectors if i % every == 0}):  # rows that share an id are one query
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for p, a in vectors if p == q
                        for i, b in vectors if i != q and len(b) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def result(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_clusters_ties_copies_and_broken_rows(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(0, 3, (12, 6))
    rows = [(i, [float(x) for x in np.round(centres[i % 12] + rnd.normal(0, 0.05, 6), 2)]) for i in range(900)]
    rows += [(1000 + i, [0.5, -0.5, 0.25, 0.0, 1.0, 2.0]) for i in range(200)]  # one very common vector
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6),
             (None, [1.0] * 6), (20, rows[20][1]), (40, [9.0] * 6), (3000, [1.0, 2.0]), (3020, [2.0, 1.0]), (3001, [0.0, 0.0]),
             (4000, [1e9, -1e9, 3e8, 0.0, 0.0, 1e9])]
    df = spark.createDataFrame([(i, v, None, None, None, None, None, None) for i, v in rows], SCHEMA)
    want = brute(rows)
    assert result(top_k(df)) == want
    assert result(top_k(df, block=64, run=2)) == want  # many blocks
    assert result(top_k(df, k=3)) == brute(rows, k=3)


def test_rows_that_share_an_id_are_candidates_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(top_k(df))
    assert got == brute(rows) and [g[2:] for g in got if g[0] == 0][:2] == [(1, 12288), (1, 8192)]


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert result(top_k(df)) == brute([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])])
    assert result(top_k(df.limit(0))) == [] and result(top_k(df.where("vec_id = 0"))) == []


def test_cover_tree_covers_and_separates():
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(c, 0.1, (100, 3)) for c in (0, 5, 20)])
    root = cover_tree(x, leaf=8)
    leaves = []

    def walk(node):
        away = np.sqrt(((x[node.points] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            reach = 2.0 ** (np.ceil(np.log2(node.radius)) - 1)
            for i, a in enumerate(node.children):
                for b in node.children[:i]:
                    assert np.sqrt(((a.centre - b.centre) ** 2).sum()) > reach
                walk(a)
        else:
            leaves.append(node)

    walk(root)
    assert len(leaves) > 3 and root.children


def test_whole_small_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    assert result(top_k(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])
