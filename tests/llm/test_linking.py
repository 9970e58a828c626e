import random

import numpy as np

from pyspark.sql import functions as F

from panelmill.llm import linking
from panelmill.llm.common import KeyFilter, Scratch, only_held
from panelmill.llm.linking import components, forest, intersections, link
from panelmill.llm.sketching import bands, fast_sketch
from tests.llm.helpers import union_find


def test_components_of_random_graphs_paths_and_stars(spark):
    rnd = random.Random(11)
    n = 400
    links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(180)]
    links += [(i, i + 1) for i in range(100, 180)] + [(350, i) for i in range(300, 349)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    want = union_find(n, links)
    assert [got.get(i, i) for i in range(n)] == want
    assert components(df.limit(0), Scratch(spark, "t")) is None


def test_intersections_by_matrix_products():
    rnd = np.random.default_rng(1)
    a = [set(rnd.integers(0, 60, rnd.integers(1, 40)).tolist()) for _ in range(12)]
    b = [set(rnd.integers(0, 60, rnd.integers(1, 40)).tolist()) for _ in range(7)]
    want = [[len(x & y) for y in b] for x in a]
    assert intersections(a, b).tolist() == want
    own, others = intersections(a, a), ~np.eye(len(a), dtype=bool)  # a set and itself are no pair
    assert np.array_equal(own[others], np.array([[len(x & y) for y in a] for x in a])[others])
    one = [{1}]
    assert forest([1], [1], one, [2], [2], list(one), 85) == [(1, 2)]
    assert forest([1], [7], one, [2], [7], list(one), 85) == []


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rnd = np.random.default_rng(3)
    t = 64
    errors = []
    for shared, own in ((400, 50), (10, 5), (1, 0), (3, 1), (200, 200)):
        common = rnd.integers(0, 1 << 63, shared).astype(np.uint64)
        x = np.concatenate([common, rnd.integers(0, 1 << 63, own).astype(np.uint64)])
        y = np.concatenate([common, rnd.integers(0, 1 << 63, own).astype(np.uint64)])
        grid = fast_sketch(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 3, t)
        assert (grid[:2] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (grid[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        errors.append(abs((grid[0] == grid[1]).mean() - shared / (shared + 2 * own)))
    assert max(errors) < 0.25
    assert bands(grid, 4).shape == (3, 16)


def test_recall_of_the_bands_at_the_threshold():
    """Pairs of similarity 0.85 share a band."""
    rnd = np.random.default_rng(5)
    n, missed = 1500, 0
    common = rnd.integers(0, 1 << 63, (n, 170)).astype(np.uint64)
    own = rnd.integers(0, 1 << 63, (2, n, 15)).astype(np.uint64)
    keys = [bands(fast_sketch(np.concatenate([common, own[s]], axis=1).ravel(), np.repeat(np.arange(n), 185), n, 64), 4) for s in (0, 1)]
    missed = (~(keys[0] == keys[1]).any(axis=1)).sum()
    assert missed <= 1


def test_key_filter_lets_every_key_through(spark):
    keys = spark.range(0, 3000, 3).selectExpr("xxhash64(id) AS k")
    f = KeyFilter(keys, "k", bits=1 << 16)
    rows = spark.range(3000).selectExpr("id", "xxhash64(id) AS k")
    got = {r.id for r in only_held(rows, f, "k").collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1100
    assert only_held(rows, KeyFilter(keys.limit(0), "k", bits=1 << 10), "k").count() == 0


def test_payloads_move_with_their_family(spark, monkeypatch):
    """Payloads are gathered once, by family; the steps of large families see theirs only."""
    monkeypatch.setattr(linking, "BLOCK", 4)
    whole, seen, gathered = linking.large_family_links, [], []

    def watched(members, data, *rest):
        seen.append({r.node for r in data.collect()})
        return whole(members, data, *rest)

    monkeypatch.setattr(linking, "large_family_links", watched)
    words = {i: f"a b c d e {'f' if i % 2 else 'g'}" for i in range(20)} | {30: "x y z", 31: "x y z", 40: "p q r", 41: "u v w"}
    members = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 30), (2, 31), (3, 40), (3, 41)], "band long, node long")
    data = spark.createDataFrame([(i, t.encode()) for i, t in words.items()], "node long, payload binary")

    def texts(families):
        gathered.append(sorted((r.node, r.root) for r in families.collect()))
        return families.join(data, "node")

    labels = link(members.withColumn("size", F.lit(0)), texts, lambda b: set(b.split()), 80, Scratch(spark, "t"))
    assert seen == [set(range(20))]
    assert gathered == [[(i, 0) for i in range(20)] + [(30, 30), (31, 30), (40, 40), (41, 40)]]
    assert {r.node: r.root for r in labels.collect()} == {i: i % 2 for i in range(2, 20)} | {31: 30}


def test_only_long_payloads_are_joined_to_size_a_bucket(spark):
    """Chunks keep within BLOCK and BYTES; rows of short payloads are counted and not joined."""
    few, many = [(0, 3000), (0, 3001), (0, 1)], [(1, i) for i in range(2000)]
    rows = spark.createDataFrame(few + many, "band long, node long")
    data = spark.createDataFrame([(i, b"x") for i in range(2000)] + [(3000, bytes(20 << 20)), (3001, bytes(30 << 20))],
                                 "node long, payload binary")
    sizes = linking.sized(rows, data, "band")
    assert {r.band: r.chunks for r in sizes.collect()} == {0: 4, 1: 2}
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert f"> {linking.LONG})" in plan
