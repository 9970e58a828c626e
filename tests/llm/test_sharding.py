import random
import zlib
from collections import defaultdict

from panelmill.llm.sharding import OpenBins, best_fit_decreasing, least_capacity, pack_fixed, shard
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs


def brute_best_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fits = sorted((r, i) for i, r in enumerate(left) if r >= s)
        if fits:
            i = fits[0][1]
        else:
            i = len(left)
            left.append(capacity)
        left[i] -= s
        out.append(i)
    return out


def test_best_fit_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        sizes = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(0, 80))), reverse=True)
        assert best_fit_decreasing(sizes, 100) == brute_best_fit(sizes, 100)


def test_open_bins_take_the_tightest():
    b = OpenBins()
    for n, r in enumerate([7, 3, 9, 3]):
        b.insert(r, n)
    assert b.take(3) == (3, 1) and b.take(3) == (3, 3) and b.take(8) == (9, 2) and b.take(8) is None


def test_least_capacity_is_near_the_mean():
    rnd = random.Random(4)
    sizes = sorted((rnd.randint(1, 500) for _ in range(3000)), reverse=True)
    capacity, bins = least_capacity(sizes, 8)
    loads = [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(8)]
    assert max(loads) <= capacity and max(loads) - sum(sizes) / 8 <= 8


def check(rows, got, n=8):
    assert sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows) == \
        sorted((g.doc_id is None, g.doc_id or 0, g.size, g.text_crc32) for g in got)
    slots = defaultdict(list)
    home = defaultdict(set)
    for g in got:
        slots[g.shard].append(g.slot)
        home[g.text_crc32, g.size].add(g.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    assert all(len(h) == 1 for h in home.values())  # equal texts together
    loads = defaultdict(int)
    for g in got:
        loads[g.shard] += g.size
    return [loads[k] for k in range(n)]


def test_edges(spark):
    rows = edge_rows()
    got = shard(edge_docs(spark), slot_buckets=3).collect()
    check(rows, got)
    assert {g.law for g in got} == {"bytes"} and {g.grown_shard for g in got} == {None}
    assert shard(empty_docs(spark)).collect() == []


def test_small_table_is_even(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    loads = check([(r.doc_id, r.text) for r in docs.collect()], shard(docs).collect())
    largest = max(len(r.text.encode()) + 1 for r in docs.collect())
    assert max(loads) - min(loads) <= max(largest, sum(loads) // 100)


def test_batches_of_small_groups_level_out(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    got = shard(docs, fine=1, buckets=64, levels=4).collect()
    loads = check([(r.doc_id, r.text) for r in docs.collect()], got)
    assert max(loads) - min(loads) <= sum(loads) // 500


def test_fixed_capacity(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([50, 40, 30, 20, 10, 300, 300, 5, 5])], "doc_id long, text string")
    got = pack_fixed(docs, 100).collect()
    loads = defaultdict(int)
    for g in got:
        loads[g.shard] += g.size
    assert len(loads) == 3 and sorted(loads.values())[-1] == 602  # the pair of equal large texts is one group
    assert sorted(loads.values())[:2] and all(v <= 100 for v in sorted(loads.values())[:-1])
