import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelmill.llm.merkle import climb, manifest, sevenths
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, empty_docs

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbs(nodes, fanout):
    """(what remains, siblings (before, after) of every node from below)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in enumerate(at):
            lo = i // fanout * fanout
            run = nodes[lo:lo + fanout]
            paths[p].append((run[:i - lo], run[i - lo + 1:]))
            at[p] = i // fanout
        nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (own, *climbs([leaf(r) for r in own], fanout))
    root, tops = climbs([trees[g][1] for g in order], fanout) if order else ("", [])
    out = []
    for g, top in zip(order, tops):
        own, sub, paths = trees[g]
        for r, path in zip(own, paths):
            path = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for before, after in path:
                h = sha(*before, h, *after)
            out.append((r[0], leaf(r), sub, root, sha(*[x for b, a in path for x in (*b, *a)]), h, h == root))
    return sorted(out, key=repr)


def result(docs, **more):
    got = manifest(docs, tampered={"n_chars": docs["n_chars"] + 1}, where=sevenths(docs["doc_id"]), **more)
    return sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=repr)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("fanout,block", [(2, 4096), (2, 4), (3, 9)])
def test_edges(spark, fanout, block):
    docs = edge_docs(spark)
    docs = docs.union(docs.where("doc_id < 3"))  # equal rows
    want = brute(plain(docs), fanout)
    assert result(docs, fanout=fanout, block=block) == want
    assert {w[6] for w in want} == {True, False}


def test_empty_and_single_rows(spark):
    assert result(empty_docs(spark)) == []
    one = edge_docs(spark).where("doc_id = 8")
    got = result(one)
    assert got == brute(plain(one)) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha()


def test_many_groups_of_all_sizes(spark):
    rnd = random.Random(3)
    rows = [(i, None, f"g{rnd.choice([0, 0, 0, 1, 2, rnd.randint(3, 40)])}", i % 9 or None, f"t{i % 50}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(docs, block=32) == brute(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert result(docs) == brute(plain(docs))


def test_a_proof_leads_to_the_root_and_windows_stay_in_blocks(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    r = manifest(docs).where("doc_id = 17").first()
    h = r.leaf
    for run in r.path:
        h = sha(run.before, h, run.after)
    assert h == r.root and r.verified
    nodes = spark.range(64).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("pos"), F.lit(64).cast("long").alias("n"),
                                   F.col("id").cast("string").alias("h"))
    plan = climb(nodes, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and "block" in plan and plan.count("Exchange") == 1
