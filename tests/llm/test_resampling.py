import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from panelmill.llm.resampling import crc_of_features, features, resample, slices
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(text, ngrams=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]


def brute(docs, bench, percent=25, min_words=20, buckets=10_000):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    own = [(i, *plain_runs(x)) for i, x in docs]
    for _, _, runs in own:
        for x in runs:
            s[bucket(x)] += 1
    for x in bench:
        for y in plain_runs(x)[1]:
            t[bucket(y)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, n, runs in own:
        weight = sum(gain[bucket(x)] for x in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_features_of_pieces_equal_those_of_whole_texts(ngrams):
    rnd = random.Random(ngrams)
    parts = ["Ab", "c", " ", "  ", "é", "-", "z9z9z9z9z9", "中文"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 2, 5, 200]))) for _ in range(60)]
    for size in (5, 60, 1 << 20):
        words, got = [0] * len(texts), [[] for _ in texts]
        for numbers, some, leads in slices([t.encode() for t in texts], ngrams, size):
            n, owner, bucket = features(some, leads, ngrams, 997)
            for i, x in zip(numbers, n):
                words[i] += x
            for i, x in zip(owner, bucket):
                got[numbers[i]].append(int(x))
        want = [plain_runs(t, ngrams) for t in texts]
        assert words == [n for n, _ in want]
        assert [sorted(g) for g in got] == [sorted(zlib.crc32(x.encode()) % 997 for x in runs) for _, runs in want]


def test_crc_matrices():
    rnd = random.Random(4)
    words = [b"", *{rnd.randbytes(rnd.choice([1, 2, 3, 7, 300])) for _ in range(500)}]
    got = crc_of_features(pa.array(words, pa.large_binary()))
    assert got.tolist() == [zlib.crc32(w) for w in words]


def test_edges(spark):
    rows = edge_rows()
    docs = [(r[0], r[1]) for r in rows]
    bench = [rows[0][1], None, "", "alpha1 Bravo2", rows[16][1][:500]]
    target = spark.createDataFrame([(i, x) for i, x in enumerate(bench)], "item_id long, text string")
    want = brute(docs, bench)
    assert any(w[4] for w in want) and any(w[1] == 0 for w in want)
    assert result(resample(edge_docs(spark), target)) == want
    assert result(resample(edge_docs(spark), target, piece=40)) == want  # texts in pieces
    assert result(resample(empty_docs(spark), target)) == []
    assert result(resample(edge_docs(spark), target.limit(0))) == brute(docs, [])


def test_equal_scores_go_by_id_and_repeated_rows_take_consecutive_ranks(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(5, text)] * 8 + [(i, "short") for i in range(3)], "doc_id long, text string")
    got = resample(docs, docs.limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]


def test_whole_small_table(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert result(resample(docs, bench)) == want
