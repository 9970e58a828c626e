import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelmill.llm import repeats
from panelmill.llm.repeats import refine, remove_repeats
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose


def brute(rows, size):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[s:s + size] for _, b in data for s in range(len(b) - size + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, np.int8)
        for s in range(len(b) - size + 1):
            if seen[b[s:s + size]] > 1:
                gone[s:s + size] = 1
        gone[len(b)] = 0
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()
        out.append((d is None, d or 0, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert result(remove_repeats(edge_docs(spark))) == brute(rows, 400)
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_many_variants_of_a_passage(spark):
    """Short windows, few letters, periodic text, repeats within a text and across variants."""
    rnd = random.Random(17)
    base = prose(rnd, 60)
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = rnd.choice("qxé")
        rows.append((i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) + "".join(own)[rnd.randint(0, 200):]))
    rows += [(100, "ab" * 300), (101, "abc" * 200 + "ab" * 100), (102, "z" * 64), (103, "z" * 63), (104, base[:80] + base[:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(remove_repeats(df, size=64, gram=8)) == brute(rows, 64)
    assert result(remove_repeats(df, size=33, gram=32)) == brute(rows, 33)


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rnd = random.Random(19)
    one = prose(rnd, 900)
    rows = [(1, one), (2, prose(rnd, 300) + one[1500:4200] + prose(rnd, 100)), (3, one[:900])]
    texts = [t.encode() for _, t in rows]
    # windows of one text and anchor fall into runs however the text is cut
    whole = {(int(x), int(i), int(p + s)) for _, at, lo, hi, a, text, s_ in repeats.scanned(texts, 400, 32)
             for x, i, p, s in zip(a, text, at, s_)}
    monkeypatch.setattr(repeats, "PIECE", 1 << 20)
    assert whole == {(int(x), int(i), int(p + s)) for _, at, lo, hi, a, text, s_ in repeats.scanned(texts, 400, 32)
                     for x, i, p, s in zip(a, text, at, s_)}
    assert result(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 400)


def test_refinement_equals_window_comparison():
    rnd = random.Random(23)
    size = 12
    for _ in range(60):
        base = "".join(rnd.choice("abc") for _ in range(40))
        parts, left = [], []
        for _ in range(rnd.randint(2, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(40)] = rnd.choice("abcd")
            lo, hi = rnd.randint(0, 18), rnd.randint(22, 40)
            parts.append("".join(own)[lo:hi].encode())
            left.append(20 - lo)
        got = refine(parts, np.array(left), size)
        for i, spans in enumerate(got):
            covered = {x for a, b in spans for x in range(a, b)}
            want = set()
            for s in range(-left[i], len(parts[i]) - left[i] - size + 1):
                mine = parts[i][s + left[i]:s + left[i] + size]
                for j in range(len(parts)):
                    at = s + left[j]
                    if j != i and 0 <= at and at + size <= len(parts[j]) and parts[j][at:at + size] == mine:
                        want.update(range(s, s + size))
            assert covered == want


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert result(remove_repeats(docs)) == brute([tuple(r) for r in docs.collect()], 400)


def test_no_anchor_is_one_group(spark, monkeypatch):
    """A phrase shorter than a window with other surroundings in every text: its contexts are dealt by windows."""
    rnd = random.Random(29)
    phrase = prose(rnd, 7)[:40]
    ends = ["".join(rnd.choice("abcdef") for _ in range(60)) for _ in range(6)]
    rows = [(i, "".join(rnd.choice("xyz") for _ in range(30)) + phrase + rnd.choice(ends)[:rnd.randint(20, 60)]) for i in range(60)]
    rows += [(70, rows[0][1]), (71, "q" + rows[1][1] + "q" + rows[1][1]), (72, None)]
    largest = []

    def watched(table, size):
        largest.extend(r.n for r in table.where("context is not null").groupBy("anchor")
                       .agg(F.countDistinct("c1", "c2").alias("n")).collect())
        return whole(table, size)

    whole = repeats.repeated_intervals
    monkeypatch.setattr(repeats, "repeated_intervals", watched)
    monkeypatch.setattr(repeats, "BLOCK", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(remove_repeats(df, size=64, gram=8))
    assert got == brute(rows, 64) and any(r[3] for r in got[2:60])
    assert max(largest, default=0) <= 4


def test_scan_holds_a_bounded_piece():
    """The arrays of a scan follow the piece, not the batch or the text: two tasks and the JVM share an executor's memory."""
    text = random.Random(31).randbytes(6 << 20)
    tracemalloc.start()
    try:
        found = sum(len(at) for _, at, *_ in repeats.scanned([text, text[:5000]], 400, 32))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > 20_000 and most < 32 << 20
