import hashlib
import random
import re

from panelmill.llm.decontamination import keep_clean, scan, windows, words
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORDS, edge_docs, edge_rows, empty_docs, prose

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    owners = {}
    for item_id, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            owners.setdefault(tuple(w[i:i + size]), set()).add(str(item_id))
    lengths = {len(k) for k in owners}
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if who := owners.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= who
        names = sorted(found)
        out.append((doc_id is None, doc_id or 0, len(w), len(hit), len(names),
                    hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_edges(spark):
    rnd = random.Random(5)
    base = edge_rows()[0][1]
    items = [(1, " ".join(base.split()[10:40])), (2, base.split()[3].upper() + ", " + base.split()[4]), (3, None), (4, ""),
             (5, "!!"), (5, prose(rnd, 20)), (10, "SAME same"), (11, "中文")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = brute(rows, items)
    assert result(scan(edge_docs(spark), bench)) == want and any(w[6] for w in want)
    assert result(scan(edge_docs(spark), bench, block_words=5)) == want  # several automata
    left = keep_clean(edge_docs(spark), bench)
    assert left.columns == edge_docs(spark).columns and left.count() == sum(not w[6] for w in want)
    assert scan(empty_docs(spark), bench).count() == 0
    assert all(not r.contaminated and r.n_hit == 0 for r in scan(edge_docs(spark), bench.limit(0)).collect())


def test_spans_are_offsets_of_the_original(spark):
    bench = spark.createDataFrame([(1, "Café two, THREE")], "item_id long, text string")
    text = "éé! x café--TWO three!! y"
    r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).collect()[0]
    assert [text[s.start:s.end] for s in r.spans] == ["café--TWO three"] and r.n_hit == 3


def test_spans_of_long_texts_take_time_in_proportion(spark):
    import time
    from panelmill.llm.decontamination import original_spans
    took = []
    for n in (4000, 32000):
        text = "é word " * n
        began = time.perf_counter()
        spans = original_spans(text.encode(), [(2 * i, 2 * i + 1) for i in range(n)])
        took.append(time.perf_counter() - began)
        assert len(spans) == n and text[spans[-1][0]:spans[-1][1]] == "é"
    assert took[1] < 30 * took[0]


def test_random_texts_equal_brute_force(spark):
    rnd = random.Random(6)
    make = lambda n: " ".join(rnd.choice(WORDS[:3]) for _ in range(n))
    items = [(i, make(rnd.randint(0, 20))) for i in range(30)]
    docs = [(i, make(rnd.randint(0, 120))) for i in range(150)]
    got = scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == brute(docs, items)


def test_whole_small_table(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert result(scan(docs, bench)) == want


def test_windows_of_short_and_long_items():
    assert windows([], 3) == [] and windows([b"a"], 3) == [b" a "]
    assert windows([b"a", b"b", b"c", b"d"], 3) == [b" a b c ", b" b c d "] and words(b"A.b\xc3\x89") == [b"a", b"b\xc3\x89"]
