import random

from panelmill.llm.near_dedup import keep_one, near_duplicates, words
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORDS, edge_docs, edge_rows, empty_docs, prose, union_find


def shingles(text, k):
    own = words((text or "").encode())
    if not own:
        return frozenset()
    return frozenset(tuple(own[i:i + k]) for i in range(len(own) - k + 1)) if len(own) >= k else frozenset([tuple(own)])


def brute(rows, k, percent):
    """(no id, doc_id, n_shingles, component, kept) of every row."""
    sets = [shingles(t, k) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links.append((i, j))
    roots = union_find(len(rows), links)
    least = {}
    for (doc_id, _), root, s in zip(rows, roots, sets):
        if doc_id is not None and s:
            least[root] = min(least.get(root, doc_id), doc_id)
    out = []
    for (doc_id, _), root, s in zip(rows, roots, sets):
        c = least.get(root) if s else doc_id
        out.append((doc_id is None, doc_id or 0, len(s), -1 if c is None else c, doc_id == c))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept)
                  for r in df.collect())


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    for k, percent in ((3, 85), (5, 80)):
        assert result(near_duplicates(edge_docs(spark), k, percent)) == brute(rows, k, percent)
    kept = keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and 100 * len(a & b) >= 80 * len(a | b)]
    roots = union_find(len(rows), links)
    assert kept.count() == len({r for r, s in zip(roots, sets) if s}) + sum(not s for s in sets)
    assert near_duplicates(empty_docs(spark)).count() == 0 and keep_one(empty_docs(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(4)
    a, b = prose(rnd, 60), prose(rnd, 60)
    rows = [(1, a), (1, a), (3, a + " more"), (None, b), (None, b), (None, b + " x"), (2, ""), (2, ""), (2, None), (7, b.upper()), (9, "z")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, doc long")
    got = keep_one(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(1, a), (2, ""), (2, ""), (2, ""), (7, b.upper()), (9, "z")])
    assert len({r.doc for r in got}) == 6


def test_hot_group_of_near_copies_equals_brute_force(spark):
    """Copies of one text with 0 to 25 changed words: some are linked directly, some by others, some not at all."""
    rnd = random.Random(9)
    base = prose(rnd, 150, line=15).split(" ")
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rnd.randint(0, 25)):
            own[rnd.randrange(len(own))] = rnd.choice(WORDS) + "x"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, prose(rnd, 80)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert len({w[3] for w in want}) > 110
    assert result(near_duplicates(df)) == want


def test_blocks_of_a_bucket_meet_each_other(spark, monkeypatch):
    from panelmill.llm import linking
    monkeypatch.setattr(linking, "BLOCK", 16)
    monkeypatch.setattr(linking, "CHUNK", 8)
    test_hot_group_of_near_copies_equals_brute_force(spark)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert result(near_duplicates(docs)) == brute([tuple(r) for r in docs.collect()], 3, 85)
