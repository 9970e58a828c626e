import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelmill.llm.common import tokenizer_path
from panelmill.llm.packing import Encoder, Window, pack
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs


def ids_of(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check(pieces, rows):
    """Every id of every row in exactly one piece; sequences gapless and full."""
    want = defaultdict(int)
    for (doc_id, _), ids in zip(rows, ids_of([t for _, t in rows])):
        want[doc_id, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
    by_ids = defaultdict(list)
    for doc_id, text in rows:
        by_ids[doc_id].append(ids_of([text])[0])
    covered = defaultdict(int)
    for p in pieces:
        fits = [k for k, ids in enumerate(by_ids[p.doc_id]) if len(ids) == p.doc_tokens and zlib.crc32(
            np.asarray(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert fits and p.length > 0
        covered[p.doc_id] += p.length
    assert covered == {d: sum(map(len, v)) for d, v in by_ids.items()}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at & (at - 1) == 0 and at <= 4096 and {p.tier for p in own} == {at}


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    pieces = pack(edge_docs(spark)).collect()
    check(pieces, rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pieces = pack(docs, window_tokens=8192).collect()
    check(pieces, rows)
    starts = {(p.doc_id, p.start) for p in pieces}
    assert len(starts) == len(pieces)  # no id is in two pieces
    groups = defaultdict(int)
    for p in pieces:
        groups[p.step_group] += p.length
    assert max(groups.values()) <= (1 << 17)


def test_empty(spark):
    assert pack(empty_docs(spark)).collect() == []


def test_gaps_are_filled_by_shorter_tiers():
    w = Window(64)
    assert list(w.add(0, 130)) == [[(0, 0, 64)], [(0, 64, 64)]]  # body; a tail of 2 waits
    for item, n in ((1, 40), (2, 20), (3, 10), (4, 5)):
        assert list(w.add(item, n)) == []
    (first,) = w.full()
    assert [n for _, _, n in first] == [40, 20, 2, 2]  # longest first, then what fits, then a cut
    rest = list(w.rest())
    assert [sum(n for _, _, n in s) for s in rest] == [8, 4, 1]
    with pytest.raises(ValueError):
        pack(None, longest=100)


def test_documents_are_routed_to_tiers():
    """Short documents make whole sequences of their own tier; a long one's gap takes from the shorter queues."""
    w = Window(64, 8)
    for item in range(12):
        assert list(w.add(item, 7)) == []
    assert list(w.add(20, 50)) == [] and list(w.add(21, 14)) == []
    assert w.waiting == [84, 14, 0, 50]
    made = list(w.full())
    assert [n for _, _, n in made[0]] == [50, 14]  # the gap's best fit is in a shorter queue
    assert [sum(n for _, _, n in s) for s in made[1:]] == [8] * 10  # not one sequence of 64
    assert [sum(n for _, _, n in s) for s in w.rest()] == [4]


def test_tiers_follow_lengths_and_groups_are_even(spark):
    """Whole sequences in every tier; groups span tasks, and those of a tier differ by one sequence at most."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = pack(docs, step_tokens=1 << 14).collect()
    check(pieces, rows)
    per_tier, per_group, tasks = defaultdict(set), defaultdict(set), defaultdict(set)
    for p in pieces:
        per_tier[p.tier].add(p.sequence_id)
        per_group[p.tier, p.step_group].add(p.sequence_id)
        tasks[p.tier].add(p.sequence_id >> 32)
    assert all(len(per_tier[t]) > len(tasks[t]) for t in (512, 1024, 2048, 4096))
    assert sum(len(v) for v in per_group.values()) == sum(len(v) for v in per_tier.values())
    for tier, sequences in per_tier.items():
        sizes = [len(v) for (t, _), v in per_group.items() if t == tier]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= max(1 << 14, tier)
        assert len(sizes) == -(-len(sequences) * tier // (1 << 14))
        if tier < 512:  # leftovers of all tasks share groups
            assert len(sizes) == 1


def test_words_of_letters_skip_the_rules_of_the_tokenizer():
    """Letters, and letters with one full stop or comma, need no pass of the whole rules; all ids are the library's."""
    own = Encoder(tokenizer_path("word_bpe_49k.json"))
    odd = ["It's, a.b. x., É. ½. ª, º. 3. 3, a1. foo.. bar,. 'S, ., . , _a. ŉ, ſt. µm. straße, ĲSSEL.", "d'été, l'an.", None, "",
           "don't. WE'LL, <|endoftext|>, x.", "naïve\u2009word.", "日本, é."]
    assert own.batch(odd) == [own.whole(t or "") for t in odd]
    plain = "Une école, deux écoles. three SCHOOLS, four,\nfive."
    want = own.whole(plain)

    class Rules:
        def encode_batch_fast(self, texts, **_):
            assert texts == []
            return []

    own.tokenizer, own.memo, own.old = Rules(), {}, {}
    assert own.batch([plain]) == [want]
