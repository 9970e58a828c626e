import random

import pytest

from panelmill.llm.common import tokenizer_path
from panelmill.llm.token_counts import TextCounter, token_counts
from tests.conftest import SF_SMALL
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def test_any_text_counts_as_in_the_library(library):
    rnd = random.Random(1)
    letters = " \n\t\r  abcABC'sdé'tll12½²—’…<|endoftext|>\x1c\x1f\x85\xa0　中文Σ́İ_!?.،\x00\U0001f600"
    counter = TextCounter(PATH)
    for _ in range(3000):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert counter.text(x) == library(x), repr(x)


def test_edges(spark, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(edge_docs(spark)).collect())
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), library(r[1]), library(r[1]) > 1024) for r in edge_rows())
    assert got == want
    assert token_counts(empty_docs(spark)).count() == 0


def test_whole_small_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: library(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == want
