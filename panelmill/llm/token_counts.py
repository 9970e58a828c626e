"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

A text is cut into the pieces that the tokenizer's pre-tokenizer makes. The symbols of a
piece form a linked list; a heap holds its adjacent pairs by merge rank. The lowest pair
(leftmost on ties) is popped and joined until no ranked pair is left. A piece's count is its
number of initial symbols minus its merges; no ids are produced.

Every task counts its own rows: no shuffle, no state beyond a bounded memo of counts by
chunk. A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each on
their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import os
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelmill.llm.common import map_rows, tokenizer_path

#: The piece pattern of the byte-level tokenizers (fixed value, part of their format).
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A run of white space and what follows it; pieces never cross such a chunk's ends.
CHUNKS = re.compile(r"\s*\S+|\s+")
#: Characters whose class is the same in every Unicode version and library. A text with any
#: other character is cut by the tokenizer library's own pre-tokenizer.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧‰-⁞€]*")
MEMO = 400_000  # chunks remembered per worker; then the memo starts anew


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairMerger:
    """Merge ranks of one vocabulary file and the counting of a piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.symbol = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)

    def count(self, piece: bytes) -> int:
        symbols = [self.symbol[b] for b in piece]
        n, rank = len(symbols), self.rank
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1)
                if (r := rank.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue  # one of the two symbols is gone since
            symbols[i], symbols[j] = rank[a, b][1], -1
            right[i] = after = right[j]
            merges += 1
            if after < n:
                left[after] = i
                if r := rank.get((symbols[i], symbols[after])):
                    heapq.heappush(heap, (r[0], i, symbols[i], symbols[after]))
            if (before := left[i]) >= 0 and (r := rank.get((symbols[before], symbols[i]))):
                heapq.heappush(heap, (r[0], before, symbols[before], symbols[i]))
        return n - merges


class TextCounter:
    """Counts of whole texts: special strings are one token each, the rest goes by chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.merger = PairMerger(path)
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.cut = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None
        self.back = {c: b for b, c in byte_letters().items()}
        self.memo: dict[str, int] = {}

    def chunk(self, chunk: str) -> int:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[chunk] = n = sum(self.merger.count(p.encode()) for p in PIECES.findall(chunk))
        return n

    def other(self, text: str) -> int:
        total = 0
        for piece, _ in self.pre.pre_tokenize_str(text):
            if (n := self.memo.get(key := "\0" + piece)) is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[key] = n = self.merger.count(bytes(map(self.back.__getitem__, piece)))
            total += n
        return total

    def text(self, text: str) -> int:
        total = 0
        parts = [text]
        if self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            total = len(parts) - 1
        for part in parts:
            if not PLAIN.fullmatch(part):
                total += self.other(part)
                continue
            get, chunk = self.memo.get, self.chunk
            for c in CHUNKS.findall(part):
                n = get(c)
                total += chunk(c) if n is None else n
        return total


_COUNTERS: dict[str, TextCounter] = {}  # per worker process


def counter(path: str) -> TextCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TextCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024,
                 tokenizer_dir: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    def count(batches):
        own = counter(tokenizer_path(vocabulary, tokenizer_dir))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [own.text(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), count,
                    f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
