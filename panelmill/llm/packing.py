"""Packing into full sequences of several context sizes, with cuts (operator 1).

The tiers are context sizes: powers of two from ``shortest`` to ``longest``, a queue for each. Every task tokenizes
its rows, routes them and packs them on its own, a window of tokens at a time:

1. a document longer than the longest context gives whole sequences of that length; what is left of it, and every
   shorter document, is routed to the queue of the least tier that holds it;
2. when a window of tokens waits, every tier, the longest first, makes whole sequences of its own length: the longest
   item of its queue opens one, and the gap is filled by the longest items that fit, those of the shorter queues included;
3. a gap that no item fits is closed by a piece cut from the longest remaining item of the tier or below, whose rest
   is routed again by its new length, so the sequence is always full;
4. a queue that cannot fill a sequence waits for the next window; at the end of the task the rest, less than one
   longest sequence, is cut into sequences of powers of two, at most one of each, each full. Nothing is padded.

Step groups: all sequences of one length, of all tasks, are dealt in turn to as few groups as hold at most
``step_tokens`` tokens each (at least one sequence). The number of sequences per task and length, one row each, places a task's
sequences among all, so the groups of a length differ by one sequence at most.

No texts or ids are shuffled; the pieces are written once, since the counts are known only then. The sequence id holds
the task's partition number, which is the same when a lost executor's task runs again. A task holds one window of ids
and one document. A null or empty text is the one end id; repeated rows are packed each on their
own; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from panelmill.llm.common import Scratch, map_rows, tokenizer_path

#: Characters on which every library agrees about class, case and composition; texts with
#: any other character are encoded by the tokenizer library in one go.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧‰-⁞€]*")
MEMO = 250_000  # words in the younger of two generations of the memo
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
           "tier", "step_group"]


def for_words(tokenizer, source: dict):
    """``tokenizer`` for lower-case words of letters between blanks, or None where its rules are not the known ones.

    Such a word of a plain text is composed and in lower case, and one run of letters: blanks give the same pieces
    as the normalizers and the pattern.
    """
    from tokenizers import Tokenizer, pre_tokenizers
    steps = (source["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    if "|[\\p{L}]+|" not in steps[0]["pattern"].get("Regex", "") or [
            x["type"] for x in (source["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
        return None
    out = Tokenizer(tokenizer.model)
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Encoder:
    """Ids of texts as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so the ids of a plain text are
    those of its words. Words are encoded once and remembered (a bounded memo of two
    generations). New words of letters only are encoded together: the ids of each end at the
    first token that carries the end-of-word mark. A word of letters and one full stop or comma is two pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        source = json.loads(self.tokenizer.to_str())
        mark = source["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if mark:
            self.ends[[i for w, i in vocab.items() if w.endswith(mark)]] = True
        self.words = for_words(self.tokenizer, source) if mark else None
        self.stops = {x: self.whole(x) for x in ".,"}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        memo, old = self.memo, self.old
        plain, stopped, other = set(), [], []
        for w in words:
            if w in old:
                memo[w] = old[w]
            elif self.words is None:
                other.append(w)
            elif w.isalpha():
                plain.add(w)
            elif w[-1] in ".," and w[:-1].isalpha():
                stopped.append(w)
            else:
                other.append(w)
        for w in stopped:
            if (body := w[:-1]) not in memo:
                if body in old:
                    memo[body] = old[body]
                else:
                    plain.add(body)
        plain = list(plain)
        blocks = [" ".join(plain[at:at + 64]) for at in range(0, len(plain), 64)]
        for at in range(0, len(blocks), 64):
            own = plain[64 * at:64 * (at + 64)]
            ids = np.asarray([i for e in self.words.encode_batch_fast(blocks[at:at + 64], add_special_tokens=False)
                              for i in e.ids], "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(own):
                raise ValueError("a word of letters is more than one piece")
            start, ids = 0, ids.tobytes()
            for w, end in zip(own, ends):
                memo[w] = ids[start:end]
                start = end
        for w in stopped:
            memo[w] = memo[w[:-1]] + self.stops[w[-1]]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            memo[w] = np.asarray(e.ids, "<u4").tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        memo = self.memo
        cut: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if text and (not PLAIN.fullmatch(text) or any(s in text for s in self.special)):
                cut.append(None)
            else:
                words = text.lower().split() if text else []
                new.update(filterfalse(memo.__contains__, words))
                cut.append(words)
        self.learn(new)
        return [self.whole(text) if words is None else b"".join(map(memo.__getitem__, words))
                for text, words in zip(texts, cut)]


_ENCODERS: dict[str, Encoder] = {}  # per worker process


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Window:
    """Items (length, item, start) waiting to be packed: a queue for each tier, sorted by length."""

    def __init__(self, longest: int, shortest: int | None = None):
        self.longest, shortest = longest, shortest or max(longest // 4, 1)
        self.tiers = [shortest << k for k in range((longest // shortest).bit_length())]
        self.queues: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]
        self.waiting = [0] * len(self.tiers)  # tokens of each queue

    @property
    def tokens(self) -> int:
        return sum(self.waiting)

    def route(self, length: int, item: int, start: int) -> None:
        """Into the queue of the least tier that holds the item."""
        k = bisect_left(self.tiers, length)
        insort(self.queues[k], (length, item, start))
        self.waiting[k] += length

    def _pop(self, k: int, at: int = -1) -> tuple[int, int, int]:
        got = self.queues[k].pop(at)
        self.waiting[k] -= got[0]
        return got

    def add(self, item: int, tokens: int) -> Iterator[list[tuple[int, int, int]]]:
        """Take a document; yields the whole sequences that its body fills."""
        start = 0
        while tokens - start >= self.longest:
            yield [(item, start, self.longest)]
            start += self.longest
        if tokens > start:
            self.route(tokens - start, item, start)

    def _take(self, room: int, top: int) -> tuple[int, int, int] | None:
        """The longest item that fits, from tier number ``top`` down."""
        for k in range(top, -1, -1):
            at = bisect_right(self.queues[k], (room, float("inf")))
            if at:
                return self._pop(k, at - 1)
        return None

    def fill(self, size: int, top: int) -> list[tuple[int, int, int]]:
        """One full sequence of ``size`` tokens from tier number ``top`` down; at least as many must wait there."""
        out, room = [], size
        while room:
            got = self._take(room, top)
            if got is None:  # no item fits: cut the longest one, its rest is routed again
                length, item, start = self._pop(max(k for k in range(top + 1) if self.queues[k]))
                out.append((item, start, room))
                self.route(length - room, item, start + room)
                break
            out.append((got[1], got[2], got[0]))
            room -= got[0]
        return out

    def full(self) -> Iterator[list[tuple[int, int, int]]]:
        """Whole sequences of every tier, the longest first, as long as a tier's queue opens one that can be filled."""
        for k in range(len(self.tiers) - 1, -1, -1):
            while self.queues[k] and sum(self.waiting[:k + 1]) >= self.tiers[k]:
                yield self.fill(self.tiers[k], k)

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What no tier can fill, in powers of two, until nothing waits."""
        yield from self.full()
        size, top = self.longest, len(self.tiers) - 1
        while self.tokens:
            if self.tokens >= size:
                yield self.fill(size, top)
            else:
                size //= 2


def in_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """``pieces`` with ``step_group`` in place of ``task`` and ``nth`` (a sequence's number within its task and tier)."""
    own = pieces.where("offset = 0").groupBy("task", "tier").agg(F.count("*").alias("n"))
    every = W.Window.partitionBy("tier")
    groups = F.ceil(F.sum("n").over(every) * F.col("tier") / F.greatest(F.lit(step_tokens), F.col("tier")))
    own = own.select("task", "tier", groups.alias("groups"),
                     (F.sum("n").over(every.orderBy("task")) - F.col("n")).alias("before"))
    group = F.pmod(F.col("before") + F.col("nth"), F.col("groups"))
    return (pieces.join(F.broadcast(own), ["task", "tier"])
            .select(*COLUMNS[:-1], (F.col("tier") * F.lit(1 << 32) + group).alias("step_group")))


def pack(docs: DataFrame, longest: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 2,
         window_tokens: int = 1 << 20, step_tokens: int = 1 << 17,
         tokenizer_dir: str | None = None, shortest: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``longest`` and ``shortest`` are the longest and the shortest tier, powers of two. Sequences are full at a tier, at
    the end of a task at a shorter power of two.
    """
    if longest & (longest - 1) or longest < 2:
        raise ValueError("the longest context must be a power of two")
    if shortest & (shortest - 1) or shortest < 1:
        raise ValueError("the shortest context must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*COLUMNS[:-1], "task", "nth"]

    def run(batches):
        own, end = encoder(tokenizer_path(vocabulary, tokenizer_dir)), np.asarray([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        window, held, rows, made, in_tier = Window(longest, min(shortest, longest)), {}, [], 0, {}
        item = 0

        def put(sequence):
            nonlocal made
            size = sum(n for _, _, n in sequence)
            nth = in_tier.get(size, 0)
            in_tier[size] = nth + 1
            offset = 0
            for i, start, n in sequence:
                doc_id, ids, left = held[i]
                rows.append((doc_id, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), len(ids) // 4,
                             task << 32 | made, offset, size, task, nth))
                offset += n
                if left == n:
                    del held[i]
                else:
                    held[i] = (doc_id, ids, left - n)
            made += 1

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names) if rows else None
            rows.clear()
            return out

        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [batch.column("doc_id").type, *[pa.int64()] * 9]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.batch(batch.column("text").to_pylist())):
                ids += end
                held[item] = (doc_id, ids, len(ids) // 4)
                for sequence in window.add(item, len(ids) // 4):
                    put(sequence)
                item += 1
                if window.tokens >= window_tokens:
                    for sequence in window.full():
                        put(sequence)
            if out := flush():
                yield out
        for sequence in window.rest():
            put(sequence)
        if out := flush():
            yield out

    pieces = map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))
    return in_groups(Scratch(docs.sparkSession, "packing").put(pieces), step_tokens)
