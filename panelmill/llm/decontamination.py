"""Benchmark decontamination by one Aho-Corasick automaton (operator 3).

Texts are normalised to words: A-Z become lower case; a word is a run of digits, a-z and
characters beyond ASCII. The automaton holds every window of ``size`` consecutive words of
the benchmark items (an item of fewer words, but not none, is one window). Each text is
normalised and scanned once; a match's end gives its word range, and word ranges map back
to offsets in the original text.

The benchmark is the one thing sent to all tasks. Its bytes are summed by Spark first, and
the windows are built in blocks of ``block_words`` item words. A worker holds one block's automaton at a time: that of a
benchmark of one block is built once, those of a larger one are built anew for every batch of texts, which costs time and
not memory. Documents stay in their partitions: no shuffle.

A null text has no words and no hits; an empty benchmark gives no hits; an item with a
null id counts under the string "null" only if it occurs (benchmark ids are expected to be
set); repeated documents are judged each on their own; repeated items count by id once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import blobs, map_rows

#: Lower-cases A-Z and turns every separator byte into a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
#: Words of a block: an automaton takes some 4 KB a window of 13 words, so about 400 MB.
BLOCK_WORDS = 100_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(item: list[bytes], size: int) -> list[bytes]:
    """The windows of one item, each as ' word word ... '."""
    if not item:
        return []
    return [b" " + b" ".join(item[i:i + size]) + b" " for i in range(max(1, len(item) - size + 1))]


class Automaton:
    """Windows of a block of items; values are (number of words, item numbers)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int):
        import ahocorasick
        owners: dict[bytes, set[int]] = {}
        for number, item in items:
            for w in windows(item, size):
                owners.setdefault(w, set()).add(number)
        self.machine = ahocorasick.Automaton()
        for w, who in owners.items():
            self.machine.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(who)))
        self.machine.make_automaton()
        self.empty = not owners

    def scan(self, text: str):
        return () if self.empty else self.machine.iter(text)


_MACHINE: dict[str, Automaton] = {}  # per worker process: the last automaton


def machines(key: str, items: list[bytes], size: int, block_words: int) -> Iterator[Automaton]:
    """The automata of the blocks of items, one held at a time; that of a benchmark of one block stays."""
    block, n, number_of_block = [], 0, 0

    def built() -> Automaton:
        name = f"{key}-{number_of_block}"
        if name not in _MACHINE:
            _MACHINE.clear()
            _MACHINE[name] = Automaton([(i, words(items[i])) for i in block], size)
        return _MACHINE[name]

    for number, item in enumerate(items):
        own = len(item) // 2 + 1  # words, at most
        if block and n + own > block_words:
            yield built()
            block, n, number_of_block = [], 0, number_of_block + 1
        block.append(number)
        n += own
    yield built()


def hits(texts: list[bytes], automata: Iterator[Automaton]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """(number of words, merged hit word ranges, items that occur) of every text."""
    found: list[tuple[list, set]] = [([], set()) for _ in texts]
    joined = [b" " + b" ".join(words(text)) + b" " for text in texts]
    for automaton in automata:
        for (ranges, items), line in zip(found, joined):
            line = line.decode("latin-1")
            done, at = 0, 0  # words that end before a place of the joined text; matches come in order of their ends
            for end, (n, who) in automaton.scan(line):
                at += line.count(" ", done, end + 1)
                done = end + 1
                last = at - 1  # the space at ``end`` closes word ``last``
                ranges.append((last - n, last))
                items.update(who)
    return [(line.count(b" ") - 1 if len(line) > 2 else 0, merged(ranges), items) for (ranges, items), line in zip(found, joined)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges, in order, as character offsets [start, end) of the original text; the text is decoded once."""
    at = [m.span() for m in WORD.finditer(text.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))]
    out, done, chars = [], 0, 0
    for a, b in ranges:
        start, end = at[a][0], at[b - 1][1]
        chars += len(text[done:start].decode("utf-8"))
        first = chars
        chars += len(text[start:end].decode("utf-8"))
        done = end
        out.append((first, chars))
    return out


class Benchmark:
    """Item ids and texts as they are sent to the tasks; each worker builds the automata once."""

    def __init__(self, benchmark: DataFrame, size: int, block_words: int, max_bytes: int):
        total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if total > max_bytes:
            raise ValueError(f"the benchmark has {total} bytes, more than {max_bytes}")
        rows = [(str(r[0]) if r[0] is not None else "null", (r[1] or "").encode())
                for r in benchmark.select("item_id", "text").toLocalIterator()]
        self.ids, self.items = [r[0] for r in rows], [r[1] for r in rows]
        self.size, self.block_words = size, block_words
        self.key = hashlib.sha256(repr((self.ids, size, block_words)).encode() + b"\0".join(self.items)).hexdigest()

    def automata(self) -> Iterator[Automaton]:
        return machines(self.key, self.items, self.size, self.block_words)


def is_hit(n_words: int, n_hit: int, share: float) -> bool:
    return n_hit > 0 and round(1 / share) * n_hit >= n_words


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: float = 0.05,
         block_words: int = BLOCK_WORDS, max_benchmark_bytes: int = 256 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are the hit word runs as character offsets of the original text. A document is
    contaminated if words are hit and their share is at least ``share``. A benchmark of more than
    ``max_benchmark_bytes`` is refused, because it is sent to every task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Benchmark(benchmark, size, block_words, max_benchmark_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids = sent.value.ids
        for batch in batches:
            out = []
            texts = blobs(batch.column("text"))
            for text, (n, ranges, found) in zip(texts, hits(texts, sent.value.automata())):
                names = sorted({ids[i] for i in found})
                hit = sum(b - a for a, b in ranges)
                out.append((n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                            is_hit(n, hit, share),
                            [{"start": a, "end": b} for a, b in original_spans(text, ranges)] if ranges else []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=SCAN_COLUMNS)

    return map_rows(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, "
                    "contaminated boolean, spans array<struct<start: long, end: long>>")


SCAN_COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: float = 0.05,
               block_words: int = BLOCK_WORDS, max_benchmark_bytes: int = 256 << 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(Benchmark(benchmark, size, block_words, max_benchmark_bytes))

    def clean(texts: pd.Series) -> pd.Series:
        found = hits([(text or "").encode() for text in texts], sent.value.automata())
        return pd.Series([not is_hit(n, sum(b - a for a, b in ranges), share) for n, ranges, _ in found], dtype=bool)

    return docs.where(F.pandas_udf(clean, "boolean")(F.col("text")))
