"""Removal of repeated byte strings by merging anchored Burrows-Wheeler transforms (operator 8).

Every byte covered by a ``size``-byte string that also starts anywhere else is removed. Strings
are compared over the UTF-8 bytes of whole texts and never cross documents.

Merging the transforms of raw shards costs one pass over all text per symbol of the longest common
prefix, so ``size`` passes. Here the suffixes are first aligned, which gives the same intervals from
the repeated places alone:

1. anchors: the anchor of a window of ``size`` bytes is its least ``gram``-byte hash (leftmost on
   ties). Equal windows have equal anchors at equal offsets, so they can only meet among the
   contexts of one anchor. A context is the union of the windows of one anchor place.
2. only anchors that occur at two places matter; a bitmap of fixed size tells them map-side. Equal
   contexts collapse by a 128-bit hash: one that occurs at two places is repeated as a whole.
3. the different contexts of an anchor are shards of one symbol sequence each, aligned at the anchor.
   Their transforms are merged by interleave refinement: column by column the interleave is stably
   dealt out by the symbol, and the common length of neighbours follows as the least over the range
   between them, plus one. No suffix is sorted anew. Where a neighbour shares ``size`` symbols, the window
   that ends at the column is a repeated interval.
   An anchor with more than ``BLOCK`` context places is no group of one task: its contexts are dealt by a 128-bit
   hash of every window (a window fixes its anchor and its offset from it), and a window that two
   contexts have is a repeated interval of both.
4. intervals go back to the places of their contexts and are merged per text.

Exact copies are one text with a count; all of a text that has copies goes (from ``size`` bytes on).
Texts move only where part of them goes.

A null or empty text has no bytes and loses none. Repeated rows are copies like any others. A null
doc_id is kept. Other columns are ignored; an empty table gives an empty result. A very long text is
scanned in overlapping pieces. Distinct contexts of one anchor meet in one task as bytes, at most ``BLOCK`` of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import KeyFilter, Scratch, blobs, map_rows, mix, only_held, text_bytes, text_key

PIECE = 1 << 18  # bytes scanned at once: hashes and minima take some 50 times as much
PLACE_BITS = np.uint64(24)
BLOCK = 20_000  # contexts refined together, less than twice as many with the last anchor; larger anchors go by windows
WINDOWS = 1 << 16  # rows of windows given at once
#: Odd multipliers of the words of a gram (arbitrary).
WORDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (a multiple of 8, at most 32) bytes at every place."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    words = np.zeros(n + 8, np.uint64)
    for r in range(8):
        own = padded[r:r + (n + 8 - r) // 8 * 8].view("<u8")
        words[r::8][:len(own)] = own
    m = n - gram + 1
    h = words[:m] * WORDS[0]
    for j in range(1, gram // 8):
        h += words[8 * j:8 * j + m] * WORDS[j]
    return mix(h)


def anchor_runs(data: np.ndarray, starts: np.ndarray, size: int, gram: int):
    """(anchor place, first window, last window, hash) of every run of windows with one anchor.

    ``starts`` are the places where texts begin in ``data``; windows across texts are left out.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none
    hashes = gram_hashes(data, gram)
    key = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    width, span = size - gram + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    windows = n - size + 1
    rest = width - span
    key = np.minimum(key[:windows], key[rest:rest + windows])
    place = (key & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    ends = np.append(starts[1:], n)
    inside = np.zeros(windows + 1, np.int64)  # windows that lie within one text
    first, last = starts, np.maximum(ends - size + 1, starts)
    ok = last > first
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, np.minimum(last[ok], windows), -1)
    valid = np.cumsum(inside[:-1]) > 0
    change = np.empty(windows, bool)
    change[0] = True
    change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    lo = np.flatnonzero(change)
    # a text's first window starts a run of its own even where the anchor happens to stay
    lo = np.unique(np.concatenate([lo, starts[starts < windows]]))
    hi = np.append(lo[1:], windows) - 1
    keep = valid[lo]
    lo, hi = lo[keep], hi[keep]
    at = place[lo]
    return at, lo, hi, hashes[at].view(np.int64)


def pieces(texts: list[bytes], size: int):
    """Groups of texts, or overlapping pieces of a long one: (bytes, starts, text numbers, offsets in the text)."""
    group, total = [], 0
    for i, text in enumerate(texts):
        if len(text) < size:
            continue
        for at in range(0, len(text) - size + 1, PIECE):
            part = text[at:at + PIECE + size - 1]
            if group and total + len(part) > PIECE + size:
                yield group
                group, total = [], 0
            group.append((part, i, at))
            total += len(part)
    if group:
        yield group


def scanned(texts: list[bytes], size: int, gram: int):
    for group in pieces(texts, size):
        lengths = np.array([len(p) for p, _, _ in group], np.int64)
        starts = np.cumsum(lengths) - lengths
        joined = b"".join(p for p, _, _ in group)
        at, lo, hi, anchor = anchor_runs(np.frombuffer(joined, np.uint8), starts, size, gram)
        owner = np.searchsorted(starts, lo, "right") - 1
        text = np.array([i for _, i, _ in group], np.int64)[owner]
        shift = np.array([o for _, _, o in group], np.int64)[owner] - starts[owner]
        yield joined, at, lo, hi, anchor, text, shift


class Once:
    """Text keys a task has seen, a bounded number of them."""

    def __init__(self, most: int = 200_000):
        self.seen, self.most = set(), most

    def new(self, key) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(key)
        return True


def anchor_places(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, occurrence): occurrence is a hash of text and place."""

    def run(batches):
        once = Once()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            texts = [t if len(t) >= size and once.new(k) else b"" for k, t in zip(keys, blobs(batch.column("text")))]
            ids = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
            for _, at, _, _, anchor, text, shift in scanned(texts, size, gram):
                occurrence = mix(ids[text] + mix((at + shift).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(occurrence.view(np.int64))], ["anchor", "occurrence"])

    return map_rows(rows.select("key", "text"), run, "anchor long, occurrence long")


CONTEXTS = "anchor long, c1 long, c2 long, key binary, place long, left int, size int, context binary"


def contexts(rows: DataFrame, held: KeyFilter, size: int, gram: int) -> DataFrame:
    """Contexts of held anchors; a task gives the bytes of equal contexts once (null after that)."""

    def run(batches):
        once, bytes_once = Once(), Once()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            texts = [t if len(t) >= size and once.new(k) else b"" for k, t in zip(keys, blobs(batch.column("text")))]
            for joined, at, lo, hi, anchor, text, shift in scanned(texts, size, gram):
                mine = np.flatnonzero(held.holds(anchor))
                if not len(mine):
                    continue
                left, full = (at - lo)[mine], (hi + size - lo)[mine]
                c1, c2, parts = [], [], []
                for a, n, lft in zip(lo[mine].tolist(), full.tolist(), left.tolist()):
                    part = joined[a:a + n]
                    h = xxhash.xxh3_128_intdigest(part, seed=lft)
                    c1.append(h >> 64)
                    c2.append(h & 0xFFFFFFFFFFFFFFFF)
                    parts.append(part if bytes_once.new(h) else None)
                longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (c1, c2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[mine]), *longs, pa.array([keys[i] for i in text[mine]], pa.binary()),
                     pa.array((at + shift)[mine]), pa.array(left.astype(np.int32)), pa.array(full.astype(np.int32)),
                     pa.array(parts, pa.binary())],
                    ["anchor", "c1", "c2", "key", "place", "left", "size", "context"])

    return map_rows(rows.select("key", "text"), run, CONTEXTS)


def refine(parts: list[bytes], left: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """Repeated intervals of aligned contexts, relative to their anchors, by interleave refinement.

    ``parts[i]`` has its anchor at ``left[i]``. ``order`` is the interleave: contexts by their symbols up to the
    column, the last one first in weight. ``common[j]`` is how many symbols before the
    column the neighbours order[j - 1] and order[j] share.
    """
    m = len(parts)
    lengths = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(lengths) - lengths
    symbols = np.frombuffer(b"".join(parts), np.uint8)
    order, common = np.arange(m), np.zeros(m, np.int32)
    first, last = -int(left.max()), int((lengths - left).max())
    none = first - size - 1
    open_at = np.full(m, none, np.int64)  # the interval of each context that still grows
    open_to = np.full(m, none, np.int64)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for column in range(first, last):
        inside = left + column
        there = (inside >= 0) & (inside < lengths)
        symbol = np.full(m, 256, np.uint16)  # 256: no symbol, equal to none
        symbol[there] = symbols[(begins + inside)[there]]
        dealt = symbol[order]
        step = np.argsort(dealt, kind="stable")
        new = dealt[step]
        same = np.zeros(m, bool)
        same[1:] = (new[1:] == new[:-1]) & (new[1:] != 256)
        which = np.flatnonzero(same)
        grown = np.zeros(m, np.int32)
        if len(which):
            a, b = step[which - 1] + 1, step[which]
            near = a == b
            value = common[b]
            if not near.all():
                far = np.flatnonzero(~near)
                edges = np.empty(2 * len(far), np.int64)
                edges[0::2], edges[1::2] = a[far], b[far] + 1
                value[far] = np.minimum.reduceat(np.append(common, 0), edges)[0::2]
            grown[which] = value + 1
        order, common = order[step], grown
        long_ = common >= size
        if long_.any():
            both = long_.copy()
            both[:-1] |= long_[1:]
            rows = order[both]
            start = column + 1 - size
            for i in rows[open_to[rows] < start].tolist():  # apart from the interval before
                if open_to[i] > none:
                    found[i].append((int(open_at[i]), int(open_to[i])))
                open_at[i] = start
            open_to[rows] = column + 1
    for i in np.flatnonzero(open_to > none).tolist():
        found[i].append((int(open_at[i]), int(open_to[i])))
    return found


def repeated_intervals(table: DataFrame, size: int) -> DataFrame:
    """(anchor, c1, c2, spans) of contexts that share a window with another context of their anchor."""

    def solve(group_rows):
        parts = [r[3] for r in group_rows]
        left = np.array([r[4] for r in group_rows], np.int64)
        out = [(r[0], r[1], r[2], [{"start": a, "end": b} for a, b in spans])
               for r, spans in zip(group_rows, refine(parts, left, size)) if spans]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "c1", "c2", "spans"])

    def run(batches):
        waiting, group = [], []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "context", "left"))):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        waiting += group
                    group = []
                    if len(waiting) >= BLOCK:
                        yield solve(waiting)
                        waiting = []
                if not group or row[1:3] != group[-1][1:3]:
                    group.append(row)
        if len(group) > 1:
            waiting += group
        if waiting:
            yield solve(waiting)

    rows = (table.where("context is not null").select("anchor", "c1", "c2", "context", "left")
            .repartition("anchor").sortWithinPartitions("anchor", "c1", "c2"))
    return map_rows(rows, run, "anchor long, c1 long, c2 long, spans array<struct<start: long, end: long>>")


def window_rows(table: DataFrame, size: int, held: KeyFilter | None = None) -> DataFrame:
    """(w1, w2, anchor, c1, c2, start) of every window of the contexts, the start relative to the anchor."""

    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("context", "left", "anchor", "c1", "c2"))))
            for at in range(0, len(rows), max(1, WINDOWS // size)):
                some = rows[at:at + max(1, WINDOWS // size)]
                hashes = b"".join(xxhash.xxh3_128_digest(part[i:i + size])
                                  for part, *_ in some for i in range(len(part) - size + 1))
                w1, w2 = np.frombuffer(hashes, "<i8").reshape(-1, 2).T
                counts = np.array([len(r[0]) - size + 1 for r in some], np.int64)
                inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                left, anchor, c1, c2 = (np.repeat(np.array(x, np.int64), counts) for x in list(zip(*some))[1:])
                columns = [np.ascontiguousarray(x) for x in (w1, w2, anchor, c1, c2, inside - left)]
                if held is not None:
                    keep = held.holds(columns[0])
                    columns = [x[keep] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["w1", "w2", "anchor", "c1", "c2", "start"])

    return map_rows(table.where("context is not null").select("anchor", "c1", "c2", "context", "left"), run,
                    "w1 long, w2 long, anchor long, c1 long, c2 long, start long")


def window_intervals(table: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """``repeated_intervals`` for anchors of any number of contexts, by hashes of their windows."""
    shared = scratch.put(window_rows(table, size).groupBy("w1", "w2")
                         .agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("c1", "c2")))
                         .where("min_c1 < max_c1 or min_c2 < max_c2").select("w1", "w2"))
    found = (window_rows(table, size, KeyFilter(shared, "w1")).join(shared, ["w1", "w2"])
             .groupBy("anchor", "c1", "c2").agg(F.collect_set("start").alias("starts")))

    def run(batches):
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merge_spans([(x, x + size) for x in starts])]
                     for starts in batch.column("starts").to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor", "c1", "c2")), pa.array(spans, kind)],
                                             ["anchor", "c1", "c2", "spans"])

    return map_rows(found, run, "anchor long, c1 long, c2 long, spans array<struct<start: long, end: long>>")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_texts(texts: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept) from text and spans."""

    def run(batches):
        for batch in batches:
            out = []
            for key, text, spans in zip(batch.column("key").to_pylist(), blobs(batch.column("text")),
                                        batch.column("spans").to_pylist()):
                spans = merge_spans([(s["start"], s["end"]) for s in spans])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out.append((key, sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_removed", "n_spans", "kept_sha256"])

    return map_rows(texts, run, "key binary, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(docs: DataFrame, scratch: Scratch, size: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(texts with copies: key), (key, spans) of the other texts that lose bytes."""
    rows = docs.select(text_key(F.col("text")).alias("key"), "text")
    copies = scratch.put(rows.where(F.octet_length("text") >= size).groupBy("key")
                         .agg(F.count("*").alias("n")).where("n > 1").select("key"))
    repeated = scratch.put(anchor_places(rows, size, gram).groupBy("anchor")
                           .agg(F.min("occurrence").alias("lo"), F.max("occurrence").alias("hi"))
                           .where("lo < hi").select("anchor"))
    found = scratch.put(contexts(rows, KeyFilter(repeated, "anchor"), size, gram))
    place = F.struct("key", "place")
    kinds = (found.groupBy("anchor", "c1", "c2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
             .select("anchor", "c1", "c2", (F.col("lo") < F.col("hi")).alias("whole")))
    hot = scratch.put(found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("anchor"))
    if hot.isEmpty():
        solved = scratch.put(repeated_intervals(found, size))
    else:
        solved = scratch.put(repeated_intervals(found.join(hot, "anchor", "left_anti"), size)
                             .union(window_intervals(found.join(hot, "anchor", "left_semi"), scratch, size)))
    outcome = scratch.put(kinds.join(solved, ["anchor", "c1", "c2"], "left").where("whole or spans is not null"))
    places = (found.select("anchor", "c1", "c2", "key", "place", "left", "size")
              .join(copies, "key", "left_anti").join(outcome, ["anchor", "c1", "c2"]))
    whole = F.array(F.struct((F.col("place") - F.col("left")).alias("start"),
                             (F.col("place") - F.col("left") + F.col("size")).alias("end")))
    parts = F.transform("spans", lambda s: F.struct((s["start"] + F.col("place")).alias("start"),
                                                    (s["end"] + F.col("place")).alias("end")))
    spans = (places.select("key", F.explode(F.when(F.col("whole"), whole).otherwise(parts)).alias("span"))
             .groupBy("key").agg(F.collect_set("span").alias("spans")))
    return copies, scratch.put(spans)


def remove_repeats(docs: DataFrame, size: int = 400, gram: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    if size < gram:
        raise ValueError("a window must hold a gram")
    scratch = Scratch(docs.sparkSession, "repeats")
    copies, spans = repeated_spans(docs, scratch, size, gram)
    short = F.xxhash64("key").alias("short")
    rows = docs.select(text_key(F.col("text")).alias("key"), "text").withColumn("short", F.xxhash64("key"))
    texts = only_held(rows, KeyFilter(spans.select(short), "short"), "short")
    cut = scratch.put(cut_texts(texts.join(spans, "key").select("key", "text", "spans")))
    empty = hashlib.sha256(b"").hexdigest()
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"), text_bytes(F.col("text")).alias("n_bytes"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("own_sha256"))
    gone = F.col("copied").isNotNull()
    return (own.join(copies.withColumn("copied", F.lit(True)), "key", "left").join(cut, "key", "left")
            .select("doc_id", "n_bytes",
                    F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256")))
