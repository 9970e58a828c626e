"""Importance resampling of documents towards a target distribution (operator 13).

Features are runs of 1 to ``ngrams`` words, hashed to buckets by CRC-32. Bucket counts over all documents (raw) and over
all target texts give every bucket a log ratio, the gain; a document's weight is the mean gain of its features. Gumbel
noise from a hash of the id makes the highest scores a draw without replacement in proportion to exp(weight).

CRCs are taken for a whole batch at once: words and runs are encoded as numbers, so that every distinct feature is hashed
once; the distinct features are grouped by equal length into two-dimensional uint8 matrices, all CRCs of a matrix are
updated column by column, and the buckets are scattered back to the occurrences.

Spark counts buckets with one row per task and bucket, adds them up, and sends the model, one number per bucket, to the
tasks. Ranks come from range partitions (``positions.ranked``), never from one sorted task. Texts above ``PIECE`` bytes
are cut between words, and a piece begins with the last words of the one before, so no run is lost or counted twice.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as an empty one and comes last
among ties; rows with one id are documents of their own; repeated rows with equal scores take consecutive ranks; without
eligible documents no rank is given; an empty target gives gains against equal pseudo-counts; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch, blobs, map_rows
from panelmill.llm.positions import ranked

PIECE = 4 << 20  # bytes that are handled at once
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected

#: Bytes of a text as those of its words: A-Z as a-z; separators, the other bytes of ASCII than digits and letters, as 0.
_BYTE = np.arange(256)
_LETTER = (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 48) & (_BYTE <= 57) | (_BYTE >= 128)
WORD_BYTES = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, np.where(_LETTER, _BYTE, 0)).astype(np.uint8)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


CRC = crc_table()


def crc_of_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a uint8 matrix."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC[(crc ^ column) & 255] ^ (crc >> 8)
    return ~crc


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def crc_of_features(features: pa.LargeBinaryArray) -> np.ndarray:
    """CRC-32 of distinct byte strings: a matrix for each length."""
    lengths = pc.binary_length(features).to_numpy(zero_copy_only=False)
    order = np.argsort(lengths, kind="stable")
    line = features.take(pa.array(order))
    _, offsets, data = line.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(line) + 1, 8 * line.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out = np.empty(len(line), np.uint32)
    cuts = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(line)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo < hi:
            width = int(lengths[order[lo]])
            out[order[lo:hi]] = crc_of_columns(data[offsets[lo]:offsets[hi]].reshape(hi - lo, width))
    return out


def features(texts: list[bytes], leads: list[int], ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, text number and bucket of every feature). The first ``lead`` words of a text were part of the
    piece before: runs within them are left out."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = WORD_BYTES[np.frombuffer(b"".join(texts), np.uint8)]
    inside = data != 0
    cut = np.zeros(len(data) + 1, bool)  # a text begins
    cut[starts] = True
    begins = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    owner = np.searchsorted(starts, begins, "right") - 1
    # empty texts share a start with the next one; the last text that starts there has the word
    words = binary(data[inside], ends - begins).dictionary_encode()
    first, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    lead = np.array(leads, np.int64)
    bucket_of = crc_of_features(first) % np.uint32(buckets)
    owners, found = [owner[place >= lead[owner]]], [bucket_of[code[place >= lead[owner]]]]
    run, known = code, first
    for k in range(2, ngrams + 1):
        n = max(len(code) - k + 1, 0)
        same = np.flatnonzero(owner[:n] == owner[k - 1:]) if n else np.empty(0, np.int64)
        pair, distinct = pd.factorize(run[same] * len(first) + code[same + k - 1])
        known = pc.binary_join_element_wise(known.take(pa.array(distinct // max(len(first), 1))),
                                            first.take(pa.array(distinct % max(len(first), 1))),
                                            pa.scalar(b" ", pa.large_binary()))
        run = np.zeros(n, np.int64)
        run[same] = pair
        use = place[same] + k - 1 >= lead[owner[same]]
        bucket_of = crc_of_features(known) % np.uint32(buckets)
        owners.append(owner[same][use])
        found.append(bucket_of[pair[use]])
    return count - np.minimum(lead, count), np.concatenate(owners), np.concatenate(found).astype(np.int64)


def pieces(text: bytes, ngrams: int, size: int) -> Iterator[tuple[bytes, int]]:
    """A text, or pieces of it with the number of words that each repeats from the one before."""
    lead, at = 0, 0
    while len(text) - at > size:
        end, words, gap = at + size, 0, True
        while end < len(text) and WORD_BYTES[text[end]]:
            end += 1
        yield text[at:end], lead
        back = end
        while back > at:  # the last ngrams - 1 words again
            here = WORD_BYTES[text[back - 1]] == 0
            if here and not gap:
                words += 1
            if words == ngrams - 1:
                break
            gap, back = here, back - 1
        if back == at:  # fewer words than a run has before: go on from the same place, all words known
            size = 2 * (end - at)
            lead = len(bytes(WORD_BYTES[np.frombuffer(text[at:end], np.uint8)]).replace(b"\0", b" ").split())
            continue
        at, lead = back, ngrams - 1
    yield text[at:], lead


def slices(texts: list[bytes], ngrams: int, size: int) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """(numbers, texts, leads) of about ``size`` bytes."""
    numbers, parts, leads, n = [], [], [], 0
    for i, text in enumerate(texts):
        for part, lead in pieces(text, ngrams, size):
            if parts and n + len(part) > size:
                yield numbers, parts, leads
                numbers, parts, leads, n = [], [], [], 0
            numbers.append(i)
            parts.append(part)
            leads.append(lead)
            n += len(part)
    if parts:
        yield numbers, parts, leads


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int, piece: int) -> DataFrame:
    """(bucket, n) over all texts."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, parts, leads in slices(blobs(batch.column("text")), ngrams, piece):
                total += np.bincount(features(parts, leads, ngrams, buckets)[2], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    return map_rows(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, ngrams: int, buckets: int, piece: int) -> DataFrame:
    """(bucket, gain) of the buckets with features: a thousand times the log ratio of smoothed shares."""
    both = (bucket_counts(docs, ngrams, buckets, piece).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .union(bucket_counts(target, ngrams, buckets, piece).select("bucket", F.lit(0).cast("long"), "n"))
            .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    both = Scratch(docs.sparkSession, "gains").put(both)
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(whole.s + buckets))) / ((s + 1) * F.lit(float(whole.t + buckets)))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, model: DataFrame, id_: str, ngrams: int, buckets: int, piece: int) -> DataFrame:
    """id, n_words, n_features, weight (the floored mean gain) of every document."""
    rows = model.toArrow()  # one row per bucket at most
    own = np.zeros(buckets, np.int64)
    own[rows.column("bucket").to_numpy()] = rows.column("gain").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(own)
    kind = docs.schema[id_].dataType.simpleString()

    def run(batches):
        gain = sent.value.astype(np.float64)  # sums of whole numbers far below 2^53 are exact
        for batch in batches:
            words, count, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for numbers, parts, leads in slices(blobs(batch.column("text")), ngrams, piece):
                n, owner, bucket = features(parts, leads, ngrams, buckets)
                numbers = np.array(numbers)
                np.add.at(words, numbers, n)
                np.add.at(count, numbers, np.bincount(owner, minlength=len(parts)))
                np.add.at(total, numbers, np.bincount(owner, gain[bucket], len(parts)).astype(np.int64))
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (words, count, weight))],
                                             names=["id", "n_words", "n_features", "weight"])

    return map_rows(docs.select(F.col(id_).alias("id"), "text"), run,
                    f"id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7,
             ngrams: int = 2, buckets: int = 10_000, id_: str = "doc_id", piece: int = PIECE) -> DataFrame:
    """Per document: id, n_features, weight, score, rank; ranks (from 1) mark the ``percent`` % of the documents with at
    least ``min_words`` words that are drawn, the others have null."""
    scratch = Scratch(docs.sparkSession, "resample")
    rows = weights(docs, gains(docs, target, ngrams, buckets, piece), id_, ngrams, buckets, piece)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    rows = scratch.put(rows.withColumn("score", F.col("weight") + noise))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    able = ranked(rows.where(F.col("n_words") >= min_words).withColumn("g", F.lit(0)), "g", order, scratch)
    drawn = F.col("pos") < F.expr(f"{percent} * n div 100")
    able = able.withColumn("rank", F.when(drawn, F.col("pos") + 1).cast("long"))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    own = [F.col("id").alias(id_), "n_features", "weight", "score", "rank"]
    return able.select(*own).union(rest.select(*own))
