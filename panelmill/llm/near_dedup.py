"""MinHash near-duplicate detection with fast similarity sketching (operator 7).

A document's set: the distinct ``k``-word shingles of its ASCII-lower-cased text (words are
runs without ASCII white space; fewer than ``k`` words are one shingle). One pass makes set size, set
identity and a sketch of ``t`` coordinates, filled by rounds of hashed bin placement. Equal sets
become one node, so a hot group of copies is one row from there on. Bands of ``rows`` coordinates
give candidate pairs, which are confirmed on the full word sets; components come from
distributed union-find (see ``linking``). At similarity 0.85, 16 bands of 4 miss a link with
probability 8e-6, at 0.8 with 2e-4.

Nodes are the first 64 bits of a 128-bit hash of the sorted shingle hashes.

Null, empty or all-white texts have an empty set, are linked with nothing and are their own
component. Repeated rows (same doc_id, same set) are one document and share one answer.
A null doc_id is no candidate for the smallest one; a component of null ids has a null
id and keeps its rows. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import KeyFilter, Scratch, blobs, map_rows, only_held, text_key
from panelmill.llm.linking import bucket_members, link
from panelmill.llm.sketching import WordHashes, bands, fast_sketch, word_shingles

_WORDS = WordHashes()  # per worker process


def words(text: bytes) -> list[bytes]:
    """bytes.lower is A-Z only, bytes.split is the six ASCII white-space characters."""
    return text.lower().split()


def sketches(docs: DataFrame, k: int, t: int, rows: int) -> DataFrame:
    """doc_id, text key, n_shingles, node, band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [word_shingles(_WORDS.of(words(text)), k) for text in blobs(batch.column("text"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            keys = bands(fast_sketch(elements, owner, len(sets), t), rows)
            node = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) >> 64 for s in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (t // rows)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes), pa.array(node), lists],
                ["doc_id", "key", "n_shingles", "node", "bands"])

    return map_rows(docs.select("doc_id", "text", text_key(F.col("text")).alias("key")), run,
                    f"doc_id {kind}, key binary, n_shingles long, node long, bands array<long>")


def shingle_set(text: bytes, k: int) -> set:
    """The full set: word tuples. Callers give texts with words."""
    own = words(text)
    return set(zip(*(own[i:] for i in range(k)))) if len(own) >= k else {tuple(own)}


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, t: int = 64, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text key: one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    out = scratch.put(grouped(docs, scratch, k, percent, t, rows).drop("root"))
    scratch.keep_only(out)
    return out


def grouped(docs: DataFrame, scratch: Scratch, k: int, percent: int, t: int = 64, rows: int = 4) -> DataFrame:
    """``near_duplicates`` with the component's root; reads scratch tables."""
    all_rows = scratch.put(sketches(docs, k, t, rows))
    some = all_rows.where("n_shingles > 0")
    nodes = some.groupBy("node").agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    members = bucket_members(nodes.select(F.explode("bands").alias("band"), "node", "size"), scratch)
    wanted = scratch.put(some.join(members.select("node").distinct(), "node", "left_semi")
                         .groupBy("node").agg(F.min(F.struct("key", "doc_id")).alias("one"))
                         .select("node", F.col("one.key").alias("key"), F.col("one.doc_id").alias("doc_id")))
    short = F.xxhash64("key", "doc_id").alias("short")  # of copies only the wanted one moves
    source = only_held(docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("payload"))
                       .withColumn("short", F.xxhash64("key", "doc_id")),
                       KeyFilter(wanted.select(short), "short"), "short")

    def texts(families: DataFrame) -> DataFrame:
        return (wanted.join(source, (wanted["key"] == source["key"]) & wanted["doc_id"].eqNullSafe(source["doc_id"]))
                .select("node", "payload").dropDuplicates(["node"]).join(families, "node"))

    labels = link(members, texts, partial(shingle_set, k=k), percent, scratch)
    named = all_rows.select("doc_id", "n_shingles", "node", "key")
    named = named.withColumn("root", F.col("node")) if labels is None else (
        named.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = (named.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")))
    out = named.join(least, "root", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "key", "root")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: one document of each group stays, columns unchanged.

    It is the one with the least doc_id (null last), then the least key of its text; of rows that share both, any one.
    Documents without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    found = scratch.put(grouped(docs, scratch, k, percent).where("n_shingles > 0").select("doc_id", "key", "root"))
    scratch.keep_only(found)
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = found.groupBy("root").agg(F.min(at).alias("first"))
    counts = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")).join(first, "root")
    stays = at.eqNullSafe(F.col("first"))
    marked = scratch.put(counts.where(~stays | (F.col("n") > 1)).select(
        F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key"), stays.alias("_again")))
    scratch.keep_only(marked)
    own = docs.withColumn("_own_key", text_key(F.col("text")))
    same = own["doc_id"].eqNullSafe(marked["_gone_id"]) & (own["_own_key"] == marked["_gone_key"])
    again = own.join(marked.where("_again"), same)  # rows that are chosen and repeated: one of them
    once = again.groupBy("_gone_id", "_gone_key").agg(F.first(F.struct(*[own[c] for c in docs.columns])).alias("_row"))
    return own.join(marked, same, "left_anti").select(*docs.columns).union(once.select("_row.*"))
