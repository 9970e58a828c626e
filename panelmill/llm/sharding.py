"""Sharding by best-fit-decreasing bin packing (operator 10).

Groups of equal texts are indivisible. Sorted by size, each enters the bin with the tightest
remaining capacity that still holds it, found in a balanced tree of the open bins; a new bin
opens only if none does. ``pack_fixed`` uses a given capacity and as few bins as that
gives; ``shard`` looks for the least capacity that needs no more than ``n`` bins.

At scale the groups themselves never reach the driver. A group of at least 1 / (n * ``fine``)
of all bytes is an item of its own (there are at most n * ``fine`` of them). All smaller
groups fall by the hash of their text into ``levels`` * ``buckets`` batches, each level 16 times
finer than the one before; a batch is an item, too. So the driver packs a bounded number of
items whatever the size of the table, and the finest batches level the bins out.

Rows find their shard without a shuffle (both maps are bounded and broadcast by Spark). Slots are
numbered from counts per (shard, hash bucket of doc_id), so no shard is numbered in one task.

A null text has size 1 like the empty text and is in its group; a null doc_id is kept;
repeated rows get a slot each; fewer groups than shards leave shards empty; an empty table
gives an empty result; other columns are ignored. A group larger than the rest together makes
its shard larger: groups are never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.llm.common import Scratch, text_bytes, text_key


class OpenBins:
    """Treap of (remaining capacity, bin): insert, and take the least that holds a size."""

    def __init__(self):
        self.root, self.seed = None, 88172645463325252

    def _priority(self) -> int:
        self.seed ^= (self.seed << 13) & 0xFFFFFFFFFFFFFFFF
        self.seed ^= self.seed >> 7
        self.seed ^= (self.seed << 17) & 0xFFFFFFFFFFFFFFFF
        return self.seed

    def _split(self, node, key):
        """(keys below ``key``, keys from ``key`` on)."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return (node[0], node[1], node[2], a), b
        a, b = self._split(node[2], key)
        return a, (node[0], node[1], b, node[3])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._join(a[3], b))
        return (b[0], b[1], self._join(a, b[2]), b[3])

    def insert(self, remaining: int, number: int) -> None:
        a, b = self._split(self.root, (remaining, number))
        self.root = self._join(self._join(a, ((remaining, number), self._priority(), None, None)), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (remaining, bin) with remaining >= size."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        least = b
        while least[2] is not None:
            least = least[2]
        _, b = self._split(b, (least[0][0], least[0][1] + 1))
        self.root = self._join(a, b)
        return least[0]


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size (given in decreasing order); None if more than ``most`` bins are needed."""
    bins, opened, out = OpenBins(), 0, []
    for size in sizes:
        got = bins.take(size)
        if got is None:
            if opened == most:
                return None
            got, opened = (capacity, opened), opened + 1
        out.append(got[1])
        bins.insert(got[0] - size, got[1])
    return out


def least_capacity(sizes: list[int], n: int) -> tuple[int, list[int]]:
    """A capacity near the least for which best-fit-decreasing needs at most ``n`` bins, and its bins."""
    low = max(-(-sum(sizes) // n), sizes[0])
    step, high = max(1, low >> 20), low
    while (bins := best_fit_decreasing(sizes, high, n)) is None:
        high, step = high + step, step * 4
    best = (high, bins)
    low -= 1
    while high - low > max(1, high >> 20):
        middle = (low + high) // 2
        if (bins := best_fit_decreasing(sizes, middle, n)) is None:
            low = middle
        else:
            high, best = middle, (middle, bins)
    return best


def _items(rows: DataFrame, total: int, parts: int, fine: int, buckets: int, levels: int):
    """(large groups with their bytes, rows with the batch of their group)."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    large = groups.where(F.col("bytes") * parts * fine >= total)
    return large, rows.withColumn("batch", batch_of(F.col("key"), buckets, levels))


def batch_of(key: Column, buckets: int, levels: int) -> Column:
    """The batch of a small group: 15/16 of the hashes are on level 0, 15/16 of the rest on level 1, and so on."""
    h = F.xxhash64(key)
    level = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        level = F.when(F.shiftright(h, 4 * k).bitwiseAND(15) != 0, F.lit(k)).otherwise(level)
    return (level * buckets + F.pmod(F.shiftrightunsigned(h, 4 * levels), F.lit(buckets))).cast("int")


def _plan(rows: DataFrame, parts: int, fine: int, buckets: int, levels: int, choose):
    """Rows with their bin; ``choose`` maps decreasing sizes to bins."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    large, rows = _items(rows, total, parts, fine, buckets, levels)
    big = [(bytes(r["key"]), r["bytes"]) for r in large.collect()]
    is_large = spark.createDataFrame([(k, True) for k, _ in big], "key binary, own boolean")
    rest = rows.join(F.broadcast(is_large), "key", "left")
    batches = rest.where("own is null").groupBy("batch").agg(F.sum("size").alias("bytes")).collect()
    items = sorted([(-b, 0, k) for k, b in big] + [(-r["bytes"], 1, r["batch"]) for r in batches])
    bins = choose([-i[0] for i in items]) if items else []
    own = [(i[2], b) for i, b in zip(items, bins) if i[1] == 0]
    shared = [(i[2], b) for i, b in zip(items, bins) if i[1] == 1]
    return (rows.join(F.broadcast(spark.createDataFrame(own, "key binary, own_bin int")), "key", "left")
            .join(F.broadcast(spark.createDataFrame(shared, "batch int, batch_bin int")), "batch", "left")
            .withColumn("shard", F.coalesce("own_bin", "batch_bin"))
            .drop("batch", "own_bin", "batch_bin"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", (text_bytes(F.col("text")) + 1).alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                       text_key(F.col("text")).alias("key"))


def numbered(rows: DataFrame, slot_buckets: int) -> DataFrame:
    """Slots gapless from 0 in every shard, from counts per (shard, bucket)."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(slot_buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    return (rows.withColumn("k", F.row_number().over(inside) - 1)
            .join(starts, ["shard", "bucket"])
            .withColumn("slot", F.col("first") + F.col("k")).drop("bucket", "first", "k"))


def shard(docs: DataFrame, n: int = 8, fine: int = 512, buckets: int = 1024, levels: int = 4,
          slot_buckets: int = 1024) -> DataFrame:
    """Rows in ``n`` shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.put(measured(docs))
    rows = _plan(rows, n, fine, buckets, levels, lambda sizes: least_capacity(sizes, n)[1])
    return numbered(rows, slot_buckets).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def pack_fixed(docs: DataFrame, capacity: int, fine: int = 512, buckets: int = 1024, levels: int = 4,
               slot_buckets: int = 1024) -> DataFrame:
    """Rows in as few shards of at most ``capacity`` bytes as best-fit-decreasing needs.

    A group larger than the capacity gets a shard of its own. The number of batches follows the
    number of shards, so a batch stays far below the capacity.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.put(measured(docs))
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // capacity))

    def choose(sizes):
        over = [s for s in sizes if s > capacity]
        return [*range(len(over)), *(b + len(over) for b in best_fit_decreasing(sizes[len(over):], capacity))]

    rows = _plan(rows, parts, fine, max(buckets, 128 * parts), levels, choose)
    return numbered(rows, slot_buckets).select("doc_id", "size", "text_crc32", "shard", "slot")
