"""From band keys to verified links to components, distributed and safe against hot buckets.

Members of a bucket (equal band key) are candidates; a family is what buckets connect. Pairs are never
listed, and no task or table holds all pairs of a group:

0. where an operator gives marks (a set's size and a bitmap with the parity of its hashes), families are first cut into
   what the marks can link: two sets differ in at least as many elements as their bitmaps in bits, so no pair that is
   similar enough is parted, and the full sets of most members need not move;
1. a family of at most ``BLOCK`` members (and ``BYTES`` of payload) is one group of one task: it takes the full
   sets, gets all intersection sizes by products of 0/1 matrices, and gives a spanning forest of the links;
2. in a larger family every member is compared with the head of its bucket (its least node). A hot head is
   salted: its members are compared in chunks, each with a copy of the head's data. A bucket is settled when
   its other members are all linked with one node; the members of the rest (bands with the same members make one
   bucket) meet in blocks of at most ``BLOCK`` x ``BLOCK``, solved like a small family.

So every candidate pair that is not already connected is decided on the full sets. Components come
from union-find steps over the links: every node hooks to its least smaller neighbour,
pointers are halved until flat, links between roots remain for the next step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch, map_rows

CHUNK = 256  # members of a head that are compared in one salted chunk
BLOCK = 1024  # members of a family in one group, or of one side of a block
BYTES = 32 << 20  # payload of them
LONG = BYTES // (2 * BLOCK)  # a payload of more bytes counts towards BYTES on its own
SMALL = 64  # so many pairs are intersected one by one
FEW = 12  # so many marks are compared one by one
MARK_BITS = 64, 1 << 16  # the least and the most bits of a mark
GATHERED = 1 << 19  # bytes of payload whose sets are made at once, but for a group that has more
COLUMNS = 8192  # columns of the 0/1 matrices that are multiplied at once

#: payload -> full set. With a function ``numbered`` (payloads -> their sets as sorted arrays of numbers, equal where the elements
#: are equal) the sets of whole groups are made at once.
Shingles = Callable[[bytes], set]


def components(links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, root) for every node that is not its component's least node; None without links."""
    edges = scratch.put(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a < b").distinct())
    scratch.release()
    labels = None
    while True:
        hook = scratch.put(edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node"))
        if hook.isEmpty():
            scratch.drop(edges, hook)
            return labels
        while True:  # pointer jumping
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            if hook.join(up, "root", "left_semi").isEmpty():
                break
            flat = scratch.put(hook.join(up, "root", "left")
                               .select("node", F.coalesce("above", "root").alias("root")))
            scratch.drop(hook)
            hook = flat
        scratch.release()
        before = labels
        if before is None:
            labels = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = scratch.put(before.join(up, "root", "left")
                                 .select("node", F.coalesce("above", "root").alias("root")).union(hook))
        to_a = hook.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
        to_b = hook.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
        moved = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(
            F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        rest = scratch.put(moved.where("a != b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(edges, before, None if hook is labels else hook)
        edges = rest
        if edges.isEmpty():
            scratch.drop(edges)
            return labels


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    members = members.drop("label")
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return (members.join(labels.withColumnRenamed("root", "label"), "node", "left")
            .withColumn("label", F.coalesce("label", "node")))


def salted(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """Pairs (a, b) with the ``payload`` of both sides as pa and pb; a hot ``a`` is dealt in chunks."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    heads = (counts.join(data.withColumnsRenamed({"node": "a", "payload": "pa"}), "a")
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("a", "chunk", "pa"))
    many = counts.where("chunks > 1")
    # ids first: the payload of b moves to its pairs and then once more to the head's chunk
    left = (pairs.join(many, "a", "left")
            .withColumn("chunk", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).cast("int"))
            .drop("chunks").join(data.withColumnsRenamed({"node": "b", "payload": "pb"}), "b"))
    return left.join(heads, ["a", "chunk"]).select("a", "b", "pa", "pb")


def confirm(pairs: DataFrame, data: DataFrame, shingles: Shingles, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        head, own = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "pa", "pb"))):
                if a != head:
                    head, own = a, shingles(x)
                other = shingles(y)
                both = len(own & other)
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(salted(pairs, data), run, "a long, b long")


def common(x: set | np.ndarray, y: set | np.ndarray) -> int:
    """The size of the intersection of two sets, or of two sorted arrays of different numbers."""
    if isinstance(x, set):
        return len(x & y)
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def intersections(left: list, right: list) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (or of arrays of different numbers)."""
    sets = left if left is right else left + right
    if isinstance(sets[0], set):
        number: dict = {}
        place = np.array([number.setdefault(x, len(number)) for s in sets for x in s], np.int64)
    else:
        place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = np.bincount(place) > 1  # elements that more than one set has
    column = (np.cumsum(many) - 1)[place]
    own = many[place]
    owner, column = owner[own], column[own]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(many.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        table = np.zeros((len(sets), min(COLUMNS, int(many.sum()) - at)), np.float32)
        table[owner[lo:hi], column[lo:hi] - at] = 1
        out += table[:len(left)] @ (table if left is right else table[len(left):]).T
    return out


def forest(nodes_a, labels_a, sets_a, nodes_b, labels_b, sets_b, percent: int) -> list[tuple[int, int]]:
    """Links between different labels that join them, at most one less than there are labels."""
    if len(sets_a) * len(sets_b) <= SMALL:
        parent: dict[int, int] = {}
        out = []

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for i, x in enumerate(sets_a):
            for j in range(i + 1 if sets_a is sets_b else 0, len(sets_b)):
                n, y = len(x), sets_b[j]
                if 100 * min(n, len(y)) < percent * max(n, len(y)) or (a := root(labels_a[i])) == (b := root(labels_b[j])):
                    continue
                both = common(x, y)
                if 100 * both >= percent * (n + len(y) - both):
                    parent[max(a, b)] = min(a, b)
                    out.append((nodes_a[i], nodes_b[j]))
        return out
    both = intersections(sets_a, sets_b)
    size_a = np.array([len(s) for s in sets_a], np.float32)[:, None]
    size_b = np.array([len(s) for s in sets_b], np.float32)[None, :]
    linked = 100 * both >= percent * (size_a + size_b - both)
    number = np.unique(np.array([*labels_a, *labels_b]), return_inverse=True)[1]
    label_a, label_b = number[:len(sets_a)], number[len(sets_a):]
    linked &= label_a[:, None] != label_b[None, :]
    i, j = np.nonzero(linked)
    n = int(number.max()) + 1
    link_of = np.full((n, n), -1, np.int32)  # a link between two labels
    link_of[label_a[i], label_b[j]] = link_of[label_b[j], label_a[i]] = np.arange(len(i))
    out, new = [], np.ones(n, bool)
    for first in range(n):
        stack = [first] if new[first] else []
        new[first] = False
        while stack:
            own = link_of[stack.pop()]
            met = np.flatnonzero(new & (own >= 0))
            new[met] = False
            stack += met.tolist()
            out += [(nodes_a[i[x]], nodes_b[j[x]]) for x in own[met].tolist()]
    return out


def mark_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the marks of sets: the least power of two that is not less than the size, within ``MARK_BITS``."""
    bits = np.full(len(sizes), MARK_BITS[0], np.int64)
    while (more := (bits < sizes) & (bits < MARK_BITS[1])).any():
        bits[more] *= 2
    return bits


def set_marks(hashes: np.ndarray, owner: np.ndarray, n_sets: int) -> tuple[np.ndarray, list[bytes]]:
    """(size, mark) of every set; ``hashes`` are 64-bit hashes of elements, ``owner`` their set."""
    # sorted as one number: the owner, then the last bits of the hash, so a mark does not depend on the other sets
    low = np.uint64(n_sets.bit_length())
    key = np.sort((owner.astype(np.uint64) << (np.uint64(64) - low)) | (hashes << low >> low))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    owner = (key >> (np.uint64(64) - low)).astype(np.int64)
    sizes = np.bincount(owner, minlength=n_sets)
    bits = mark_bits(sizes)
    ends = np.cumsum(bits)
    place = (ends - bits)[owner] + (key.view(np.int64) & (bits - 1)[owner])
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return sizes, [packed[(b - n) // 8:b // 8] for b, n in zip(ends.tolist(), bits.tolist())]


def alike_few(sizes: list[int], marks: list[bytes], percent: int) -> np.ndarray:
    """``alike`` pair by pair, with the marks as numbers."""
    label = list(range(len(sizes)))
    marks = [(int.from_bytes(m, "little"), 8 * len(m)) for m in marks]
    for j, (y, wide) in enumerate(marks):
        for i in range(j):
            a, b = sorted((sizes[i], sizes[j]))
            if label[i] == label[j] or 100 * a < percent * b:
                continue
            (x, bits), z = marks[i], y
            if bits > wide:
                x = x >> wide ^ x & (1 << wide) - 1
            elif bits < wide:
                z = y >> bits ^ y & (1 << bits) - 1
            if (100 + percent) * (x ^ z).bit_count() <= (100 - percent) * (a + b):
                own, other = sorted((label[i], label[j]))
                label = [own if x == other else x for x in label]
    return np.array(label, np.int64)


def alike(sizes: np.ndarray, marks: list[bytes], percent: int) -> np.ndarray:
    """A label for every set: sets whose marks leave it open that they are similar enough have one label.

    Sets share at most half of their sizes' sum less the bits in which their bitmaps differ. A longer
    bitmap is folded onto a shorter one; sets that differ too much in size are not compared.
    """
    if len(sizes) <= FEW:
        return alike_few(sizes.tolist(), marks, percent)
    order = np.argsort(sizes, kind="stable")
    n, marks = sizes[order], [marks[i] for i in order]
    bits = mark_bits(n)
    label = np.arange(len(n))
    ends = np.searchsorted(100 * n, n * 10_000 // percent, "right")  # n[i] >= percent / 100 * n[j] before the end
    for c in np.unique(bits).tolist():
        lo, hi = np.searchsorted(bits, [c, c + 1]).tolist()
        top = int(ends[lo:hi].max())
        table = np.frombuffer(b"".join(marks[lo:hi]), "<u8").reshape(hi - lo, -1)
        if top > hi:  # of twice the bits
            long_ = np.frombuffer(b"".join(marks[hi:top]), "<u8").reshape(top - hi, 2, -1)
            table = np.concatenate([table, long_[:, 0] ^ long_[:, 1]])
        for i in range(lo, hi):
            end = int(ends[i])
            if end <= i + 1:
                continue
            differ = np.bitwise_count(table[i + 1 - lo:end - lo] ^ table[i - lo]).sum(axis=1, dtype=np.int64)
            met = np.flatnonzero((100 + percent) * differ <= (100 - percent) * (n[i] + n[i + 1:end])) + i + 1
            for other in set(label[met].tolist()) - {int(label[i])}:
                a, b = sorted((other, int(label[i])))
                label[label == b] = a
    out = np.empty(len(n), np.int64)
    out[order] = order[label]
    return out


def alike_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join, within every group (column band) of ``rows``, what the marks leave open."""

    def solve(group):
        label = alike(np.array([r[2] for r in group], np.int64), [r[3] for r in group], percent)
        return [(group[j][1], group[i][1]) for i, j in enumerate(label.tolist()) if i != j]

    def run(batches):
        band, group = None, []
        for batch in batches:
            links = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("band", "node", "elements", "mark"))):
                if row[0] != band:
                    if len(group) > 1:
                        links += solve(group)
                    band, group = row[0], []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        if len(group) > 1:
            links = solve(group)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_rows(rows.select("band", "node", "elements", "mark").repartition("band").sortWithinPartitions("band", "node"),
                    run, "a long, b long")


def cut_families(members: DataFrame, data: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """The parts (node, root) of the families of ``data`` (node, root, elements, mark) that marks can link; None without any.

    A family of at most ``BLOCK`` nodes is one group. A larger one is cut bucket by bucket; a bucket of more
    nodes stays whole.
    """
    large = scratch.put(data.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("root"))
    links = scratch.put(alike_links(data.join(F.broadcast(large), "root", "left_anti").withColumnRenamed("root", "band"), percent))
    rest = one = buckets = None
    found = links
    if not large.isEmpty():
        own = data.join(F.broadcast(large), "root", "left_semi").select("node", "elements", "mark")
        rest = scratch.put(members.select("band", "node").join(own.select("node"), "node", "left_semi"))
        sizes = (rest.groupBy("band")
                 .agg(F.count("*").alias("n"), F.min("node").alias("head"), F.bit_xor(F.xxhash64("node")).alias("x"),
                      F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
                 .groupBy("n", "x", "y").agg(F.min("band").alias("band"), F.first("head").alias("head")))
        one = scratch.put(rest.join(sizes.select("band", "n", "head"), "band"))
        buckets = scratch.put(alike_links(one.where(F.col("n") <= BLOCK).select("band", "node").join(own, "node"), percent))
        found = links.union(buckets).union(one.where(F.col("n") > BLOCK).select(F.col("head").alias("a"), F.col("node").alias("b")))
    out = components(found, scratch)
    scratch.drop(large, links, rest, one, buckets)
    scratch.release()
    return out


def sized(rows: DataFrame, data: DataFrame, group: str) -> DataFrame:
    """(group, chunks): into how many chunks a group must be cut to keep within BLOCK and BYTES.

    BLOCK payloads of at most LONG bytes take half of BYTES, so only the rows of longer ones are joined with their bytes.
    """
    long = data.select("node", F.octet_length("payload").alias("bytes")).where(F.col("bytes") > LONG)
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    more = rows.join(long, "node").groupBy(group).agg(F.sum("bytes").alias("bytes"))
    return counts.join(more, group, "left").select(
        group, F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(2 * F.coalesce("bytes", F.lit(0)) / BYTES)).cast("int").alias("chunks"))


def block_links(open_: DataFrame, sizes: DataFrame, data: DataFrame, shingles: Shingles, percent: int) -> DataFrame:
    """Links between different labels within the groups (column band) of ``open_``, in blocks."""
    return solved((open_.join(sizes, "band").join(data, "node")
                   .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
                   .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                   .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))),
                  shingles, percent)


def solved(rows: DataFrame, shingles: Shingles, percent: int) -> DataFrame:
    """Links between different labels of the chunks i and j of every band."""
    rows = (rows.select("band", "i", "j", "chunk", "node", "label", "payload")
            .repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "chunk", "node"))

    numbered = getattr(shingles, "numbered", None)

    def sides(name, group):
        a = [r for r in group if r[0] == name[1]]
        b = a if name[1] == name[2] else [r for r in group if r[0] == name[2]]
        return (a, b) if a and b and len({r[2] for r in group}) > 1 else None

    def solve(groups):
        links = []
        groups = [x for x in (sides(*g) for g in groups) if x]
        every = iter(numbered([r[3] for a, b in groups for side in ((a,) if a is b else (a, b)) for r in side]) if numbered else ())
        for a, b in groups:
            sets = [[next(every) if numbered else shingles(r[3]) for r in side] for side in ((a,) if a is b else (a, b))]
            links += forest([r[1] for r in a], [r[2] for r in a], sets[0],
                            [r[1] for r in b], [r[2] for r in b], sets[-1], percent)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        name, group, groups, size = None, [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "chunk", "node", "label", "payload"))):
                if row[:3] != name:
                    if group:
                        groups.append((name, group))
                    if size >= GATHERED:
                        yield solve(groups)
                        groups, size = [], 0
                    name, group = row[:3], []
                group.append(row[3:])
                size += len(row[6])
        if group:
            yield solve([*groups, (name, group)])

    return map_rows(rows, run, "a long, b long")


def bucket_members(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (band, node, size) of the buckets with more than one node."""
    shared = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    return scratch.put(bands.join(shared.select("band"), "band"))


def large_family_links(members: DataFrame, data: DataFrame, shingles: Shingles, percent: int,
                       scratch: Scratch) -> DataFrame:
    """Verified links that connect what is connected within the buckets of ``members``."""
    heads = members.groupBy("band").agg(F.min(F.struct("node", "size")).alias("head"))
    fits = (F.least(F.col("size"), F.col("head.size"))
            >= F.greatest(F.col("size"), F.col("head.size")) * F.lit(percent / 100) - F.lit(1e-9))
    # the head meets every member of its bucket, so it leaves the bucket
    met = scratch.put(members.join(heads, "band").where(F.col("node") != F.col("head.node"))
                      .select("band", "node", F.col("head.node").alias("a"), fits.alias("fits")))
    pairs = scratch.put(met.where("fits").select("a", F.col("node").alias("b")).distinct())
    links = scratch.put(confirm(pairs, data, shingles, percent))
    # nodes with one label are linked with that node, so they need not be compared with each other
    labels = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    now = labelled(met.select("band", "node"), scratch.put(labels))
    buckets = (now.groupBy("band")
               .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"),
                    F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
               .where("lo < hi"))
    # bands with the same members make one bucket
    bands = buckets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
    open_ = scratch.put(now.join(bands, "band"))
    scratch.drop(met, pairs)
    scratch.release()
    return links.union(scratch.put(block_links(open_, sized(open_, data, "band"), data, shingles, percent)))


def link(members: DataFrame, texts: Callable[[DataFrame], DataFrame], shingles: Shingles, percent: int,
         scratch: Scratch, marks: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Components (node, root) of the verified candidate pairs of ``members``; None without links.

    ``texts`` gives (node, root, payload) for the families (node, root), so that payloads meet their family as they are
    gathered; ``shingles`` gives a payload's full set. ``size`` is a set's size (0: unknown): sets whose sizes differ by
    more than the similarity allows are not compared with a head. A column ``head`` names one node of the bucket. ``marks`` gives (node, root, elements, mark) for the
    families, which are then cut before their payloads are gathered.
    """
    named = members if "head" in members.columns else members.join(
        members.groupBy("band").agg(F.min("node").alias("head")), "band")
    families = components(named.select(F.col("head").alias("a"), F.col("node").alias("b")), scratch)
    members = members.drop("head")
    if families is not None and marks is not None:
        marked = scratch.put(marks(families.union(families.select("root", "root").distinct())))
        scratch.drop(families)
        families = cut_families(members, marked, percent, scratch)
        scratch.drop(marked)
    if families is None:
        return None
    every = scratch.put(families.union(families.select("root", "root").distinct()))
    scratch.drop(families)
    scratch.release()
    data = scratch.put(texts(every))
    scratch.drop(every)
    scratch.release()
    # a large family has more than BLOCK nodes or BYTES of payload, so there are few of them: their payloads are told map-side
    large = scratch.put(data.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
                        .where((F.col("n") > BLOCK) | (F.col("bytes") > BYTES)).select("root"))
    small = data.join(F.broadcast(large), "root", "left_anti")
    whole = F.lit(0)  # a small family is one chunk
    few = scratch.put(solved(small.select(F.col("root").alias("band"), whole.alias("i"), whole.alias("j"), whole.alias("chunk"),
                                          "node", F.col("node").alias("label"), "payload"), shingles, percent))
    scratch.release()
    links = few
    if not large.isEmpty():
        own = scratch.put(data.join(F.broadcast(large), "root", "left_semi"))
        scratch.drop(data)
        # the nodes of a bucket whose family was cut are buckets of their own
        rest = scratch.put(members.join(own.select("node", "root"), "node")
                           .withColumn("band", F.xxhash64("band", "root")).drop("root"))
        own = own.drop("root")
        links = scratch.put(few.union(large_family_links(rest, own, shingles, percent, scratch)))
        scratch.drop(own, rest)
    out = components(links, scratch)
    scratch.drop(data, large, few, links)
    scratch.release()
    return out
