"""Merkle manifest of a dataset by lag and lead windows (operator 11).

Every row is a leaf. Leaves of a group (``group``, here the language) stand in the order of their ids; while more than
one node remains, every ``fanout`` consecutive ones become the hash of their digests (the last run may be shorter, even
one node). What remains is the group's subroot, and the subroots in the order of their groups give the root likewise.

One level of a tree is one pair of window columns: nodes of level j stand in the rows of their first leaves, so the
siblings of a node are ``lag`` and ``lead`` at the fixed offsets o * fanout^j, masked by the node's slot in its run and
the run's length; the row of a run's first child hashes the parent. All rows of a node get its siblings by carrying them
forward from its first row.

Windows are cut: a block is ``fanout^k`` consecutive leaves (at most ``BLOCK``), whatever the group's size, so k levels
need one exchange and one sort of small pieces, and a group with most of the rows is many blocks. The heads of the blocks
are the leaves of the next round, about 4,096 times fewer. Then paths are joined downwards, block by block. Nothing is
collected but one number, the size of the largest group.

Defined results: a null column enters a leaf as "-"; a null group is the first one; null ids come first; rows with one id
are ordered by their leaves, so equal rows are interchangeable; a table of one row has its leaf as subroot and root and
the hash of nothing as proof; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch
from panelmill.llm.positions import ranked

BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Every field as "-" if null, else UTF-8 byte count, ":", value."""
    texts = [c.cast("string") for c in fields]
    return hashed(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                    for t in texts])


def levels_of(fanout: int, block: int) -> int:
    k = 1
    while fanout ** (k + 1) <= block:
        k += 1
    return k


def climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``levels`` levels over nodes (g, pos, n, h): adds ``block``, ``own`` (the siblings of those levels, as an array
    of runs from below) and ``head`` (the block's node above them)."""
    rows = nodes.withColumn("block", F.expr(f"pos div {fanout ** levels}"))
    line = Window.partitionBy("g", "block").orderBy("pos")
    up, runs = "h", []
    for j in range(levels):
        step = fanout ** j
        node = F.expr(f"pos div {step}")
        slot = F.pmod(node, F.lit(fanout))
        nodes_here = F.expr(f"(n + {step - 1}) div {step}")
        rows = rows.withColumns({f"_lag{o}": F.lag(up, o * step).over(line) for o in range(1, fanout)}
                                | {f"_lead{o}": F.lead(up, o * step).over(line) for o in range(1, fanout)})
        before = [F.when(slot >= o, F.col(f"_lag{o}")).otherwise("") for o in range(fanout - 1, 0, -1)]
        after = [F.when((slot + o < fanout) & (node + o < nodes_here), F.col(f"_lead{o}")).otherwise("")
                 for o in range(1, fanout)]
        heads = (F.pmod(F.col("pos"), F.lit(step)) == 0) & (nodes_here > 1)
        run = F.struct(F.concat(*before).alias("before"), F.concat(*after).alias("after"))
        first = F.pmod(F.col("pos"), F.lit(step * fanout)) == 0
        parent = F.when(nodes_here > 1, hashed(F.col(up), *after)).otherwise(F.col(up))
        rows = (rows.withColumns({f"_run{j}": F.when(heads, run), f"_h{j + 1}": F.when(first, parent)})
                .drop(*[f"_{side}{o}" for side in ("lag", "lead") for o in range(1, fanout)],
                      *([up] if j else [])))
        up = f"_h{j + 1}"
        runs.append(f"_run{j}")
    carry = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({c: F.last(c, True).over(carry) for c in [*runs, up]})
    return (rows.withColumn("own", F.filter(F.array(*runs), lambda x: x.isNotNull()).cast(PATH))
            .withColumnRenamed(up, "head").drop(*runs))


def rounds(nodes: DataFrame, fanout: int, levels: int, scratch: Scratch) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The nodes of every round (the leaves first) with the levels they climb, and what remains of each group, as (g, h)."""
    out, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        k = 1
        while k < levels and fanout ** k < most:  # no more levels than the largest group has
            k += 1
        out.append((nodes, k))
        block = fanout ** k
        nodes = scratch.put(climb(nodes, fanout, k).where(F.pmod("pos", F.lit(block)) == 0)
                            .select("g", F.col("block").alias("pos"), F.col("head").alias("h"),
                                    F.expr(f"(n + {block - 1}) div {block}").alias("n")))
        most = -(-most // block)
        if most <= 1:
            return out, nodes.select("g", "h")


def paths(tables: list[tuple[DataFrame, int]], top: DataFrame, fanout: int, scratch: Scratch) -> DataFrame:
    """The leaves with the runs from each to the root. ``top``: (g, path, subroot, root) above the groups."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for i in range(len(tables) - 1, -1, -1):
        nodes, k = tables[i]
        rows = (climb(nodes, fanout, k).join(above, ["g", "block"])
                .withColumn("path", F.concat("own", "path")).drop("own", "head"))
        if i == 0:
            return rows
        above = scratch.put(rows.select("g", F.col("pos").alias("block"), "path", "subroot", "root"))


def proof_hash(path: Column) -> Column:
    return hashed(F.aggregate(path, F.lit(""), lambda a, x: F.concat(a, x["before"], x["after"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda a, x: hashed(x["before"], a, x["after"]))


def manifest(docs: DataFrame, id_: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
             fanout: int = 2, block: int = BLOCK, tampered: dict[str, Column] | None = None,
             where: Column | None = None) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    ``path`` has the siblings of every level. ``folded_root`` comes from the leaf whose columns are replaced by
    ``tampered`` in the rows of ``where``, with the original siblings.
    """
    scratch, k = Scratch(docs.sparkSession, "merkle"), levels_of(fanout, block)
    changed = leaf_hash([(tampered or {}).get(c, F.col(c)) for c in fields])
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    # an empty string for no group and "=" before the others: null first, then bytewise, and a plain join key
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_).alias("id"), g.alias("g"), leaf_hash([F.col(c) for c in fields]).alias("h"),
                         F.when(hit, changed).alias("other"))
    leaves = scratch.put(ranked(leaves, "g", [F.col("id").asc_nulls_first(), F.col("h").asc()], scratch))
    tables, subroots = rounds(leaves, fanout, k, scratch)
    whole = subroots.select(F.lit("").alias("g"), F.col("g").alias("own_g"), "h")
    whole = scratch.put(ranked(whole, "g", [F.col("own_g").asc()], scratch))
    over, root = rounds(whole, fanout, k, scratch)
    top = root.select("g", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"),
                      F.col("h").alias("root"))
    top = scratch.put(paths(over, top, fanout, scratch)
                      .select(F.col("own_g").alias("g"), "path", F.col("h").alias("subroot"), "root"))
    rows = paths(tables, top, fanout, scratch)
    rows = rows.select("id", "h", "subroot", "root", "path", F.coalesce("other", "h").alias("given"))
    out = rows.select(F.col("id").alias(id_), F.col("h").alias("leaf"), "subroot", "root",
                      proof_hash(F.col("path")).alias("proof_sha256"),
                      fold(F.col("given"), F.col("path")).alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def sevenths(id_: Column) -> Column:
    """Whether 7 divides the unsigned CRC-32 of an id in decimals."""
    return F.crc32(id_.cast("string").cast("binary")) % 7 == 0
