"""Exact top-k search by inner product with dual cover trees (operator 2).

Vectors become integers floor(scale * x). Candidates are dealt to blocks by hash, queries to
query blocks; a cover tree is built over each block. A node has a centre, a covering radius and children whose centres
are more than half a scale apart; a node that shows no structure at its scale stays a leaf with
its points. Query and data tree are descended together. A node pair is pruned if the most that any
of its pairs can score, c_q c_x + |c_q| r_x + |c_x| r_q + r_q r_x, is below the worst kth score of the query
group so far. Leaf pairs are scored by one matrix product.

The query set is stated (ids divisible by ``every``), so its blocks are paired with the data blocks by an
equi-join on the block number; a task takes one query block through ``run`` data blocks and keeps the kth
scores on the way. Each task gives at most k rows per query; a window takes the best of them.

Many equal vectors are one point with their k + 1 least ids: no more can be among the best k of a query
(ties go to the smaller id, one may be the query itself), so nothing is lost.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
vec_id names a row: of rows with one id the least vector counts. Vectors are compared with those of
their own dimension. Scores beyond 2^63 are not defined. Other columns are ignored; empty tables give an empty
result; fewer than k candidates give all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.llm.common import Scratch, map_rows

EXACT = float(1 << 53)  # below this, a product of float64 matrices of integers is exact
NONE = np.iinfo(np.int64).min


class Node:
    """centre, covering radius, and either children or points (numbers of rows)."""

    __slots__ = ("centre", "norm", "radius", "children", "points")

    def __init__(self, centre, radius, points):
        self.centre, self.norm, self.radius = centre, float(np.sqrt(centre @ centre)), radius
        self.points, self.children = points, []


def cover_tree(vectors: np.ndarray, leaf: int = 256, tries: int = 64) -> Node:
    """A cover tree over the rows of ``vectors`` (float64)."""

    def build(points: np.ndarray, centre: np.ndarray) -> Node:
        away = np.sqrt(((vectors[points] - centre) ** 2).sum(axis=1))
        node = Node(centre, float(away.max()), points)
        if len(points) <= leaf or node.radius == 0:
            return node
        reach = 2.0 ** (np.ceil(np.log2(node.radius)) - 1)  # the next scale down
        groups, left, at = [], points, away
        while len(left):
            middle = vectors[left[int(at.argmin())]]  # nested: the centre's own point first
            own = np.sqrt(((vectors[left] - middle) ** 2).sum(axis=1))
            near = own <= reach
            groups.append((left[near], middle))
            left, at = left[~near], at[~near]
            if len(groups) == tries and len(points) - len(left) < len(points) // 4:
                return node  # hardly anything is near anything at this scale
        if len(groups) > len(points) // 4:
            return node
        node.children = [build(p, c) for p, c in groups]
        return node

    return build(np.arange(len(vectors)), vectors[0])


class Best:
    """The best k (score, id) of every query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def worst(self, rows: np.ndarray) -> float:
        least = self.score[rows, -1].min()
        return -np.inf if least == NONE else float(least)

    def take(self, rows: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        """Merge scores (rows x candidates) with the candidates' ids (NONE: no candidate)."""
        hold = (scores >= self.score[rows, -1][:, None]) & (scores != NONE)
        for i in np.flatnonzero(hold.any(axis=1)).tolist():
            own = np.flatnonzero(hold[i])
            s = np.concatenate([self.score[rows[i]], scores[i, own]])
            f = np.concatenate([self.found[rows[i]], found[own]])
            best = np.lexsort((f, ~s))[:self.k]
            self.score[rows[i]], self.found[rows[i]] = s[best], f[best]


def search(queries: np.ndarray, tree_q: Node, data: np.ndarray, tree_x: Node, owners: np.ndarray, ids: np.ndarray,
           exact: bool, best: Best) -> None:
    """Descend both trees; ``owners`` and ``ids`` list the ids of the data rows (a row may have several)."""
    first = np.searchsorted(owners, np.arange(len(data) + 1))
    whole_q, whole_x = queries, data
    if not exact:
        whole_q, whole_x = queries.astype(np.int64), data.astype(np.int64)

    def bound(q: Node, x: Node) -> float:
        most = float(q.centre @ x.centre) + q.norm * x.radius + x.norm * q.radius + q.radius * x.radius
        return most + 1e-9 * abs(most) + 1e-6

    def descend(q: Node, x: Node, most: float) -> None:
        if most < best.worst(q.points):
            return
        if q.children and (not x.children or q.radius >= x.radius):
            for child in q.children:
                descend(child, x, bound(child, x))
            return
        if x.children:
            for most_, _, child in sorted(((bound(q, c), i, c) for i, c in enumerate(x.children)), key=lambda t: -t[0]):
                descend(q, child, most_)
            return
        for at in range(0, len(x.points), 4096):
            points = x.points[at:at + 4096]
            scores = (whole_q[q.points] @ whole_x[points].T).astype(np.int64)
            counts = first[points + 1] - first[points]
            spread = np.repeat(np.arange(len(points)), counts)
            found = ids[np.concatenate([np.arange(first[p], first[p + 1]) for p in points])]
            scores = scores[:, spread]
            scores[best.ids[q.points][:, None] == found[None, :]] = NONE
            best.take(q.points, scores, found)

    descend(tree_q, tree_x, bound(tree_q, tree_x))


def top_k(table: DataFrame, every: int = 20, k: int = 20, scale: int = 64, block: int = 8192, run: int = 4,
          id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest scores."""
    scratch = Scratch(table.sparkSession, "top-k")
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite)
            .select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")))
    rows = scratch.put(rows.distinct().withColumn("dim", F.size("v")))  # only equal rows are one
    same = Window.partitionBy("v").orderBy("id")
    points = (rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
              .groupBy("dim", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = rows.count()
    blocks = max(1, -(-n // block))
    points = points.withColumn("xb", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    asked = rows.where(F.col("id") % every == 0)
    asked_blocks = max(1, -(-n // every // block))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(asked_blocks)).cast("int"))
    # one row per block: its vectors as one array, so a pair of blocks is one row
    x_blocks = _blocks(points, "xb", "x")
    q_blocks = _blocks(asked.withColumn("ids", F.array("id")), "qb", "q")
    pairs = (x_blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))
             .join(q_blocks, ["dim", "qb"])
             .withColumn("turn", (F.col("xb") / run).cast("int"))
             .repartition("dim", "qb", "turn").sortWithinPartitions("dim", "qb", "turn", "xb"))

    def solve(batches):
        state, queries, tree = None, None, None

        def give():
            best = state[1]
            row, rank = np.nonzero(best.score > NONE)
            return pa.RecordBatch.from_arrays(
                [pa.array(best.ids[row]), pa.array(best.found[row, rank]),
                 pa.array(best.score[row, rank])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                name = (row["dim"], row["qb"], row["turn"])
                if state is None or state[0] != name:
                    if state is not None:
                        yield give()
                    queries = np.frombuffer(row["q"], "<i8").reshape(-1, row["dim"]).astype(np.float64)
                    state = (name, Best(np.frombuffer(row["q_ids"], "<i8"), k))
                    tree = cover_tree(queries)
                data = np.frombuffer(row["x"], "<i8").reshape(-1, row["dim"]).astype(np.float64)
                most = max(np.abs(data).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * max(row["dim"], 1)
                search(queries, tree, data, cover_tree(data), np.frombuffer(row["x_owner"], "<i8"),
                       np.frombuffer(row["x_ids"], "<i8"), most < EXACT, state[1])
        if state is not None:
            yield give()

    found = map_rows(pairs, solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _blocks(rows: DataFrame, number: str, name: str) -> DataFrame:
    """One row per block: vectors, owners and ids as little-endian 64-bit integers."""

    def pack(batches):
        group, rows_ = None, []

        def give():
            rows_.sort()
            owner = np.repeat(np.arange(len(rows_)), [len(r[1]) for r in rows_])
            return pa.RecordBatch.from_arrays(
                [pa.array([group[0]], pa.int32()), pa.array([group[1]], pa.int32()),
                 pa.array([np.array([r[0] for r in rows_], "<i8").tobytes()], pa.binary()),
                 pa.array([owner.astype("<i8").tobytes()], pa.binary()),
                 pa.array([np.array([i for r in rows_ for i in r[1]], "<i8").tobytes()], pa.binary())],
                ["dim", number, name, f"{name}_owner", f"{name}_ids"])

        for batch in batches:
            for dim, at, v, ids in zip(*(batch.column(c).to_pylist() for c in ("dim", number, "v", "ids"))):
                if group is not None and group != (dim, at):
                    yield give()
                    rows_.clear()
                group = (dim, at)
                rows_.append((v, ids))
        if group is not None:
            yield give()

    own = rows.select("dim", number, "v", "ids").repartition("dim", number).sortWithinPartitions("dim", number)
    return map_rows(own, pack, f"dim int, {number} int, {name} binary, {name}_owner binary, {name}_ids binary")
