"""Histogram trees (M1, M2): growing trees from binned features.

The numpy part, which runs inside Spark tasks. Features are binned once by quantiles; a tree is grown level by level for all
open nodes at once from histograms over (node, bin). The target is taken as whole numbers below 2^20, so that one
histogram of packed numbers (count * 2^36 + sum) carries count and sum exactly, in any order of the rows: a repeated task, another
partitioning or a distributed level give the same tree. ``operators.ensembles`` has the Spark part.

A tree is a dict of arrays over its nodes (the root first): ``feature`` (-1 in a leaf), ``bin`` (rows at or below it go left),
``left`` (the right child is the next one), ``value`` (mean target) and ``gain`` (decrease of the squared error).
"""

from __future__ import annotations

import numpy as np

BINS = 32
LEVELS = 1 << 20  # whole numbers that stand for the target
COUNT = float(1 << 36)  # one row in a packed sum
LIMIT = 1 << 16  # rows (with repetitions) of a packed histogram

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040]))  # P(X <= k), mean 1


def uniforms(rows: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Numbers in [0, 1) that hang on row, seed and stream alone."""
    x = rows.astype(np.uint64) * _A + np.uint64(((seed * 1_000_003 + stream + 1) * int(_B)) % (1 << 64))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _B
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def bootstrap(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a row is in the tree's sample: Poisson with mean 1, the limit of drawing n of n."""
    return np.searchsorted(_POISSON, uniforms(rows, seed, tree), "right")


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, "left").astype(np.uint8)


def whole(y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(whole numbers below LEVELS, low, step) with y ~ low + step * number."""
    low, high = float(y.min()), float(y.max())
    if high - low < LEVELS and (y == np.rint(y)).all():
        return y - low, low, 1.0
    step = (high - low) / (LEVELS - 1) or 1.0
    return np.rint((y - low) / step), low, step


class Level:
    """The histograms of a level's open nodes, by feature. Where that is less work, only the rows of the smaller child of every
    pair are counted, and the larger one is what is left of the parent."""

    def __init__(self, columns: np.ndarray, bins: int):
        self.columns, self.bins, self.kept = columns, bins, None

    def best_splits(self, node: np.ndarray, rows: np.ndarray, packed: np.ndarray, able: np.ndarray, parents):
        """(gain, feature, bin) of the best split of every able node; feature -1 without one. The first of equal gains counts.

        ``parents``: place of every pair's parent among the able nodes of the level before, None for the root.
        """
        bins, nodes = self.bins, int(able.sum())
        best, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        less = self.kept is not None
        if less:
            size = np.bincount(node, minlength=len(able))
            counted = np.zeros(len(able), bool)
            counted[2 * np.arange(len(parents)) + (size[1::2] < size[::2])] = True
            live = np.flatnonzero(counted[node])
            base = node[live] // 2 * bins
        else:
            live = np.flatnonzero(able[node])
            base = (np.cumsum(able) - 1)[node[live]] * bins
        keep = [] if 4 * nodes * bins < len(rows) else None  # worth keeping for the next level
        rows, packed = rows[live], packed[live]
        for f, column in enumerate(self.columns):
            if less:
                small = np.bincount(base + column.take(rows), packed, len(parents) * bins).reshape(-1, bins)
                every = np.empty((2 * len(parents), bins))
                every[counted], every[~counted] = small, self.kept[f][parents] - small
                part = every[able]
            else:
                part = np.bincount(base + column.take(rows), packed, nodes * bins).reshape(nodes, bins)
            if keep is not None:
                keep.append(part)
            gain, at = split_gains(part)
            better = gain > best
            best[better], feature[better], cut[better] = gain[better], f, at[better]
        self.kept = keep
        return best, feature, cut


def split_gains(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, bin) of the best cut of one feature in every node; ``part``: packed sums by (node, bin)."""
    below = np.cumsum(part, axis=1)
    total = below[:, -1:].copy()
    below = below[:, :-1]
    count, n = np.floor(below * (1 / COUNT)), np.floor(total * (1 / COUNT))
    mean = (total - n * COUNT) / np.maximum(n, 1)
    off = below - count * COUNT  # the sum left of the cut, exact
    off -= count * mean  # less what the node's mean would give
    off *= off
    count *= n - count
    gain = np.divide(off, count, out=np.zeros_like(off), where=count > 0)
    at = gain.argmax(axis=1)
    gain = gain[np.arange(len(gain)), at] * n[:, 0]
    return np.where(gain > 1e-2, gain, 0.0), at  # below one hundredth of a whole number squared it is rounding


def grow(columns: np.ndarray, target: np.ndarray, weight: np.ndarray, max_depth: int, min_split: int = 2,
         bins: int = BINS) -> dict[str, np.ndarray]:
    """A tree over rows (``columns``: uint8 by feature and row, ``target``: whole numbers, ``weight``: repetitions)."""
    rows = np.flatnonzero(weight)
    packed = weight[rows] * (COUNT + target[rows])
    if weight.sum() > LIMIT:
        raise ValueError(f"more than {LIMIT} rows in one group")
    node, total = np.zeros(len(rows), np.int64), np.array([packed.sum()])
    levels = {k: [] for k in ("feature", "bin", "left", "value", "gain")}
    made, level, parents = 1, Level(columns, bins), None
    for depth in range(max_depth + 1):
        nodes = len(total)
        n = np.floor(total / COUNT)
        value = np.where(n > 0, (total - n * COUNT) / np.maximum(n, 1), 0.0)
        feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        gain, left = np.zeros(nodes), np.full(nodes, -1)
        able = (np.bincount(node, minlength=nodes) >= max(min_split, 2)) & (depth < max_depth)
        which = np.flatnonzero(able)
        g, f, b = level.best_splits(node, rows, packed, able, parents)
        good = f >= 0
        split = which[good]
        feature[split], cut[split], gain[split] = f[good], b[good], g[good]
        left[split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        for k, v in zip(levels, (feature, cut, left, value, gain)):
            levels[k].append(v)
        if not len(split):
            break
        number = np.full(nodes, -1)
        number[split] = np.arange(len(split))
        node = number[node]
        live = np.flatnonzero(node >= 0)  # rows of leaves leave
        rows, packed, node = rows[live], packed[live], node[live]
        f, b = f[good], b[good]
        node = 2 * node + (columns[f[node], rows] > b[node])
        total, parents = np.bincount(node, packed, 2 * len(split)), np.flatnonzero(good)
    return {k: np.concatenate(v) for k, v in levels.items()}


def leaves(tree: dict[str, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """The node in which every row ends."""
    at = np.zeros(columns.shape[1], np.int64)
    live = np.flatnonzero(tree["feature"][at] >= 0)
    while len(live):
        here = at[live]
        right = columns[tree["feature"][here], live] > tree["bin"][here]
        at[live] = tree["left"][here] + right
        live = live[tree["feature"][at[live]] >= 0]
    return at


def importance(tree: dict[str, np.ndarray], features: int) -> np.ndarray:
    """Decrease in squared error by feature (zeros for a lone leaf)."""
    own = tree["feature"] >= 0
    return np.bincount(tree["feature"][own], tree["gain"][own], features)


def forest_trees(columns: np.ndarray, y: np.ndarray, rows: np.ndarray, trees, max_depth: int, min_split: int, seed: int,
                 sampled: bool = True):
    """The trees with the numbers ``trees`` of a forest (all rows for each, if not ``sampled``); values on the scale of y."""
    target, low, step = whole(y)
    for t in trees:
        weight = bootstrap(rows, seed, t) if sampled else np.ones(len(rows), np.int64)
        tree = grow(columns, target, weight, max_depth, min_split)
        tree["value"] = low + step * tree["value"]
        tree["gain"] *= step * step
        yield t, tree


def boosted_trees(columns: np.ndarray, y: np.ndarray, rows: np.ndarray, rounds: int, max_depth: int, rate: float,
                  subsample: float, seed: int):
    """The rounds of a boosted ensemble for squared error: tree -1 is the mean, values have the rate in them."""
    mean = float(y.mean())
    yield -1, leaf(mean)
    now = np.full(len(y), mean)
    for t in range(rounds):
        target, low, step = whole(y - now)
        weight = (uniforms(rows, seed, t) < subsample).astype(np.int64)
        tree = grow(columns, target, weight, max_depth)
        tree["value"] = rate * (low + step * tree["value"])
        tree["gain"] *= step * step
        now += tree["value"][leaves(tree, columns)]
        yield t, tree


def leaf(value: float) -> dict[str, np.ndarray]:
    return {"feature": np.array([-1]), "bin": np.array([0]), "left": np.array([-1]), "value": np.array([value]),
            "gain": np.array([0.0])}
