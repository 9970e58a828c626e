"""Set hashes and the similarity sketch used by the near-duplicate operators.

``fast_sketch`` fills ``t`` coordinates in rounds. In each of the first ``t`` rounds every
element of a set is hashed to one coordinate with the value (round, hash), and the least value
of a coordinate stays. In round ``t + i`` all elements go to coordinate ``i``. So a round
never displaces an earlier one, every coordinate is filled after 2 t rounds, and the share of equal
coordinates of two sets estimates their Jaccard similarity as closely as independent MinHash
values would. Large sets fill up in one or two rounds.
"""

from __future__ import annotations

import numpy as np
import xxhash

from panelmill.llm.common import mix

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fast_sketch(elements: np.ndarray, owner: np.ndarray, n_sets: int, t: int) -> np.ndarray:
    """(n_sets, t) coordinates; ``elements`` are 64-bit hashes, ``owner`` their set. A set without elements stays empty."""
    if t & (t - 1):
        raise ValueError("t must be a power of two")
    out = np.full(n_sets * t, _EMPTY, np.uint64)
    grid = out.reshape(n_sets, t)
    mask, shift = np.uint64(t - 1), np.uint64(8)
    wanted = np.zeros(n_sets, bool)
    wanted[owner] = True
    for r in range(2 * t):
        if not len(elements):
            break
        # the elements are hashes already: the first round takes them as they are
        x = mix(elements + np.uint64((int(_STEP) * r) & 0xFFFFFFFFFFFFFFFF)) if r else elements
        at = (x & mask).astype(np.int64) if r < t else r - t
        np.minimum.at(out, owner * t + at, (np.uint64(r) << np.uint64(56)) | (x >> shift))
        wanted &= (grid == _EMPTY).any(axis=1)
        keep = wanted[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
    return grid


def bands(grid: np.ndarray, rows: int) -> np.ndarray:
    """(n_sets, t / rows) int64 keys of the bands of ``rows`` coordinates; the band number is part of a key."""
    n, t = grid.shape
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) + np.uint64(1), (n, t // rows)).copy()
    parts = grid.reshape(n, t // rows, rows)
    for r in range(rows):
        key = mix(key * _STEP + parts[:, :, r])
    return key.view(np.int64)


class WordHashes:
    """64-bit hashes of words, with a bounded memo."""

    def __init__(self, most: int = 200_000):
        self.memo, self.most = {}, most

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) + len(new) > self.most:
                memo.clear()
                new = set(words)
            memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def word_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a text of fewer than ``k`` words is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(k, n)
    h = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        h = mix(h * _STEP + hashes[j:n - size + 1 + j])
    return np.unique(h)
