"""Average linkage by chains of nearest neighbours over a condensed matrix, with the tree of merges kept (CL-1, CL-5, CL-6).

A chain goes from a cluster to its nearest one, from there to its nearest, and so on, until two are nearest to each other; these are joined,
and the chain goes on from what is left of it. Each merge costs a few rows of the matrix, so n members take time and memory in n squared. All
thresholds are cuts of one tree.

Distances are whole multiples of 1 / SCALE, and what is kept of two clusters is the sum over pairs of members, so that averages that are equal
compare as equal, whatever order their parts were joined in, while sums are below 2^53. Of equally near clusters the one with the smallest first member counts:
the merges are those of joining the nearest pair of all clusters again and again, ties by first members.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SCALE = 1 << 30
NEAR = 1e-8  # averages this far above a threshold still reach it: distances are rounded


def pair_index(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The place of each pair i < j in a condensed matrix of n members."""
    return i * (2 * n - i - 1) // 2 + j - i - 1


def condensed(square: np.ndarray) -> np.ndarray:
    return square[np.triu_indices(len(square), 1)]


@dataclass(frozen=True)
class MergeTree:
    """Of n members, each but the first joins a cluster of an earlier one once: into says which, height at what average distance."""

    into: np.ndarray
    height: np.ndarray

    def labels(self, threshold: float) -> np.ndarray:
        """Clusters 0, 1, ... in order of first members: what has been joined up to the threshold."""
        top = np.where(self.height <= threshold + NEAR, self.into, np.arange(len(self.into)))
        while not np.array_equal(top, above := top[top]):
            top = above
        return np.unique(top, return_inverse=True)[1]


def merge_tree(distance: np.ndarray, weight: np.ndarray) -> MergeTree:
    """The tree of a condensed matrix. A member of weight w stands for w equal ones, which would have been joined at distance 0."""
    n = len(weight)
    w, start = weight.astype(float), 0
    total = np.rint(distance * SCALE)
    for i in range(n - 1):
        total[start : (start := start + n - 1 - i)] *= w[i] * w[i + 1 :]
    return merge_sums(total, weight)


def merge_sums(total: np.ndarray, weight: np.ndarray) -> MergeTree:
    """The tree of a condensed matrix of sums over the pairs of what two members stand for, in 1 / SCALE; the matrix is written over."""
    n = len(weight)
    w, alive, every = weight.astype(float).copy(), np.ones(n, bool), np.arange(n)
    before = pair_index(n, every, 0) if n else every  # pair (k, i) is at before[k] + i
    into, height = every.copy(), np.full(n, np.inf)

    def row(i: int) -> np.ndarray:
        return np.concatenate([total[before[:i] + i], [0.0], total[before[i] + i + 1 : before[i] + n]])

    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            i = chain[-1]
            mean = np.where(alive, row(i) / (w[i] * w), np.inf)
            mean[i] = np.inf
            j = int(np.argmin(mean))
            if len(chain) > 1 and chain[-2] == j:
                break
            chain.append(j)
        del chain[-2:]
        a, b = sorted((i, j))
        into[b], height[b] = a, mean[j] / SCALE
        both = row(a) + row(b)
        total[before[:a] + a], total[before[a] + a + 1 : before[a] + n] = both[:a], both[a + 1 :]
        w[a] += w[b]
        alive[b] = False
    return MergeTree(into, height)
