"""Union-find inside one task."""

from __future__ import annotations

from collections.abc import Hashable, Iterator

import numpy as np


class Forest:
    """Disjoint sets; ``edges`` gives one edge for each join of two sets, which connects what all joins connect."""

    def __init__(self) -> None:
        self._up: dict[Hashable, Hashable] = {}
        self._edges: list[tuple] = []

    def find(self, x):
        up = self._up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x, y) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self._up[max(a, b)] = min(a, b)
        self._edges.append((x, y))
        return True

    def edges(self) -> Iterator[tuple]:
        return iter(self._edges)


def roots_of(up: np.ndarray) -> np.ndarray:
    while (up[up] != up).any():
        up = up[up]
    return up


def joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``i`` and ``j`` in the forest ``up``, where a row hangs on a lesser one, for all pairs at once."""
    while len(i):
        up[:] = roots_of(up)
        a, b = up[i], up[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))


class ArrayForest:
    """Disjoint sets of numbers that are known beforehand, joined many at once."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = np.unique(numbers)
        self.up = np.arange(len(self.numbers))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        joined(self.up, np.searchsorted(self.numbers, x), np.searchsorted(self.numbers, y))

    def edges(self) -> np.ndarray:
        """(n, 2): every number that hangs on another, and the least of its set."""
        root = roots_of(self.up)
        below = np.flatnonzero(root != np.arange(len(root)))
        return np.stack([self.numbers[below], self.numbers[root[below]]], axis=1)
