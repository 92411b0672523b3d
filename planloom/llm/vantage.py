"""Vantage-point trees over vectors that a further coordinate brings to one length.

With the coordinate sqrt(m**2 - |x|**2) every vector of a tree has length m, and one of 0
leaves a query q as it is, so that d**2 = |q|**2 + m**2 - 2 q.x: inner products fall as
distances grow, and a window of products is an annulus round the query.
"""

from __future__ import annotations

import numpy as np

LEAF = 64  # vectors that are scored together


def further(x: np.ndarray, most: float) -> np.ndarray:
    """The coordinate that brings each row of ``x`` to length ``most``."""
    return np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0.0))


def distances(x: np.ndarray, more: np.ndarray, point: np.ndarray, point_more: np.ndarray) -> np.ndarray:
    """Distances of rows ``x`` (their further coordinates in ``more``) from the rows of ``point``."""
    a = (x * x).sum(axis=1) + more * more
    b = (point * point).sum(axis=1) + point_more * point_more
    return np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * (x @ point.T + np.outer(more, point_more)), 0.0))


class Tree:
    """Halves of ever nearer and farther vectors, down to leaves; rows are told by their place in ``order``.

    Inner node i has the halves 2 i + 1 (nearer) and 2 i + 2; its vantage point is row
    ``points[i]``, and ``shells[i]`` holds the least and the largest distance from it in
    the nearer half and in the farther one. Leaves are equal shares of ``order``.
    """

    def __init__(self, order: np.ndarray, points: np.ndarray, shells: np.ndarray, leaves: int, most: float):
        self.order, self.points, self.shells, self.leaves, self.most = order, points, shells, leaves, most

    @classmethod
    def grow(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        most = float(np.sqrt((x * x).sum(axis=1).max(initial=0.0)))
        more = further(x, most)
        order, points, shells, level = np.arange(len(x)), [], [], [(0, len(x))]
        while max(e - s for s, e in level) > leaf:
            halves = []
            for s, e in level:
                rows, mid = order[s:e], (s + e + 1) // 2
                start = distances(x[rows], more[rows], x[rows[:1]], more[rows[:1]])[:, 0]
                v = rows[int(np.argmax(start))]
                d = distances(x[rows], more[rows], x[v : v + 1], more[v : v + 1])[:, 0]
                by = np.argsort(d, kind="stable")
                order[s:e], d = rows[by], d[by]
                near, far = d[: mid - s], d[mid - s :]
                points.append(v)
                shells.append([near[0], near[-1], far[0], far[-1]])
                halves += [(s, mid), (mid, e)]
            level = halves
        return cls(order, np.array(points, np.int64), np.array(shells, np.float64).reshape(-1, 4), len(level), most)

    def ranges(self) -> list[tuple[int, int]]:
        """Where each leaf begins and ends in ``order``."""
        level = [(0, len(self.order))]
        while len(level) < self.leaves:
            level = [half for s, e in level for half in ((s, (s + e + 1) // 2), ((s + e + 1) // 2, e))]
        return level

    def bounds(self, from_points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that each query can have from each leaf's vectors.

        ``from_points`` are the queries' distances from the vantage points, ``radius`` their
        largest distance from any vector of the tree.
        """
        low, high = [np.zeros(len(radius))], [radius]
        for i, (near_low, near_high, far_low, far_high) in enumerate(self.shells):
            d = from_points[:, i]
            for a, b in ((near_low, near_high), (far_low, far_high)):
                low.append(np.maximum(low[i], np.maximum(d - b, a - d)))
                high.append(np.minimum(high[i], d + b))
        return np.stack(low[-self.leaves :], axis=1), np.stack(high[-self.leaves :], axis=1)

    def leaf_of(self, x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For vectors outside the tree: the leaf they belong to and the distance from the last vantage point passed."""
        more = further(x, self.most)
        d = distances(x, more, points, further(points, self.most)) if len(points) else np.zeros((len(x), 1))
        node, last = np.zeros(len(x), np.int64), np.zeros(len(x))
        while self.leaves > 1 and node.min(initial=len(self.points)) < len(self.points):
            last = d[np.arange(len(x)), node]
            node = 2 * node + 1 + (last > (self.shells[node, 1] + self.shells[node, 2]) / 2)
        return node - (self.leaves - 1), last
