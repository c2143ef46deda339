"""A kd-tree of points in numpy, for whole batches of queries: what one task does with the points that it holds."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, queries that are worked at once, distances that are computed at once.
LEAF, QUERIES, PAIRS = 128, 16_384, 1_000_000
NONE = np.iinfo(np.int64).max


def first_of_equal(points: np.ndarray, ids: np.ndarray, need: int) -> np.ndarray:
    """Places of the points that can count: of equal ones the `need` with the smallest ids."""
    order = np.lexsort((ids, *points.T))
    own = points[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[place < need]


class KdTree:
    """Points and their ids; of equal points only those that can be among `need` nearest ones are kept. Boxes no wider than
    `least` are not split."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, need: int, least: float = 0.0):
        kept = first_of_equal(points, ids, need)
        self.points, self.ids, self.need, self.least = points[kept], ids[kept], need, least
        #: low, high, first, end (of a leaf), left, right (-1: a leaf)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.ends: list[tuple[int, int, int, int]] = []
        self.order = np.arange(len(kept))
        if len(kept):
            self._node(0, len(kept))
            self.points, self.ids = self.points[self.order], self.ids[self.order]

    def _node(self, first: int, end: int) -> int:
        at, own = len(self.ends), self.points[self.order[first:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.ends.append((first, end, -1, -1))
        if end - first <= max(LEAF, 2 * self.need) or (high - low).max() <= self.least:
            self.order[first:end] = self.order[first:end][self.ids[self.order[first:end]].argsort(kind="stable")]
            return at
        axis, half = int((high - low).argmax()), (end - first) // 2
        self.order[first:end] = self.order[first:end][own[:, axis].argpartition(half)]
        left = self._node(first, first + half)
        self.ends[at] = (first, end, left, self._node(first + half, end))
        return at

    def _reach(self, node: int, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0.0)
        return (gap * gap).sum(axis=1)

    def nearest(self, queries: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, ids) of each query's `need` nearest points, in order, ties by the smaller id; infinity and NONE
        beyond the last. bound: squared distances beyond which no point is wanted."""
        d2 = np.full((len(queries), self.need), np.inf)
        ids = np.full((len(queries), self.need), NONE)
        for a in range(0, len(queries) if self.ends else 0, QUERIES):
            part = slice(a, a + QUERIES)
            limit = np.full(len(queries[part]), np.inf) if bound is None else bound[part]
            self._search(queries[part], d2[part], ids[part], limit)
        return d2, ids

    def _search(self, q: np.ndarray, best: np.ndarray, ids: np.ndarray, limit: np.ndarray) -> None:
        stack = [(0, np.arange(len(q)), self._reach(0, q))]
        while stack:
            node, rows, near = stack.pop()
            # a box as far as the last one found may hold an equal distance with a smaller id
            keep = near <= np.minimum(best[rows, -1], limit[rows])
            rows = rows[keep]
            if not len(rows):
                continue
            first, end, left, right = self.ends[node]
            if left < 0:
                step = max(1, PAIRS // (end - first))
                for a in range(0, len(rows), step):
                    self._leaf(q, best, ids, rows[a : a + step], first, end)
                continue
            own = q[rows]
            to_left, to_right = self._reach(left, own), self._reach(right, own)
            nearer = to_left <= to_right
            # last in, first out: the nearer child of each query is searched before the other
            stack += [(left, rows[~nearer], to_left[~nearer]), (right, rows[nearer], to_right[nearer]), (right, rows[~nearer], to_right[~nearer]), (left, rows[nearer], to_left[nearer])]

    def _leaf(self, q: np.ndarray, best: np.ndarray, ids: np.ndarray, rows: np.ndarray, first: int, end: int) -> None:
        points, own = self.points[first:end], q[rows]
        d2 = sum((own[:, k][:, None] - points[:, k]) ** 2 for k in range(points.shape[1]))
        names = self.ids[first:end]
        if self.need == 1:
            at = d2.argmin(axis=1)  # the smallest id of equal ones: a leaf's ids rise
            d, name = d2[np.arange(len(rows)), at], names[at]
            better = (d < best[rows, 0]) | ((d == best[rows, 0]) & (name < ids[rows, 0]))
            best[rows[better], 0], ids[rows[better], 0] = d[better], name[better]
            return
        near = d2 <= best[rows, -1:]
        some = near.any(axis=1)
        rows, d2 = rows[some], d2[some]
        if not len(rows):
            return
        every = np.concatenate([best[rows], d2], axis=1)
        named = np.concatenate([ids[rows], np.broadcast_to(names, d2.shape)], axis=1)
        order = np.lexsort((named, every), axis=1)[:, : self.need]
        best[rows], ids[rows] = np.take_along_axis(every, order, axis=1), np.take_along_axis(named, order, axis=1)
