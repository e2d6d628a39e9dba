"""A packed k-d tree over points of the globe, probed in vectorised batches.

Points are unit vectors, so distances grow with chords and neither poles nor the
antimeridian need care.  The tree is implicit: points are ordered so that
each node is a range of them, halved at the middle along its widest
axis, down to ranges of ``LEAF`` points; a node is its range and its
bounding box, in flat arrays.  A batch of probes descends to one leaf each
for a first bound, then all pairs of probe and node go down level by
level, dropping pairs whose box is farther than the probe's bound.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
ROUNDING = 1e-12            # of squared chords: what might still be nearest or tied is compared exactly


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


class Tree:
    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        xyz = unit_vectors(lat, lon)
        order = np.arange(len(xyz))
        begin, end, low, high = [0], [len(xyz)], [], []
        node = 0
        while node < len(begin):            # children of a node are added behind all nodes so far
            a, b = begin[node], end[node]
            box = xyz[order[a:b]]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            node += 1
            if b - a <= LEAF:
                continue
            axis, middle = int((high[-1] - low[-1]).argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(box[:, axis], middle)]
            begin += [a, a + middle]
            end += [a + middle, b]
        self.order, self.xyz = order, xyz[order]
        self.begin, self.end = np.array(begin), np.array(end)
        self.low, self.high = np.array(low), np.array(high)
        inner = self.end - self.begin > LEAF
        self.child = np.where(inner, 2 * np.cumsum(inner) - 1, -1)      # the left one; the right one follows

    def _box(self, probes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance of each probe to its node's box."""
        gap = np.maximum(0.0, np.maximum(self.low[nodes] - probes, probes - self.high[nodes]))
        return (gap * gap).sum(axis=1)

    def _points(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of leaves: (index of the leaf, place of the point)."""
        n = self.end[nodes] - self.begin[nodes]
        row = np.repeat(np.arange(len(nodes)), n)
        return row, self.begin[nodes][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    def candidates(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, point) that hold every probe's nearest points, ties included: few per probe."""
        p = unit_vectors(lat, lon)
        at = np.zeros(len(p), np.int64)
        while (going := self.child[at] >= 0).any():
            left = self.child[at]
            nearer = self._box(p, np.where(going, left, at)) <= self._box(p, np.where(going, left + 1, at))
            at = np.where(going, np.where(nearer, left, left + 1), at)
        row, point = self._points(at)
        bound = np.full(len(p), np.inf)
        np.minimum.at(bound, row, ((p[row] - self.xyz[point]) ** 2).sum(axis=1))
        probe, node = np.arange(len(p)), np.zeros(len(p), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(probe):
            near = self._box(p[probe], node) <= bound[probe] * (1 + 1e-9) + ROUNDING
            probe, node = probe[near], node[near]
            leaf = self.child[node] < 0
            row, point = self._points(node[leaf])
            row = probe[leaf][row]
            d = ((p[row] - self.xyz[point]) ** 2).sum(axis=1)
            np.minimum.at(bound, row, d)
            found.append((row, point))
            probe, left = probe[~leaf], self.child[node[~leaf]]
            probe, node = np.concatenate([probe, probe]), np.concatenate([left, left + 1])
        row, point = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        d = ((p[row] - self.xyz[point]) ** 2).sum(axis=1)
        keep = d <= bound[row] * (1 + 1e-9) + ROUNDING
        return row[keep], self.order[point[keep]]
