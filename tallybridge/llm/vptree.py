"""Pairs of 64-bit fingerprints within a Hamming radius, by vantage-point trees over numpy arrays.

A node takes one point as its vantage, measures all others against it and splits at the median
distance. Two points within ``radius`` of each other differ by at most ``radius`` in their
distance from the vantage (triangle inequality), so besides the two sides only the band of
``radius`` on either side of the boundary has to meet. Small nodes compare all their points.
"""

from __future__ import annotations

import numpy as np

LEAF = 48
BLOCK = 1024


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes is connected with by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        # Roots, not ends, are hooked to the smaller root, so what hangs below them comes along.
        left, right = label[a], label[b]
        low = np.minimum(left, right)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label = next_
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


class _Links:
    """Links gathered so far, reduced to a spanning star per component whenever they pile up."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)
            if self.held > 1_000_000:
                star = self.roots()
                own = np.flatnonzero(star != np.arange(self.n))
                self.a, self.b, self.held = [own], [star[own]], len(own)

    def roots(self) -> np.ndarray:
        if not self.a:
            return np.arange(self.n)
        return roots(self.n, np.concatenate(self.a), np.concatenate(self.b))


def _meet(points: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, links: _Links) -> None:
    for i in range(0, len(left), BLOCK):
        rows = left[i : i + BLOCK]
        for j in range(0, len(right), BLOCK):
            cols = right[j : j + BLOCK]
            x, y = np.nonzero(distance(points[rows][:, None], points[cols][None, :]) <= radius)
            links.add(rows[x], cols[y])


def connected(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the smallest index it is connected with by pairs within ``radius``."""
    links = _Links(len(points))
    todo = [np.arange(len(points))]
    while todo:
        ids = todo.pop()
        if len(ids) <= LEAF:
            _meet(points, ids, ids, radius, links)
            continue
        away = distance(points[ids], points[ids[0]])
        at = np.median(away)
        inner = away <= at
        if inner.all():
            inner = away < at
        if not inner.any():
            _meet(points, ids, ids, radius, links)
            continue
        edge = int(away[inner].max())
        todo += [ids[inner], ids[~inner]]
        _meet(points, ids[inner & (away > edge - radius)], ids[~inner & (away <= edge + radius)], radius, links)
    return links.roots()
