"""Coarse cells of vectors: k-means in one level, or in two where there are many cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Number of cells up to which every vector is compared with every centroid.
FLAT_CELLS = 2_048


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids; empty ones are set anew on random rows."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest_centroid(x, c)
        order = np.argsort(a, kind="stable")
        count = np.bincount(a, minlength=k)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        full = count > 0
        c[full] = np.add.reduceat(x[order], starts[full], axis=0) / count[full][:, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c**2).sum(1)
    return np.concatenate([(x[a : a + 8_192] @ c.T - half).argmax(1) for a in range(0, max(len(x), 1), 8_192)])


@dataclass
class Cells:
    """Centroids; ``top`` and ``first`` lead to them in two steps, where they are many."""

    centroids: np.ndarray
    top: np.ndarray | None = None
    first: np.ndarray | None = None

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, nearest first."""
        n = min(n, len(self.centroids))
        if self.top is None:
            return self._best(x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1), np.arange(len(self.centroids)), n)
        tops = min(len(self.top), 4 + math.ceil(2 * n * len(self.top) / len(self.centroids)))
        near = self._best(x @ self.top.T - 0.5 * (self.top**2).sum(1), np.arange(len(self.top)), tops)
        score = np.full((len(x), n), -np.inf)
        cell = np.zeros((len(x), n), np.int64)
        for t in np.unique(near):
            rows = np.flatnonzero((near == t).any(1))
            a, b = self.first[t], self.first[t + 1]
            if a == b:
                continue
            c = self.centroids[a:b]
            both = np.concatenate([score[rows], x[rows] @ c.T - 0.5 * (c**2).sum(1)], axis=1)
            which = np.concatenate([cell[rows], np.broadcast_to(np.arange(a, b), (len(rows), b - a))], axis=1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :n]
            score[rows], cell[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(which, keep, 1)
        return cell

    @staticmethod
    def _best(score: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
        part = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
        order = np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable")
        return names[np.take_along_axis(part, order, 1)]


def train_cells(sample: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> Cells:
    """About ``k`` cells of a sample; in two levels beyond ``FLAT_CELLS``."""
    k = max(1, min(k, len(sample)))
    if k <= FLAT_CELLS:
        return Cells(kmeans(sample, k, rounds, rng))
    top = kmeans(sample, round(math.sqrt(k)), rounds, rng)
    of = nearest_centroid(sample, top)
    parts, first = [], [0]
    for t in range(len(top)):
        rows = sample[of == t]
        if len(rows):
            parts.append(kmeans(rows, max(1, round(k * len(rows) / len(sample))), rounds, rng))
        first.append(first[-1] + (len(parts[-1]) if len(rows) else 0))
    return Cells(np.concatenate(parts), top, np.array(first))


def cell_count(rows: int, cell_rows: int, knee: int = 400_000) -> int:
    """Cells of about ``cell_rows`` vectors; beyond ``knee`` rows their number grows with the square root, so that neither cells nor centroids outgrow a task."""
    most = math.ceil(rows / cell_rows)
    return max(1, most if rows <= knee else math.ceil(knee / cell_rows * math.sqrt(rows / knee)))
