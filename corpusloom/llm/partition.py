"""Coarse partitions of unit vectors, fitted on a bounded sample."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Most vectors that fitting looks at; every vector is then placed.
SAMPLE = 16_384


def sample(items: DataFrame, key: str, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` unit vectors, those with the smallest hash of their key."""
    rows = items.select("vec").orderBy(F.xxhash64(key), key).limit(most).toArrow()
    return V.unit(V.matrix(rows.column("vec"))) if rows.num_rows else np.zeros((0, 0), np.float32)


def two_means(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A boolean half for each row; seeds are the row farthest from the mean and the one farthest from it."""
    a = x[(x @ x.mean(0)).argmin()]
    b = x[(x @ a).argmin()]
    half = x @ a < x @ b
    for _ in range(rounds):
        if half.all() or not half.any():
            break
        c = np.stack([V.unit(x[~half].mean(0, keepdims=True))[0], V.unit(x[half].mean(0, keepdims=True))[0]])
        s = x @ c.T
        new = s[:, 1] > s[:, 0]
        if (new == half).all():
            break
        half = new
    return half


def dispersion(x: np.ndarray) -> float:
    """Sum over rows of one minus the cosine to the centre."""
    return float(len(x) - np.linalg.norm(x.sum(0)))


def bisect(x: np.ndarray, most: int, least: int = 8) -> tuple[list[np.ndarray], list[float]]:
    """Leaves of bisecting k-means as row numbers, and the dispersion of each.

    The node of largest dispersion is split until there are ``most`` leaves; a node with
    fewer than ``least`` rows is not. Neighbouring leaves in the list are neighbours in
    the tree.
    """
    order, heap = {(): np.arange(len(x))}, []

    def offer(path):
        if len(order[path]) >= least:
            heapq.heappush(heap, (-dispersion(x[order[path]]), path))

    if len(x):
        offer(())
    while heap and len(order) < most:
        _, path = heapq.heappop(heap)
        rows = order[path]
        half = two_means(x[rows])
        if half.all() or not half.any():
            continue
        del order[path]
        for side, mask in ((0, ~half), (1, half)):
            order[(*path, side)] = rows[mask]
            offer((*path, side))
    leaves = [order[p] for p in sorted(order)] if len(x) else []
    return leaves, [dispersion(x[rows]) for rows in leaves]
