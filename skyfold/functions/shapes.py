"""Tests of many points against one shape, and their nearest neighbours, in numpy.

They serve kernels that get a shape's edges once and its points as columns. Work is done in
chunks, so memory is bounded whatever the outline.
"""

from __future__ import annotations

import numpy as np

#: Pairs that are held at once at most.
CHUNK = 1 << 21


def _chunks(n: int, width: int):
    step = max(1, CHUNK // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def inside(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie in the shape of edges (n, 4) by the even-odd rule, or on its boundary."""
    out = np.zeros(len(x), bool)
    x1, y1, x2, y2 = edges.T[:, None, :]
    for part in _chunks(len(x), len(edges)):
        px, py = x[part, None], y[part, None]
        cross = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
        odd = (((y1 > py) != (y2 > py)) & (cross * np.sign(y2 - y1) > 0)).sum(axis=1) % 2 == 1
        on = (cross == 0) & (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2)) & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
        out[part] = odd | on.any(axis=1)
    return out


def boundary_distance(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of points from the nearest edge."""
    out = np.full(len(x), np.inf)
    x1, y1, x2, y2 = edges.T[:, None, :]
    dx, dy = x2 - x1, y2 - y1
    for part in _chunks(len(x), len(edges)):
        px, py = x[part, None] - x1, y[part, None] - y1
        t = np.clip((px * dx + py * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
        out[part] = np.sqrt(((px - t * dx) ** 2 + (py - t * dy) ** 2).min(axis=1, initial=np.inf))
    return out


def nearest_median(queries: np.ndarray, targets: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The median value of the k targets nearest to each query, NaN without any; of equally near ones those that come first.

    Targets are filed in square cells; a query looks at the cells around its own, and at more of
    them until the k nearest are proven to be there.
    """
    n, m = len(queries), len(targets)
    out = np.full(n, np.nan)
    if not n or not m:
        return out
    k = min(k, m)
    low = np.minimum(queries.min(0), targets.min(0)).astype(float)
    extent = float((np.maximum(queries.max(0), targets.max(0)) - low).max()) or 1.0
    size = max(extent * np.sqrt(2.0 * k / m), extent / 2**20)
    todo = np.arange(n)
    while len(todo):
        cell_t = np.floor((targets - low) / size).astype(np.int64)
        cell_q = np.floor((queries[todo] - low) / size).astype(np.int64)
        span = int(max(cell_t.max(), cell_q.max())) + 3
        key = (cell_t[:, 0] + 1) * span + cell_t[:, 1] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        near = (cell_q[:, 0][:, None] + np.arange(3)[None]) * span + cell_q[:, 1][:, None]  # the three runs of three cells
        first, last = np.searchsorted(key, near, "left"), np.searchsorted(key, near + 2, "right")
        count = (last - first).sum(axis=1)
        left = []
        at = 0
        while at < len(todo):
            # so many queries as have CHUNK targets near by, at least one
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(count[at:]), CHUNK, "right")))
            rows, f, c = np.arange(at, upto), first[at:upto].ravel(), (last - first)[at:upto].ravel()
            j = order[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(f, c)]
            q = np.repeat(rows, count[at:upto])
            d2 = ((queries[todo[q]] - targets[j]) ** 2).sum(axis=1)
            by = np.lexsort((j, d2, q))
            q, j, d2 = q[by], j[by], d2[by]
            start = np.searchsorted(q, rows)
            rank = np.arange(len(q)) - start[q - at]
            own = rank < k
            far = np.full(len(rows), np.inf)
            kth = rank == k - 1
            far[q[kth] - at] = d2[kth]
            # what lies beyond the three by three cells is at least as far as the nearest rim
            corner = low + cell_q[rows] * size
            rim = np.minimum((queries[todo[rows]] - corner).min(axis=1), (corner + size - queries[todo[rows]]).min(axis=1)) + size
            proven = (far < rim**2) | (size >= extent * 2)
            med = own & proven[q - at]
            if med.any():
                table = np.full((len(rows), k), np.nan)
                table[q[med] - at, rank[med]] = values[j[med]]
                out[todo[rows[proven]]] = np.nanmedian(table[proven], axis=1)
            left.append(todo[rows[~proven]])
            at = upto
        todo, size = np.concatenate(left), size * 2
    return out
