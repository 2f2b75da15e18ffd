"""Areas of overlaid polygons, exactly, by slabs.

The plane is cut at the height of every vertex and crossing. Between two cuts no edges
cross, so each shape is a set of trapezoids between its edges, two by two (even-odd), and
so is what they have in common. Holes and overlapping rings need no care.
"""

from __future__ import annotations

import numpy as np


def edge_array(edges) -> np.ndarray:
    """(n, 4) array of a list of rows (x1, y1, x2, y2)."""
    return np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in edges], float).reshape(-1, 4)


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    p, d = e[:, :2], e[:, 2:] - e[:, :2]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    den = cross(d[:, None], d[None])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = cross(p[None] - p[:, None], d[None]) / den
        u = cross(p[None] - p[:, None], d[:, None]) / den
    ok = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    i, j = np.nonzero(ok)
    return p[i, 1] + t[i, j] * d[i, 1]


def areas(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Area of a and b in common, of a, and of b."""
    both = np.vstack((a, b))
    if not len(both):
        return 0.0, 0.0, 0.0
    origin = both[0, :2]
    both = both - np.tile(origin, 2)
    side = np.repeat([0, 1], [len(a), len(b)])
    cuts = np.unique(np.concatenate((both[:, 1], both[:, 3], _crossings(both))))
    total = np.zeros(3)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        mid = (low + high) / 2
        on = np.minimum(both[:, 1], both[:, 3]) < mid
        on &= np.maximum(both[:, 1], both[:, 3]) > mid
        e, s = both[on], side[on]
        x = e[:, 0] + (mid - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        order = np.argsort(x, kind="stable")
        x, s = x[order], s[order]
        in_a, in_b = np.cumsum(s == 0) % 2 == 1, np.cumsum(s == 1) % 2 == 1
        width = np.diff(x)
        for k, inside in enumerate((in_a & in_b, in_a, in_b)):
            total[k] += (width * inside[:-1]).sum() * (high - low)
    return float(total[0]), float(total[1]), float(total[2])


def _members(groups: list[list[np.ndarray]]):
    """Slab by slab: widths times height of the intervals between edges, and which groups hold each. A group holds what
    any of its shapes does, each by the even-odd rule."""
    owner = [(g, e) for g, shapes in enumerate(groups) for e in shapes if len(e)]
    if not owner:
        return
    every = np.vstack([e for _, e in owner])
    every = every - np.tile(every[0, :2], 2)
    of = np.repeat(np.arange(len(owner)), [len(e) for _, e in owner])
    group = np.array([g for g, _ in owner])
    cuts = np.unique(np.concatenate((every[:, 1], every[:, 3], _crossings(every))))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        mid = (low + high) / 2
        on = (np.minimum(every[:, 1], every[:, 3]) < mid) & (np.maximum(every[:, 1], every[:, 3]) > mid)
        e, s = every[on], of[on]
        x = e[:, 0] + (mid - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        order = np.argsort(x, kind="stable")
        odd = np.cumsum(s[order][None, :] == np.arange(len(owner))[:, None], axis=1)[:, :-1] % 2 == 1
        held = np.zeros((len(groups), odd.shape[1]), bool)
        np.logical_or.at(held, group, odd)
        yield np.diff(x[order]) * (high - low), held


def region_areas(groups: list[list[np.ndarray]], *tests) -> list[float]:
    """The area where each test holds; a test takes the groups' membership (groups, intervals) and tells which intervals count."""
    total = [0.0] * len(tests)
    for size, held in _members(groups):
        for k, test in enumerate(tests):
            total[k] += float(size[test(held)].sum())
    return total


def union_edges(shapes: list[np.ndarray]) -> np.ndarray:
    """The boundary of the union of shapes, as edges that an even-odd test reads: every edge is cut where others
    meet it, and the pieces with the union on just one side are kept, once each."""
    shapes = [e for e in shapes if len(e)]
    if len(shapes) <= 1:
        return shapes[0] if shapes else np.empty((0, 4))
    every = np.vstack(shapes)
    origin = every[0, :2].copy()
    every, shapes = every - np.tile(origin, 2), [e - np.tile(origin, 2) for e in shapes]
    p, d = every[:, :2], every[:, 2:] - every[:, :2]
    ends = np.vstack((every[:, :2], every[:, 2:]))
    kept: dict[tuple, tuple] = {}
    for i in range(len(every)):
        size2 = d[i] @ d[i]
        # places along the edge: crossings with others, and ends of others that lie on it
        den = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        gap = p - p[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / den
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / den
        t = t[(den != 0) & (u >= 0) & (u <= 1) & (t > 0) & (t < 1)]
        along = (ends - p[i]) @ d[i] / size2
        off = np.abs((ends - p[i])[:, 0] * d[i, 1] - (ends - p[i])[:, 1] * d[i, 0]) / np.sqrt(size2)
        places = np.unique(np.round(np.concatenate(([0.0, 1.0], t, along[(off < 1e-9) & (along > 0) & (along < 1)])), 12))
        a, b = p[i] + places[:-1, None] * d[i], p[i] + places[1:, None] * d[i]
        normal = np.array([-d[i, 1], d[i, 0]]) / np.sqrt(size2) * 1e-6
        sides = []
        for sign in (1, -1):
            q = (a + b) / 2 + sign * normal
            sides.append(np.any([inside_odd(e, q) for e in shapes], axis=0))
        for k in np.flatnonzero(sides[0] != sides[1]):
            name = tuple(sorted((tuple(np.round(a[k], 7)), tuple(np.round(b[k], 7)))))
            kept.setdefault(name, (*a[k], *b[k]))
    out = np.array(list(kept.values())).reshape(-1, 4)
    return out + np.tile(origin, 2)


def inside_odd(edges: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Even-odd membership of points (n, 2) that lie on no edge."""
    x1, y1, x2, y2 = edges.T[:, None, :]
    px, py = q[:, :1], q[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / (y2 - y1))
    return crosses.sum(axis=1) % 2 == 1


def ring_edge_array(ring: np.ndarray) -> np.ndarray:
    """(n, 4) edges of a ring, closed or not, without those of no length."""
    xy = np.asarray(ring, float)[:, :2]
    e = np.hstack((xy, np.roll(xy, -1, axis=0)))
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]
