"""Joint refinement of a roof's planes: Levenberg-Marquardt over all planes at once.

A plane is its gradient and its height at its points' centre. What its points say of it enters
as their normal equations; beside it stand the regularities that the planes nearly have: level
roofs, slopes that face an outline edge, level ridges, equal slopes on both sides of a ridge, and
four or more planes that meet in one corner. Each enters only within its gate, so nothing is
bent that is not nearly so already.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from skyfold.operators import planes


@dataclass(frozen=True)
class TopologyParams:
    angle_sigma_deg: float = 1.0
    least_residual_m: float = 0.02
    corner_sigma_m: float = 0.02
    ridge_sigma_deg: float = 0.1
    level_gate_deg: float = 3.0
    aligned_gate_deg: float = 5.0
    ridge_gate_deg: float = 3.0
    symmetric_gate_deg: float = 3.0
    edge_min_m: float = 2.0
    opposed_tolerance_deg: float = 30.0
    step_m: float = 0.3
    adjacent_m: float = 0.75
    adjacent_points: int = 3
    corner_reach_m: float = 0.5
    corner_condition: float = 0.01
    evidence_points: int = 200
    tau: float = 1e-3
    max_iterations: int = 100
    gradient_tolerance: float = 1e-8
    step_tolerance: float = 1e-10


@dataclass
class TopologyResult:
    planes: list[np.ndarray]
    status: str
    reason: str | None = None
    relations: list[tuple[int, int, str]] = field(default_factory=list)
    corners: list[tuple[int, ...]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    cost: float = 0.0
    gradient: float = 0.0
    iterations: int = 0


def _slope(g: np.ndarray) -> float:
    return float(np.degrees(np.arctan(np.hypot(*g))))


def edge_directions(outline: list[np.ndarray], least: float) -> np.ndarray:
    """Directions of the outline's longer edges in all four senses, in radians."""
    out = []
    for r in outline:
        d = np.roll(r, -1, axis=0) - r
        d = d[np.hypot(*d.T) >= least]
        out.append(np.arctan2(d[:, 1], d[:, 0]))
    base = np.concatenate(out) if out else np.empty(0)
    return np.concatenate([base + k * np.pi / 2 for k in range(4)])


def classify(ga: np.ndarray, gb: np.ndarray, gap: float, p: TopologyParams) -> str:
    """step where the heights differ along the border, ridge where the slopes face away from one another, else break."""
    if gap > p.step_m:
        return "step"
    if min(_slope(ga), _slope(gb)) > p.level_gate_deg:
        turn = np.degrees(np.arccos(np.clip(ga @ gb / (np.hypot(*ga) * np.hypot(*gb)), -1, 1)))
        if turn >= 180 - p.opposed_tolerance_deg:
            return "ridge"
    return "break"


def levenberg_marquardt(residuals, x: np.ndarray, p: TopologyParams) -> tuple[np.ndarray, float, float, int, bool]:
    """x, cost, gradient, iterations and whether it settled; damping after Nielsen."""

    def jacobian(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        j = np.empty((len(r), len(x)))
        for k in range(len(x)):
            h = 1e-6 * max(1.0, abs(x[k]))
            e = np.zeros(len(x))
            e[k] = h
            j[:, k] = (residuals(x + e) - residuals(x - e)) / (2 * h)
        return j

    r = residuals(x)
    j = jacobian(x, r)
    a, g = j.T @ j, j.T @ r
    mu, nu = p.tau * max(a.diagonal().max(), 1e-12), 2.0
    for i in range(p.max_iterations):
        if np.abs(g).max() <= p.gradient_tolerance * max(1.0, r @ r):
            return x, float(r @ r), float(np.abs(g).max()), i, True
        step = np.linalg.solve(a + mu * np.eye(len(x)), -g)
        if np.linalg.norm(step) <= p.step_tolerance * (np.linalg.norm(x) + p.step_tolerance):
            return x, float(r @ r), float(np.abs(g).max()), i, True
        new = residuals(x + step)
        gain = (r @ r - new @ new) / max(step @ (mu * step - g), 1e-300)
        if gain > 0:
            x, r = x + step, new
            j = jacobian(x, r)
            a, g = j.T @ j, j.T @ r
            mu, nu = mu * max(1 / 3, 1 - (2 * gain - 1) ** 3), 2.0
        else:
            mu, nu = mu * nu, nu * 2
    return x, float(r @ r), float(np.abs(g).max()), p.max_iterations, False


def refine(points: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], outline: list[np.ndarray], p: TopologyParams | None = None) -> TopologyResult:
    """Planes refined together; those given are returned as they are where that fails."""
    p = p or TopologyParams()
    given = [plane for plane, _ in found]
    if not found:
        return TopologyResult([], "ok")
    centre, root, x0 = [], [], []
    for plane, rows in found:
        q = points[rows]
        m = q[:, :2].mean(0)
        a = np.column_stack((q[:, :2] - m, np.ones(len(q))))
        g = -plane[:2] / plane[2]
        start = np.array([*g, (plane[3] - plane[:2] @ m) / plane[2]])
        sigma = max(float(np.sqrt(np.mean((q[:, 2] - a @ start) ** 2))), p.least_residual_m)
        w, v = np.linalg.eigh(a.T @ a / max(1.0, len(q) / p.evidence_points))  # more points than these say no more
        root.append((v * np.sqrt(np.maximum(w, 0))).T / sigma)
        centre.append(m)
        x0.append(start)
    x0 = np.array(x0)
    sigma, ridge_sigma = np.radians(p.angle_sigma_deg), np.radians(p.ridge_sigma_deg)
    height = lambda x, k, at: x[k, 2] + x[k, :2] @ (at - centre[k])

    relations, touching = [], []
    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            a, b = points[found[i][1], :2], points[found[j][1], :2]
            near_i, near_j = planes.neighbours(a, b, p.adjacent_m)
            if len(np.unique(near_j)) >= p.adjacent_points:
                border = (a[near_i].mean(0) + b[near_j].mean(0)) / 2
                gap = abs(height(x0, i, border) - height(x0, j, border))
                relations.append((i, j, classify(x0[i, :2], x0[j, :2], gap, p)))
                touching.append(a[near_i])
    level = [k for k in range(len(found)) if _slope(x0[k, :2]) <= p.level_gate_deg]
    directions = edge_directions(outline, p.edge_min_m)
    aligned = []
    for k in set(range(len(found))) - set(level):
        if len(directions):
            off = (np.arctan2(x0[k, 1], x0[k, 0]) - directions + np.pi) % (2 * np.pi) - np.pi
            if abs(off[np.abs(off).argmin()]) <= np.radians(p.aligned_gate_deg):
                aligned.append((k, directions[np.abs(off).argmin()]))
    along = lambda x, i, j: (lambda d: np.arctan(x[i, :2] @ np.array([-d[1], d[0]]) / max(np.hypot(*d), 1e-12)))(x[i, :2] - x[j, :2])
    ridges = [(i, j) for i, j, kind in relations if kind == "ridge" and abs(along(x0, i, j)) <= np.radians(p.ridge_gate_deg)]
    twins = [(i, j) for i, j, kind in relations if kind == "ridge" and abs(_slope(x0[i, :2]) - _slope(x0[j, :2])) <= p.symmetric_gate_deg]

    warnings: list[str] = []
    corners = _corners(x0, centre, relations, touching, p, warnings)
    start = np.concatenate((x0.ravel(), *(c[1] for c in corners))) if corners else x0.ravel()
    n = x0.size

    def residuals(flat: np.ndarray) -> np.ndarray:
        x = flat[:n].reshape(-1, 3)
        out = [root[k] @ (x[k] - x0[k]) for k in range(len(x))]
        out += [np.arctan(x[k, :2]) / sigma for k in level]
        out += [np.array([((np.arctan2(x[k, 1], x[k, 0]) - d + np.pi) % (2 * np.pi) - np.pi) / sigma]) for k, d in aligned]
        out += [np.array([along(x, i, j) / ridge_sigma]) for i, j in ridges]
        out += [np.array([(np.arctan(np.hypot(*x[i, :2])) - np.arctan(np.hypot(*x[j, :2]))) / sigma]) for i, j in twins]
        for c, (members, _) in enumerate(corners):
            at = flat[n + 3 * c : n + 3 * c + 3]
            out.append(np.array([(height(x, k, at[:2]) - at[2]) / p.corner_sigma_m for k in members]))
        return np.concatenate(out)

    try:
        flat, cost, gradient, iterations, settled = levenberg_marquardt(residuals, start, p)
    except np.linalg.LinAlgError as e:
        return TopologyResult(given, "failed", f"no step could be solved: {e}", relations)
    x = flat[:n].reshape(-1, 3)
    out = []
    for k in range(len(x)):
        normal = np.array([-x[k, 0], -x[k, 1], 1.0])
        size = np.linalg.norm(normal)
        out.append(np.append(normal / size, (x[k, 2] - x[k, :2] @ centre[k]) / size))
    told = dict(relations=relations, corners=[m for m, _ in corners], warnings=warnings, cost=cost, gradient=gradient, iterations=iterations)
    if not settled or not np.isfinite(flat).all():
        return TopologyResult(given, "failed", f"not settled after {iterations} iterations: cost {cost:.4g}, gradient {gradient:.4g}", **told)
    return TopologyResult(out, "ok", **told)


def _corners(x: np.ndarray, centre: list, relations: list, touching: list, p: TopologyParams, warnings: list[str]) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """(planes, place) where four planes or more that border on one another nearly meet."""
    near = {k: {k} for k in range(len(x))}
    for i, j, kind in relations:
        if kind != "step":
            near[i].add(j)
            near[j].add(i)
    found: dict[tuple[int, ...], np.ndarray] = {}
    for (i, j, kind), place in zip(relations, touching, strict=True):
        if kind == "step":
            continue
        for k in (near[i] & near[j]) - {i, j}:
            a = np.column_stack((-x[[i, j, k], :2], np.ones(3)))
            if 1 / np.linalg.cond(a) < p.corner_condition:
                warnings.append("ill-conditioned corner")
                continue
            at = np.linalg.solve(a, np.array([x[m, 2] - x[m, :2] @ centre[m] for m in (i, j, k)]))
            if np.hypot(*(place - at[:2]).T).min() > p.adjacent_m:
                continue
            members = tuple(sorted(m for m in near[i] | near[j] | near[k] if abs(x[m, 2] + x[m, :2] @ (at[:2] - centre[m]) - at[2]) <= p.corner_reach_m and len(near[m] & (near[i] | near[j] | near[k])) > 2))
            if len(members) >= 4:
                found.setdefault(members, at)
    return list(found.items())
