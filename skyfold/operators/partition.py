"""Roof partition by an arrangement of lines, and the whole reconstruction of an outline.

An outline is cut by the level lines of neighbouring planes (where their heights are equal), by
the steps between neighbours that meet nowhere near, and by the extensions of its own edges. Every line cuts every piece, so the
pieces are convex and share whole edges: an exact partition without snapping, in which ridges
lie where the planes meet. Each piece takes the plane that most of its points belong to, or
that of the nearest point; pieces of one plane that share an edge are one face.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import extrude, planes, topology

SOLID = "struct<vertices:array<struct<x:double,y:double,z:double>>,surfaces:array<struct<kind:string,rings:array<array<int>>,face:int>>>"
FACES = "array<struct<face:int,plane_index:int,nx:double,ny:double,nz:double,d:double,rings:array<array<struct<x:double,y:double>>>>>"
ADJACENT_M, ADJACENT_POINTS, LEAST_AREA_M2 = 0.75, 3, 1e-6
LEAST_EDGE_M, ALIGN_DEG = 2.0, 15.0


@dataclass(frozen=True)
class RoofParams:
    min_points: int = 50
    floor_percentile: float = 5.0


def level_line(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float] | None:
    """(u, v, w) of the line u x + v y = w on which two planes are equally high; none if they are parallel in plan."""
    ga, gb = -a[:2] / a[2], -b[:2] / b[2]
    n = ga - gb
    size = float(np.hypot(*n))
    if size < 1e-6:
        return None
    return n[0] / size, n[1] / size, float(b[3] / b[2] - a[3] / a[2]) / size


def step_line(a: np.ndarray, b: np.ndarray, outline: list[np.ndarray]) -> tuple[float, float, float] | None:
    """The line between points a and b in plan (row by row neighbours across a step): through the middle of their pairs, along
    them, or along an outline's edge that runs nearly so."""
    middle = (a + b) / 2
    centre = middle.mean(0)
    _, size, axes = np.linalg.svd(middle - centre, full_matrices=False)
    if size[0] < 1e-9:
        return None
    along = axes[0]
    edges = np.vstack([np.roll(r, -1, axis=0) - r for r in outline])
    edges = edges[np.hypot(*edges.T) >= LEAST_EDGE_M]
    if len(edges):
        unit = edges / np.hypot(*edges.T)[:, None]
        turned = np.vstack((unit, unit[:, ::-1] * [1, -1]))
        near = np.abs(turned @ along)
        if near.max() >= np.cos(np.radians(ALIGN_DEG)):
            along = turned[int(near.argmax())]
    normal = np.array([-along[1], along[0]])
    return float(normal[0]), float(normal[1]), float(np.median(middle @ normal))


def _cut(found: list, i: int, j: int, points: np.ndarray, outline: list[np.ndarray]) -> tuple[int, tuple] | None:
    """How many points touch across two planes, and the line that parts them: where their heights are equal, if it runs
    along their neighbouring points, else the step between these."""
    a, b = points[found[i][1], :2], points[found[j][1], :2]
    of_a, of_b = planes.neighbours(a, b, ADJACENT_M)
    if len(np.unique(of_b)) < ADJACENT_POINTS:
        return None
    line = level_line(found[i][0], found[j][0])
    middle = (a[of_a] + b[of_b]) / 2
    if line is None or np.median(np.abs(middle @ np.array(line[:2]) - line[2])) > ADJACENT_M:
        line = step_line(a[of_a], b[of_b], outline) or line
    return (len(of_b), line) if line else None


def split(ring: np.ndarray, line: tuple[float, float, float]) -> list[np.ndarray]:
    """A convex ring cut by a line: one part or two."""
    d = ring @ np.array(line[:2]) - line[2]
    d[np.abs(d) < 1e-7] = 0
    if (d >= 0).all() or (d <= 0).all():
        return [ring]
    sides: tuple[list, list] = ([], [])
    for i in range(len(ring)):
        p, q, dp, dq = ring[i], ring[(i + 1) % len(ring)], d[i], d[(i + 1) % len(ring)]
        for k, s in enumerate((1, -1)):
            if s * dp >= 0:
                sides[k].append(p)
        if dp * dq < 0:
            # from the same end on either side of a shared edge, so that both get the same point
            (a, da), (b, db) = sorted(((tuple(p), dp), (tuple(q), dq)))
            x = np.array(a) + (np.array(b) - np.array(a)) * (da / (da - db))
            sides[0].append(x)
            sides[1].append(x)
    return [np.array(s) for s in sides if len(s) >= 3 and abs(extrude._area(np.array(s))) > LEAST_AREA_M2]


def convex_pieces(outline: list[np.ndarray]) -> list[np.ndarray]:
    """Convex pieces of a polygon with holes, which share whole edges: its box cut by every edge's line, and what lies inside."""
    outline = [np.asarray(r, float) for r in outline]
    outline = [r[:-1] if np.allclose(r[0], r[-1]) else r for r in outline]
    every = np.vstack(outline)
    (x0, y0), (x1, y1) = every.min(0), every.max(0)
    pieces = [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]
    seen = set()
    for r in outline:
        for p, q in zip(r, np.roll(r, -1, axis=0), strict=True):
            n = np.array([q[1] - p[1], p[0] - q[0]])
            size = np.hypot(*n)
            if size < 1e-9:
                continue
            n = n / size * (1 if (n[0], n[1]) > (0, 0) else -1)
            line = (float(n[0]), float(n[1]), float(n @ p))
            if (key := tuple(np.round(line, 6))) not in seen:
                seen.add(key)
                pieces = [s for piece in pieces for s in split(piece, line)]
    return [p for p in pieces if inside(outline, p.mean(0))]


def inside(rings: list[np.ndarray], point: np.ndarray) -> bool:
    odd = False
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        crosses = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (point[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        odd ^= bool((crosses & (point[0] < x)).sum() % 2)
    return odd


def partition(outline: list[np.ndarray], points: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """(plane's place, ring) of the pieces of a roof. points and planes lie in the outline's coordinates."""
    pieces = convex_pieces(outline)
    outline = [np.asarray(r, float) for r in outline]
    lines = [c for i in range(len(found)) for j in range(i + 1, len(found)) if (c := _cut(found, i, j, points, outline))]
    for _, line in sorted(lines, key=lambda x: -x[0]):
        pieces = [s for piece in pieces for s in split(piece, line)]
    rows = np.concatenate([r for _, r in found])
    owner = np.repeat(np.arange(len(found)), [len(r) for _, r in found])
    xy = points[rows, :2]
    out = []
    for ring in pieces:
        near = ((xy >= ring.min(0)) & (xy <= ring.max(0))).all(1)
        a, b = ring, np.roll(ring, -1, axis=0)
        turn = 1 if extrude._area(ring) > 0 else -1
        q = xy[near]
        held = (turn * ((b[:, 0] - a[:, 0])[None] * (q[:, 1:] - a[:, 1][None]) - (b[:, 1] - a[:, 1])[None] * (q[:, :1] - a[:, 0][None])) >= 0).all(1)
        votes = np.bincount(owner[near][held], minlength=len(found))
        best = int(votes.argmax()) if votes.any() else int(owner[((xy - ring.mean(0)) ** 2).sum(1).argmin()])
        out.append((best, ring))
    return out


def _key(p: np.ndarray) -> tuple[float, float]:
    return round(float(p[0]), 6), round(float(p[1]), 6)


def _face_of(pieces: list[tuple[int, np.ndarray]]) -> list[int]:
    """A number for each piece, the same for those of one face: pieces of one plane that share an edge."""
    by_edge: dict = {}
    root = list(range(len(pieces)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, (plane, ring) in enumerate(pieces):
        for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            j = by_edge.setdefault((plane, frozenset((_key(a), _key(b)))), i)
            root[find(i)] = find(j)
    return [find(i) for i in range(len(pieces))]


def count_faces(pieces: list[tuple[int, np.ndarray]]) -> int:
    """Faces: pieces of one plane that share an edge are one."""
    return len(set(_face_of(pieces)))


def outline_of(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The rings around pieces that share whole edges: those about the outside first, counterclockwise, then the holes, clockwise."""
    at, edges = {}, set()
    for ring in rings:
        ring = ring if extrude._area(ring) > 0 else ring[::-1]
        for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            a, b = _key(p), _key(q)
            at.setdefault(a, p)
            if (b, a) in edges:
                edges.remove((b, a))
            elif a != b:
                edges.add((a, b))
    follow: dict = {}
    for a, b in sorted(edges):
        follow.setdefault(a, []).append(b)
    turn = lambda a, b, c: np.angle(complex(c[0] - b[0], c[1] - b[1]) / complex(b[0] - a[0], b[1] - a[1]))
    out = []
    while follow:
        a = first = min(follow)
        before, ring = None, []
        while a in follow:
            # where rings touch, the sharpest turn to the left stays in the same corner of the face
            b = follow[a][0] if before is None else max(follow[a], key=lambda c: turn(before, a, c))
            follow[a].remove(b)
            if not follow[a]:
                del follow[a]
            ring.append(at[a])
            before, a = a, b
            if a == first:
                break
        out.append(np.array(ring))
    return sorted(out, key=lambda r: -extrude._area(r))


def faces(pieces: list[tuple[int, np.ndarray]], found: list[tuple[np.ndarray, np.ndarray]], origin: np.ndarray) -> list[dict]:
    """The faces of a roof, their planes (nx x + ny y + nz z = d) and rings moved to the coordinates that have the origin."""
    of, out = _face_of(pieces), []
    for face, root in enumerate(dict.fromkeys(of)):
        own = [i for i, r in enumerate(of) if r == root]
        k = pieces[own[0]][0]
        nx, ny, nz, d = map(float, found[k][0])
        rings = [[{"x": float(x), "y": float(y)} for x, y in r + origin] for r in outline_of([pieces[i][1] for i in own])]
        out.append({"face": face, "plane_index": k, "nx": nx, "ny": ny, "nz": nz, "d": d + nx * float(origin[0]) + ny * float(origin[1]), "rings": rings})
    return out


def _solid(solid: extrude.Solid | None, origin: np.ndarray, found: list, pieces: list) -> dict | None:
    """The solid's vertices in the coordinates that have the origin, and its surfaces; a roof surface's face is its plane."""
    if solid is None:
        return None
    vertices = [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in solid.vertices + [*origin, 0.0]]
    return {"vertices": vertices, "surfaces": [{"kind": kind, "rings": rings, "face": None if f is None else pieces[f][0]} for kind, rings, f in solid.surfaces]}


def reconstruct(outline: list[np.ndarray], points: np.ndarray, ground: float, planes_params: planes.PlaneParams | None = None, p: RoofParams | None = None, topology_params: topology.TopologyParams | None = None) -> dict:
    """Status, counts, volume and faces of one outline's roof points (n, 3), and why it failed if it did. outline: all rings, of holes and further parts too."""
    p = p or RoofParams()
    row = {"status": "ok", "reason": None, "n_points": len(points), "n_planes": 0, "n_faces": 0, "volume_m3": None, "faces": [], "solid": None, "warnings": []}
    if len(points) < p.min_points:
        return row | {"status": "too-few-points", "reason": f"{len(points)} points, {p.min_points} needed"}
    origin = np.asarray(outline[0], float)[0]
    outline, points = [np.asarray(r, float) - origin for r in outline], points - [*origin, 0.0]  # northings are in the millions
    found = planes.detect(points, planes_params)
    if not found:
        return row | {"status": "no-planes", "reason": "no plane found"}
    solved = topology.refine(points, found, outline, topology_params)
    row["warnings"] = list(solved.warnings)
    if solved.status != "ok":
        return row | {"status": "solver-failed", "reason": solved.reason, "n_planes": len(found)}
    found = [(plane, rows) for plane, (_, rows) in zip(solved.planes, found, strict=True)]
    pieces = partition(outline, points, found)
    solid, problems = extrude.extrude([(found[k][0], [ring]) for k, ring in pieces], ground)
    row |= {"n_planes": len(found), "n_faces": count_faces(pieces), "volume_m3": solid.volume() if solid else None, "faces": faces(pieces, found, origin), "solid": _solid(solid, origin, found, pieces)}
    return row | ({"status": "not-watertight", "reason": "; ".join(problems)} if problems else {})


def reconstruct_all(footprints: DataFrame, points: DataFrame, key: str, params: planes.PlaneParams | None = None, topology_params: topology.TopologyParams | None = None) -> DataFrame:
    """A row for every outline (key, rings of structs x, y, or one ring, and ground_z), whatever becomes of it. points: key, pid, x, y, z in the same metres."""
    kind = footprints.schema[key].dataType.simpleString()
    names = [key, "status", "reason", "n_points", "n_planes", "n_faces", "volume_m3", "faces", "solid", "warnings"]
    whole = "rings" in footprints.columns

    def run(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=names)
        p = p.sort_values("pid")
        try:
            rings = [r["p"] for r in f.rings.iloc[0]] if whole else [f.ring.iloc[0]]
            rings = [np.array([(c["x"], c["y"]) for c in r], float) for r in rings]
            row = reconstruct(rings, p[["x", "y", "z"]].to_numpy(float), float(f.ground_z.iloc[0]), params, topology_params=topology_params)
        except Exception as e:  # a failure is a row, not the end of the run
            row = {"status": "error", "reason": f"{type(e).__name__}: {e}", "n_points": len(p), "n_planes": 0, "n_faces": 0, "volume_m3": None, "faces": [], "solid": None, "warnings": []}
        return pd.DataFrame([{key: f[key].iloc[0]} | row], columns=names).astype({"volume_m3": float})

    schema = f"{key} {kind}, status string, reason string, n_points bigint, n_planes int, n_faces int, volume_m3 double, faces {FACES}, solid {SOLID}, warnings array<string>"
    if whole:
        footprints = footprints.withColumn("rings", geo.wrapped(F.col("rings")))
    return footprints.groupBy(key).cogroup(points.groupBy(key)).applyInPandas(run, schema)
