"""Kernels and functions against closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyfold.functions import geo, overlay
from skyfold.operators import extrude, partition, planes, topology


def box(x0, y0, x1, y1):
    return np.array([(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)], float)


@settings(max_examples=60, deadline=None)
@given(*[st.floats(-50, 50) for _ in range(4)], *[st.floats(0.5, 20) for _ in range(4)])
def test_overlay_of_boxes(ax, ay, bx, by, aw, ah, bw, bh):
    common, a, b = overlay.areas(box(ax, ay, ax + aw, ay + ah), box(bx, by, bx + bw, by + bh))
    want = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
    assert math.isclose(common, want, abs_tol=1e-6) and math.isclose(a, aw * ah, rel_tol=1e-9) and math.isclose(b, bw * bh, rel_tol=1e-9)


def test_overlay_with_a_hole_and_far_from_the_origin():
    ring = np.vstack((box(0, 0, 4, 4), box(1, 1, 3, 3))) + np.array([292000, 5035000] * 2)
    common, a, b = overlay.areas(ring, box(2, 0, 6, 4) + np.array([292000, 5035000] * 2))
    assert math.isclose(a, 12, abs_tol=1e-6) and math.isclose(b, 16, abs_tol=1e-6) and math.isclose(common, 6, abs_tol=1e-6)


def test_point_in_polygon_boundaries(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))))
    pts = spark.createDataFrame([(1, 1), (3, 3), (4, 1), (2, 3), (0, 0), (5, 5), (2, 2), (1, 2)], "x int, y int").withColumn("e", geo.ring_edges(ring))
    x, y = F.col("x"), F.col("y")
    got = pts.select(geo.contains(F.col("e"), x, y), geo.intersects(F.col("e"), x, y), geo.within(F.col("e"), x, y, 1.5)).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, True), (False, True, True), (False, True, True), (False, True, True), (False, False, False), (False, True, True), (True, True, True)]


@settings(max_examples=30, deadline=None)
@given(st.floats(-0.8, 0.8), st.floats(-0.8, 0.8), st.integers(0, 1000))
def test_planes_are_recovered(sx, sy, seed):
    r = np.random.default_rng(seed)
    xy = r.uniform(0, 10, (60, 2)) + [292000, 5035000]
    pts = np.column_stack((xy, 30 + (xy[:, 0] - 292000) * sx + (xy[:, 1] - 5035000) * sy))
    n = planes.fit_plane(pts)
    want = np.array([-sx, -sy, 1]) / math.sqrt(1 + sx * sx + sy * sy)
    assert np.allclose(n[:3], want, atol=1e-6) and planes.distance(n, pts).max() < 1e-5


def test_a_gable_has_two_planes():
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 10, 3000), r.uniform(0, 8, 3000)
    pts = np.stack((x + 292000, y + 5035000, 6 + np.minimum(y, 8 - y) / 2 + r.normal(0, 0.03, 3000)), 1)
    found = planes.detect(pts)
    assert len(found) == 2 and sum(len(rows) for _, rows in found) > 2900
    assert len(np.unique(np.concatenate([rows for _, rows in found]))) == sum(len(rows) for _, rows in found)
    slopes = [planes.slope_degrees(p) for p, _ in found]
    assert all(abs(s - math.degrees(math.atan(0.5))) < 1 for s in slopes)
    again = planes.detect(pts)
    assert all((a == b).all() and (i == j).all() for (a, i), (b, j) in zip(found, again))


def test_detection_edges():
    assert planes.detect(np.empty((0, 3))) == [] and planes.detect(np.zeros((3, 3))) == []
    assert np.isnan(planes.local_normals(np.zeros((2, 3)), 10)).all()
    with pytest.raises(ValueError):
        planes.fit_plane(np.array([[0, 0, 0], [1, 1, 1], [2, 2, 2.0]]))
    pts = np.array([[0, 0, 0], [0.5, 0, 0], [5, 0, 0], [5.5, 0, 0], [6, 0, 0]], float)
    assert planes.largest_component(pts, 0.75).tolist() == [2, 3, 4]


def test_a_failed_outline_is_a_row(spark):
    rows = [(1, i, (i % 9) / 2, (i // 9) / 2, 5.0) for i in range(200)] + [(2, 0, float("inf"), 0.0, 0.0)] * 60
    out = {(r.fid, r.plane_index): r for r in planes.detect_planes(spark.createDataFrame(rows, "fid int, pid int, x double, y double, z double"), "fid").collect()}
    assert (1, 0) in out and out[1, 0].n_points == 200 and out[2, -1].reason


def flat(h):
    return np.array([0, 0, 1, h], float)


def ring(x0, y0, x1, y1):
    return [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)]


@pytest.mark.parametrize(
    "faces, volume",
    [
        ([(flat(5), ring(0, 0, 10, 10))], 500),
        ([(np.array([0, -0.5, 1, 6.0]), ring(0, 0, 10, 4)), (np.array([0, 0.5, 1, 10.0]), ring(0, 4, 10, 8))], 560),
        ([(flat(5), ring(0, 0, 5, 5)), (flat(8), ring(5, 0, 10, 5))], 325),
        ([(np.array([0, -0.1, 1, 5.0]), ring(0, 0, 5, 5)), (flat(5.25), ring(5, 0, 10, 5))], 262.5),
        ([(flat(4), ring(0, 0, 9, 9) + [np.array([(3, 3), (3, 6), (6, 6), (6, 3)], float)]), (flat(7), ring(3, 3, 6, 6))], 4 * 72 + 7 * 9),
    ],
)
def test_solids_are_closed(faces, volume):
    solid, problems = extrude.extrude(faces, 0.0)
    assert problems == [] and math.isclose(solid.volume(), volume, rel_tol=1e-9)
    assert extrude.is_watertight(solid.rings()) and extrude.is_consistently_oriented(solid.rings())


def test_bad_solids_are_told():
    assert extrude.extrude([], 0)[1] == ["no faces"]
    assert "the roof is too near to the ground" in extrude.extrude([(flat(0.2), ring(0, 0, 5, 5))], 0)[1]
    assert not extrude.is_watertight([[0, 1, 2]])


def test_triangles_cover_a_polygon_with_a_hole():
    outer, hole = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(1, 1), (1, 2), (2, 2), (2, 1)], float)
    pts = np.vstack((outer, hole))
    t = extrude.triangulate([outer, hole])
    assert math.isclose(sum(abs(extrude._area(pts[k])) for k in t), 15) and len(t) == 8


L_SHAPE = [np.array([(0, 0), (10, 0), (10, 4), (5, 4), (5, 8), (0, 8)], float)]


def roof_points(height, seed=1, n=6000, size=(10, 8)):
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, size[0], n), r.uniform(0, size[1], n)
    keep = np.array([partition.inside(L_SHAPE, p) for p in np.stack((x, y), 1)]) if height is None else np.ones(n, bool)
    z = (6 + 0 * x if height is None else height(x, y)) + r.normal(0, 0.02, n)
    return np.stack((x, y, z), 1)[keep]


def test_convex_pieces_are_an_exact_partition():
    pieces = partition.convex_pieces(L_SHAPE)
    assert math.isclose(sum(abs(extrude._area(p)) for p in pieces), 60)
    holed = [np.array([(0, 0), (9, 0), (9, 9), (0, 9)], float), np.array([(3, 3), (6, 3), (6, 6), (3, 6)], float)]
    assert math.isclose(sum(abs(extrude._area(p)) for p in partition.convex_pieces(holed)), 72)


def test_a_gable_is_reconstructed():
    box = [np.array([(0, 0), (10, 0), (10, 8), (0, 8)], float)]
    row = partition.reconstruct(box, roof_points(lambda x, y: 6 + np.minimum(y, 8 - y) / 2), 0.0)
    assert row["status"] == "ok" and row["n_planes"] == 2 and row["n_faces"] == 2 and abs(row["volume_m3"] - 560) < 3


def test_a_step_and_a_hip_are_reconstructed():
    box = [np.array([(0, 0), (10, 0), (10, 8), (0, 8)], float)]
    hip = partition.reconstruct(box, roof_points(lambda x, y: 6 + np.minimum(np.minimum(y, 8 - y), np.minimum(x, 10 - x)) * 0.6, n=9000), 0.0)
    assert hip["status"] == "ok" and hip["n_planes"] == 4 and hip["n_faces"] == 4
    flat_l = partition.reconstruct(L_SHAPE, roof_points(None), 0.0)
    assert flat_l["status"] == "ok" and flat_l["n_faces"] == 1 and abs(flat_l["volume_m3"] - 360) < 2


def test_outlines_that_fail_are_told(spark):
    f = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}], 0.0), (2, [], 0.0)], "fid int, ring array<struct<x:double,y:double>>, ground_z double")
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)] + [(2, i, (i % 9) / 2, (i // 9) / 2, 5.0) for i in range(99)] + [(7, 1, 0.0, 0.0, 0.0)], "fid int, pid int, x double, y double, z double")
    got = {r.fid: r.status for r in partition.reconstruct_all(f, p, "fid").collect()}
    assert got == {1: "too-few-points", 2: "error"}


def test_courtyards_and_further_parts_are_reconstructed(spark):
    square = lambda x, y, w: [{"x": x + dx, "y": y + dy} for dx, dy in ((0.0, 0.0), (w, 0.0), (w, w), (0.0, w))]
    at = (300_000.0, 5_040_000.0)
    rings = {1: [square(*at, 12.0), square(at[0] + 4, at[1] + 4, 4.0)[::-1]], 2: [square(*at, 8.0), square(at[0] + 20, at[1], 8.0)]}
    r = np.random.default_rng(3)
    points = []
    for fid, width in ((1, 12), (2, 28)):
        x, y = r.uniform(0, width, 9000), r.uniform(0, 12 if fid == 1 else 8, 9000)
        keep = ~((x > 4) & (x < 8) & (y > 4) & (y < 8)) if fid == 1 else (x < 8) | (x > 20)
        points += [(fid, i, at[0] + float(a), at[1] + float(b), 6.0 + float(n)) for i, (a, b, n) in enumerate(zip(x[keep], y[keep], r.normal(0, 0.02, keep.sum())))]
    f = spark.createDataFrame([(k, v, 0.0) for k, v in rings.items()], "fid int, rings array<array<struct<x:double,y:double>>>, ground_z double")
    p = spark.createDataFrame(points, "fid int, pid int, x double, y double, z double")
    got = {x.fid: x for x in partition.reconstruct_all(f, p, "fid").collect()}
    area = lambda ring: extrude._area(np.array([(c.x, c.y) for c in ring]))
    assert got[1].status == "ok" and abs(got[1].volume_m3 - 128 * 6) < 3 and got[2].status == "ok" and abs(got[2].volume_m3 - 128 * 6) < 3
    assert got[1].n_faces == len(got[1].faces) == 1 and [round(area(x), 3) for x in got[1].faces[0].rings] == [144, -16]
    assert got[2].n_faces == len(got[2].faces) == 2 and all([round(area(x), 3) for x in face.rings] == [64] for face in got[2].faces)
    for face in (*got[1].faces, *got[2].faces):
        c = face.rings[0][0]
        assert c.x >= at[0] and c.y >= at[1] and abs((face.d - face.nx * c.x - face.ny * c.y) / face.nz - 6) < 0.1


def test_planes_are_refined_together():
    box = [np.array([(0, 0), (10, 0), (10, 8), (0, 8)], float)]
    pts = roof_points(lambda x, y: 6 + np.minimum(y, 8 - y) / 2)
    found = planes.detect(pts)
    got = topology.refine(pts, found, box)
    assert got.status == "ok" and [r[2] for r in got.relations] == ["ridge"]
    before = abs(planes.slope_degrees(found[0][0]) - planes.slope_degrees(found[1][0]))
    assert abs(planes.slope_degrees(got.planes[0]) - planes.slope_degrees(got.planes[1])) <= before + 1e-9
    line = partition.level_line(*got.planes)
    assert abs(line[0]) < 2e-3 and abs(line[2] / line[1] - 4) < 0.05


def test_a_pyramid_meets_in_one_corner():
    box = [np.array([(0, 0), (8, 0), (8, 8), (0, 8)], float)]
    pts = roof_points(lambda x, y: 6 + np.minimum(np.minimum(y, 8 - y), np.minimum(x, 8 - x)) * 0.6, n=8000, size=(8, 8))
    got = topology.refine(pts, planes.detect(pts), box)
    assert got.status == "ok" and len(got.planes) == 4 and got.corners == [(0, 1, 2, 3)]
    heights = [(p[3] - p[:2] @ [4, 4]) / p[2] for p in got.planes]
    assert np.ptp(heights) < 0.03 and abs(np.mean(heights) - 8.4) < 0.05
    assert topology.refine(pts, [], box).status == "ok"


def test_unions_of_overlapping_shapes():
    r = np.random.default_rng(5)
    for _ in range(60):
        rings = []
        for _ in range(r.integers(1, 6)):
            x, y, w, h = r.integers(0, 8), r.integers(0, 8), r.integers(1, 6), r.integers(1, 6)
            rings.append(np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float) + 1e6)
        shapes = [overlay.ring_edge_array(ring) for ring in rings]
        held = np.zeros((16, 16), bool)
        for ring in rings:
            (x0, y0), (x1, y1) = (ring.min(0) - 1e6).astype(int), (ring.max(0) - 1e6).astype(int)
            held[x0:x1, y0:y1] = True
        area = overlay.region_areas([shapes], lambda m: m[0])[0]
        edges = overlay.union_edges(shapes)
        assert abs(area - held.sum()) < 1e-6
        assert abs(overlay.region_areas([[edges]], lambda m: m[0])[0] - area) < 1e-6


def test_nearest_medians_are_those_of_all_pairs():
    from skyfold.functions import shapes

    r = np.random.default_rng(1)
    for t in range(120):
        n, m, k = r.integers(1, 60), r.integers(1, 200), r.integers(1, 9)
        q, g, v = r.integers(0, 30, (n, 2)).astype(float), r.integers(0, 30, (m, 2)).astype(float), r.normal(size=m)
        g[:, 0] += 500 * (t % 3 == 0)
        d2 = ((q[:, None] - g[None]) ** 2).sum(2)
        assert np.allclose(shapes.nearest_median(q, g, v, k), [np.median(v[np.lexsort((np.arange(m), d2[i]))[:k]]) for i in range(n)])


def _square(spark, size=10.0):
    c = [(0.0, 0.0), (size, 0.0), (size, size), (0.0, size)]
    return spark.createDataFrame([(1, [(*a, *b) for a, b in zip(c, c[1:] + c[:1])])], "fid int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def test_elevated_points_need_ground(spark):
    from skyfold.operators import clip

    rows = [(1, 5.0, 5.0, 40.0, 6), (2, 6.0, 5.0, 40.0, 1), (3, 6.0, 6.0, 30.2, 28), (4, 6.0, 7.0, 40.0, 5), (5, 30.0, 5.0, 40.0, 6), (6, 10.0, 10.0, 40.0, 6)]
    columns = "pid int, x double, y double, z double, cls int"
    cut = lambda rows: sorted(r.pid for r in clip.clip(spark.createDataFrame(rows, columns), _square(spark), 20.0, 2.0, 1.5).collect())
    assert cut(rows) == [1, 6]
    assert cut([*rows, (7, 11.5, 5.0, 30.0, 2)]) == [1, 2, 6]
    assert cut([*rows, (7, 12.5, 5.0, 30.0, 2)]) == [1, 6]  # too far away
    assert cut([]) == []


def test_a_point_of_an_unknown_class_is_an_error(spark):
    from skyfold.operators import clip

    with pytest.raises(Exception, match="unknown class 17"):
        clip.clip(spark.createDataFrame([(1, 5.0, 5.0, 40.0, 17)], "pid int, x double, y double, z double, cls int"), _square(spark), 20.0, 2.0, 1.5).collect()


def test_a_step_between_two_flat_roofs_is_cut():
    xy = np.array([(0.125 + i / 4, 0.125 + j / 4) for i in range(48) for j in range(32)])
    points = np.column_stack((xy, np.where(xy[:, 0] < 7, 44.0, 48.0)))
    outline = [np.array([(0, 0), (12, 0), (12, 8), (0, 8)], float)]
    row = partition.reconstruct(outline, points, 30.0)
    assert row["status"] == "ok" and row["n_faces"] == 2 and abs(row["volume_m3"] - (7 * 8 * 14 + 5 * 8 * 18)) < 1e-6
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    row = partition.reconstruct([outline[0] @ turn.T], np.column_stack((xy @ turn.T, points[:, 2])), 30.0)
    assert row["status"] == "ok" and abs(row["volume_m3"] - (7 * 8 * 14 + 5 * 8 * 18)) < 1.0


def test_rings_of_several_lengths_pass_through_kernels(spark):
    from skyfold.operators import area_scene, assessment

    outer, hole = [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (4.0, 9.0), (0.0, 9.0)], [(1.0, 1.0), (3.0, 1.0), (1.0, 3.0)]
    kind = "array<array<struct<x:double,y:double>>>"
    faces = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 6.0, [outer, hole], 0.0)], f"fid int, face int, nx double, ny double, nz double, d double, rings {kind}, ground_z double")
    solid = extrude.extrude_faces(faces, "fid").first()
    assert solid.watertight and abs(solid.volume_m3 - 6 * (81 - 12.5 - 2)) < 1e-9 and not solid.problems
    xyz = [[(*p, 6.0) for p in r] for r in (outer, hole)]
    flat = area_scene.triangles(spark.createDataFrame([("a", xyz)], "k string, rings array<array<struct<x:double,y:double,z:double>>>"), "k").toPandas()
    t = flat[["x", "y"]].to_numpy().reshape(-1, 3, 2)
    assert abs(np.abs(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])).sum() / 2 - 66.5) < 1e-9
    pair = spark.createDataFrame([("b", [(0, 0.0, 0.0, 1.0, [outer, hole])], xyz)], f"building_id string, faces array<struct<plane_index:int,nx:double,ny:double,nz:double,rings:{kind}>>, roofs array<array<struct<x:double,y:double,z:double>>>")
    got = assessment.structure(pair).first()
    assert (got.n_pred_planes, got.n_ref_planes, got.n_unmatched_pred, got.n_unmatched_ref) == (1, 2, 0, 1) and got.orientation_errors_deg == [0.0]
    points = spark.createDataFrame([(1, str(i), x, y, 6.0) for i, (x, y) in enumerate((0.2 + a / 3, 0.2 + b / 3) for a in range(26) for b in range(26))], "fid int, pid string, x double, y double, z double")
    shape = spark.createDataFrame([(1, [outer, hole], 0.0)], f"fid int, rings {kind}, ground_z double")
    assert partition.reconstruct_all(shape, points, "fid").first().status == "ok"


def test_regions_and_small_ones_merged():
    from skyfold.operators import regions

    grid = ["aaabbb", "aacbbb", "aaabbd", "eaa bb"]
    cells = np.array([(x, y) for y, row in enumerate(grid) for x, c in enumerate(row) if c != " "])
    labels = np.array([ord(c) for row in grid for c in row if c != " "])
    mix = np.random.default_rng(3).permutation(len(cells))
    cells, labels = cells[mix], labels[mix]
    first = regions.regions(cells, labels)
    assert {(*map(int, cells[f]), chr(labels[f]), int((first == f).sum())) for f in np.unique(first)} == {(0, 0, "a", 10), (3, 0, "b", 10), (2, 1, "c", 1), (5, 2, "d", 1), (0, 3, "e", 1)}
    merged = regions.merge_small(cells, labels, 4)
    told = {(x, y): chr(v) for (x, y), v in zip(cells.tolist(), merged.tolist())}
    assert (told[2, 1], told[5, 2], told[0, 3]) == ("a", "b", "a") and set(told.values()) == {"a", "b"}
    alone = regions.merge_small(np.array([(0, 0), (5, 5)]), np.array([1, 2]), 9)
    assert alone.tolist() == [1, 2] and len(regions.regions(np.empty((0, 2), np.int64), np.empty(0, np.int64))) == 0
