"""Assessment of an area: from outlines, reconstructions, reference roofs and roof points to the
rows of building_results.

Buildings are given to outlines by the largest share, scored on cells of a global grid, and
their planes matched with the reference's. Cells, points and faces meet by equality of keys
and bins; only polygon overlays (a building's own, bounded by its roof) run in kernels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import geo, overlay
from skyfold.operators import clip, evaluation, planes, spatial

# The evaluation's cell, the least overlap of a pair of planes and the least share of a counted face.
CELL_M, PLANE_IOU, FACE_SHARE = 0.5, 0.3, 0.5
_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
_RINGS = "array<array<struct<x:double,y:double>>>"


def roof_outlines(roofs: DataFrame, key: str = "building_id") -> DataFrame:
    """(key, edges, outline_area_m2): the union in plan of each building's roof rings (x, y, ...). Rings of no area add nothing."""
    kind = roofs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shapes = [overlay.ring_edge_array(np.array([(c["x"], c["y"]) for c in ring])) for ring in group.sort_values("ordinal")["ring"] if len(ring) >= 3]
        shapes = [e for e in shapes if len(e) >= 3 and overlay.region_areas([[e]], lambda held: held[0])[0] > 0]
        edges = overlay.union_edges(shapes)
        area = overlay.region_areas([shapes], lambda held: held[0])[0] if shapes else 0.0
        rows = [{"x1": a, "y1": b, "x2": c, "y2": d} for a, b, c, d in edges.tolist()]
        return pd.DataFrame({key: [group[key].iloc[0]], "edges": [rows], "outline_area_m2": [area]})

    return roofs.select(key, "ordinal", "ring").groupBy(key).applyInPandas(run, f"{key} {kind}, edges {_EDGES}, outline_area_m2 double")


def reference_faces(roofs: DataFrame) -> DataFrame:
    """Roofs (building_id, ordinal, ring of x, y, z) with edges and the plane through the ring; upright ones have none and are left out."""
    size = F.size("ring")
    mean = lambda c: F.aggregate(F.transform("ring", lambda p: p[c]), F.lit(0.0), lambda a, v: a + v) / size
    out = roofs.withColumn("_n", geo.newell(F.col("ring"))).where(F.abs(F.col("_n.nz")) > 1e-6 * geo.norm(F.col("_n")))
    d = F.col("_n.nx") * mean("x") + F.col("_n.ny") * mean("y") + F.col("_n.nz") * mean("z")
    plane = F.struct(F.col("_n.nx").alias("nx"), F.col("_n.ny").alias("ny"), F.col("_n.nz").alias("nz"), d.alias("d"))
    return out.withColumn("plane", plane).withColumn("edges", geo.ring_edges(F.transform("ring", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))).drop("_n")


def structure(pairs: DataFrame) -> DataFrame:
    """Plane and face scores of each row (building_id, faces, roofs): faces of the reconstruction (plane_index, nx, ny, nz, rings)
    against the reference's rings (x, y, z).

    Predicted planes are clipped to the building. Pairs that overlap by PLANE_IOU are matched one to one, the
    smallest angle first. A predicted face counts where FACE_SHARE of it lies in the building.
    """
    schema = (
        "building_id string, orientation_errors_deg array<double>, n_pred_planes int, n_ref_planes int, n_unmatched_pred int, n_unmatched_ref int, "
        "n_pred_faces int, n_ref_faces int, face_count_agreement double"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def score(faces, roofs) -> tuple:
        reference, every = [], []
        for ring in roofs:
            ring = np.array([(c["x"], c["y"], c["z"]) for c in ring["p"]], float)
            e, n = overlay.ring_edge_array(ring), _newell(ring)
            if np.linalg.norm(n) == 0:
                continue
            every.append(n)
            if abs(n[2]) >= 1e-6 * np.linalg.norm(n) and len(e) >= 3:
                reference.append((n, e))
        outline = [e for _, e in reference]
        planes_of: dict[int, tuple] = {}
        counted = 0
        for f in faces:
            e = np.vstack([overlay.ring_edge_array(np.array([(c["x"], c["y"]) for c in r["p"]])) for r in f["rings"]])
            whole, held = overlay.region_areas([[e], outline], lambda m: m[0], lambda m: m[0] & m[1])
            counted += whole > 0 and held >= FACE_SHARE * whole
            if held > 0:
                planes_of.setdefault(f["plane_index"], (np.array([f["nx"], f["ny"], f["nz"]]), []))[1].append(e)
        found = []
        for i, (n, own) in enumerate(planes_of[k] for k in sorted(planes_of)):
            for j, (m, e) in enumerate(reference):
                common, either = overlay.region_areas([own, outline, [e]], lambda h: h[0] & h[1] & h[2], lambda h: (h[0] & h[1]) | h[2])
                if either > 0 and common / either >= PLANE_IOU:
                    found.append((planes.angle_degrees(n, m), i, j))
        angles, taken_i, taken_j = [], set(), set()
        for angle, i, j in sorted(found):
            if i not in taken_i and j not in taken_j:
                angles.append(float(angle))
                taken_i.add(i)
                taken_j.add(j)
        n_ref = len(every)
        agreement = min(counted, n_ref) / max(counted, n_ref) if max(counted, n_ref) else 1.0
        return angles, len(planes_of), len(reference), len(planes_of) - len(angles), len(reference) - len(angles), int(counted), n_ref, agreement

    def run(batches):
        for batch in batches:
            rows = [(b, *score(f, r)) for b, f, r in zip(batch["building_id"], batch["faces"], batch["roofs"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    faces = F.transform("faces", lambda f: F.struct(*(f[c].alias(c) for c in ("plane_index", "nx", "ny", "nz")), geo.wrapped(f["rings"]).alias("rings")))
    return pairs.select("building_id", faces.alias("faces"), geo.wrapped(F.col("roofs")).alias("roofs")).mapInPandas(run, schema)


def _newell(ring: np.ndarray) -> np.ndarray:
    ring = ring - ring[0]
    return np.cross(ring, np.roll(ring, -1, axis=0)).sum(axis=0) / 2


def scored_cells(outlines: DataFrame, reference: DataFrame, predicted: DataFrame, lidar: DataFrame, bin_size: float = 20.0) -> DataFrame:
    """(building_id, cx, cy, z_ref, z_pred, z_lidar) of the cells of outlines (building_id, footprint_id, edges). Faces of both
    kinds (building_id, edges, plane) meet the cells in one join and one aggregation; lidar: (footprint_id, cx, cy, z_lidar)."""
    kinds = [f.select("building_id", "edges", "plane", F.lit(is_ref).alias("is_ref")) for f, is_ref in ((reference, True), (predicted, False))]
    tops = spatial.surfaces(spatial.cells_of(outlines, CELL_M, CELL_M), kinds[0].unionByName(kinds[1]), ["building_id"], bin_size)
    return tops.join(lidar, ["footprint_id", "cx", "cy"], "left").select("building_id", "cx", "cy", "z_ref", "z_pred", "z_lidar")


def evaluate(footprints: DataFrame, reconstructions: DataFrame, buildings: DataFrame, roofs: DataFrame, roof_points: DataFrame) -> DataFrame:
    """A row for every reference building, and one for every outline that none was given to.

    footprints: footprint_id, lidar_derived, edges. reconstructions: footprint_id, status, reason, warnings, density, faces.
    buildings: building_id, is_grouped. roofs: building_id, ordinal, ring, area_m2, slope_deg. roof_points: footprint_id, x, y, z.
    """
    outlines = roof_outlines(roofs).persist()  # a row a building; kernels run once
    own = buildings.join(outlines, "building_id", "left")
    single = own.where("not is_grouped")
    shares = clip.assign(footprints.select("footprint_id", "edges"), single.select("building_id", "edges").where("edges is not null"), 20.0, name="footprint_id").persist()
    given = shares.join(reconstructions, "footprint_id", "left").withColumn("status", F.coalesce("status", F.lit("error")))
    ok = given.where("status = 'ok'")
    face = F.col("f")
    predicted = ok.select("building_id", F.explode("faces").alias("f")).select(
        "building_id", F.flatten(F.transform(face["rings"], geo.ring_edges)).alias("edges"), F.struct(face["nx"].alias("nx"), face["ny"].alias("ny"), face["nz"].alias("nz"), face["d"].alias("d")).alias("plane")
    )
    medians = spatial.cell_median(roof_points, ["footprint_id"], CELL_M)
    cells = scored_cells(single.select("building_id", "edges").join(shares.select("building_id", "footprint_id"), "building_id"), reference_faces(roofs), predicted, medians)
    scores = evaluation.score_cells(cells, ["building_id"])
    listed = roofs.groupBy("building_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "ring"))), lambda r: r["ring"]).alias("roofs"))
    planes_of = structure(ok.select("building_id", "faces").join(listed, "building_id"))
    types = clip.roof_summary(roofs, "building_id").select("building_id", "roof_type")
    rows = own.select("building_id", "is_grouped", "outline_area_m2").join(types, "building_id", "left").join(given.drop("faces"), "building_id", "left").join(footprints.select("footprint_id", "lidar_derived"), "footprint_id", "left")
    rows = rows.join(scores, "building_id", "left").join(planes_of, "building_id", "left")
    status = F.when(F.col("is_grouped"), "grouped-reference").when(F.col("share").isNull(), "no-match").otherwise(evaluation.temporal_status(F.col("status"), F.col("temporal_offset_m")))
    median = F.expr("percentile(a, 0.5)")
    middle = rows.select("building_id", F.explode("orientation_errors_deg").alias("a")).groupBy("building_id").agg(median.alias("orientation_median_deg"))
    assigned = F.col("share").isNotNull()
    rows = rows.join(middle, "building_id", "left").select(
        "building_id", "footprint_id", status.alias("status"), "roof_type", "outline_area_m2", "share", F.col("density").alias("point_density"), "lidar_derived",
        *(F.when(assigned, F.coalesce(c, F.lit(0))).cast("int").alias(c) for c in ("n_ref_cells", "n_valid_cells")), F.when(assigned, F.coalesce("sum_sq_m2", F.lit(0.0))).alias("sum_sq_m2"),
        "rmse_m", "coverage", "temporal_offset_m", "bias_m", "n_cells", "n_bad", "bad_median_m", "rest_rmse_m", "orientation_errors_deg", "orientation_median_deg",
        "n_pred_planes", "n_ref_planes", "n_unmatched_pred", "n_unmatched_ref", "n_pred_faces", "n_ref_faces", "face_count_agreement", "reason", "warnings",
    )
    unused = footprints.join(shares.select("footprint_id").distinct(), "footprint_id", "left_anti").join(reconstructions.select("footprint_id", "density", "reason", "warnings"), "footprint_id", "left")
    unused = unused.select(F.col("footprint_id").cast("string").alias("building_id"), "footprint_id", F.lit("no-reference").alias("status"), F.col("density").alias("point_density"), "lidar_derived", "reason", "warnings")
    return rows.unionByName(unused, allowMissingColumns=True)
