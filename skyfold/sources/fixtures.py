"""A small set of outlines with their points and reference, as files, and the guard that scores them.

A folder holds index.json, footprints/<id>.geojson, points/<id>.las and reference/<id>.json, and
baseline_metrics.json with the metrics and tolerances to hold against.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import assessment, clip, evaluation, partition, spatial
from skyfold.sources import footprints as shapes
from skyfold.sources import las, sinks

# Names of files, and ground around an outline that is cut out with it.
INDEX, BASELINE, CONTEXT_M = "index.json", "baseline_metrics.json", 2.0
_REFERENCE = "footprint_id string, buildings array<struct<gml_id:string,share_in_footprint:double,roof_polygons:array<array<array<double>>>>>"


def _millimetres(values) -> list:
    return [round(float(v), 3) for v in values]


def write(folder: str, footprints: DataFrame, points: DataFrame, shares: DataFrame, roofs: DataFrame) -> int:
    """Write fixtures of the outlines given; their number. What comes to the driver is a fixture set, an outline at a time.

    footprints: footprint_id, lidar_derived, rings, edges. points: pid, x, y, z, cls. shares: building_id, footprint_id,
    share. roofs: building_id, ordinal, ring.
    """
    for part in ("footprints", "points", "reference"):
        os.makedirs(os.path.join(folder, part), exist_ok=True)
    near = spatial.points_in_shapes(points, footprints.select(F.col("footprint_id").alias("fid"), "edges"), 20.0, CONTEXT_M).drop("edges")
    cut = near.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pid", "x", "y", "z", "cls"))).alias("points"))
    own = roofs.groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "ring"))).alias("roofs")).join(shares, "building_id")
    own = own.groupBy("footprint_id").agg(F.array_sort(F.collect_list(F.struct("building_id", "share", "roofs"))).alias("buildings"))
    rows = footprints.select("footprint_id", "lidar_derived", "rings").join(cut.withColumnRenamed("fid", "footprint_id"), "footprint_id", "left").join(own, "footprint_id", "left").orderBy("footprint_id")
    listed = []
    for r in rows.toLocalIterator():
        rings = [[_millimetres(p) for p in ring] for ring in r.rings]
        feature = {"type": "Feature", "properties": {"footprint_id": r.footprint_id, "lidar_derived": bool(r.lidar_derived)}, "geometry": {"type": "Polygon", "coordinates": rings}}
        with open(os.path.join(folder, "footprints", f"{r.footprint_id}.geojson"), "w") as f:
            json.dump({"type": "FeatureCollection", "features": [feature]}, f, indent=1)
        found = r.points or []
        las.write_las(os.path.join(folder, "points", f"{r.footprint_id}.las"), np.array([(p.x, p.y, p.z) for p in found], float).reshape(-1, 3), np.array([p.cls for p in found], np.uint8))
        buildings = [{"gml_id": b.building_id, "share_in_footprint": round(b.share, 3), "roof_polygons": [[_millimetres(p) for p in s.ring] for s in b.roofs]} for b in r.buildings or []]
        with open(os.path.join(folder, "reference", f"{r.footprint_id}.json"), "w") as f:
            json.dump({"footprint_id": r.footprint_id, "buildings": buildings}, f, indent=1)
        xy = np.array(r.rings[0])
        listed.append({"footprint_id": r.footprint_id, "lidar_derived": bool(r.lidar_derived), "bbox": _millimetres([*xy.min(0), *xy.max(0)]), "n_points": len(found), "reference_buildings": [b["gml_id"] for b in buildings]})
    with open(os.path.join(folder, INDEX), "w") as f:
        json.dump({"source": {"context_m": CONTEXT_M}, "footprints": listed}, f, indent=1)
    return len(listed)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(footprints, points with footprint_id, buildings, roofs) of a folder. A fixture's points belong to its outline alone."""
    outlines = shapes.read_geojson(spark, os.path.join(folder, "footprints"))
    points = las.read_points(spark, os.path.join(folder, "points"), classes=clip.USED)
    points = points.select(F.col("tile").alias("footprint_id"), F.concat_ws("|", "tile", F.col("point_id").cast("string")).alias("pid"), "x", "y", "z", F.col("classification").cast("int").alias("cls"))
    told = spark.read.schema(_REFERENCE).option("multiLine", True).json(os.path.join(folder, "reference")).select(F.explode("buildings").alias("b")).select("b.*").dropDuplicates(["gml_id"])
    buildings = told.select(F.col("gml_id").alias("building_id"), F.lit(False).alias("is_grouped"))
    ring = F.transform("p", lambda v: F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z")))
    roofs = told.select(F.col("gml_id").alias("building_id"), F.posexplode("roof_polygons").alias("ordinal", "p")).where(F.size("p") >= 4).select("building_id", "ordinal", ring.alias("ring"))
    return outlines, points, buildings, roofs.withColumn("area_m2", geo.ring_area(F.col("ring"))).withColumn("slope_deg", geo.slope_degrees(geo.newell(F.col("ring"))))


def load_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """(metric, baseline, tolerance) of the baseline's headline metrics; no row without the file."""
    path = os.path.join(folder, BASELINE)
    if not os.path.exists(path):
        return spark.createDataFrame([], "metric string, baseline double, tolerance double")
    with open(path) as f:
        told = json.load(f)
    metrics, tolerances = (told.get("metrics") or {}).get("overall") or {}, told.get("tolerances") or {}
    number = lambda v: None if v is None else float(v)
    names = sorted(n for n in {*metrics, *tolerances} if not n.startswith("_"))
    return spark.createDataFrame([(n, number(metrics.get(n)), number(tolerances.get(n))) for n in names], "metric string, baseline double, tolerance double")


def evaluate(spark: SparkSession, folder: str, params=None) -> DataFrame:
    """building_results of a fixture folder, from its points on."""
    outlines, points, buildings, roofs = load(spark, folder)
    outlines = outlines.persist()
    roof = clip.clip(points.drop("footprint_id"), outlines.select(F.col("footprint_id").alias("fid"), "edges"), 20.0, CONTEXT_M, 1.5)
    roof = roof.where(F.substring_index("pid", "|", 1) == F.col("fid")).persist()
    ground = points.groupBy(F.col("footprint_id").alias("fid")).agg(clip.floor_height("z", "cls").alias("ground_z"))
    shaped = outlines.select(F.col("footprint_id").alias("fid"), "rings").join(ground, "fid", "left").fillna(0.0, ["ground_z"])
    area = F.abs(F.aggregate("edges", F.lit(0.0), lambda a, e: a + e.x1 * e.y2 - e.x2 * e.y1)) / 2
    made = partition.reconstruct_all(shaped, roof.select("fid", "pid", "x", "y", "z"), "fid", params).withColumnRenamed("fid", "footprint_id")
    made = made.join(outlines.select("footprint_id", area.alias("_area")), "footprint_id").withColumn("density", F.try_divide("n_points", "_area"))
    made = made.select("footprint_id", "status", "reason", "warnings", "density", "faces").persist()
    return assessment.evaluate(outlines.select("footprint_id", "lidar_derived", "edges"), made, buildings, roofs, roof.select(F.col("fid").alias("footprint_id"), "x", "y", "z"))


def smoke(spark: SparkSession, folder: str, out: str, params=None) -> bool:
    """Score the fixtures, hold the metrics against the baseline, and write metrics.json, buildings and report.md; whether
    the guard fails. Without fixtures the report says so; without a baseline nothing fails."""
    os.makedirs(out, exist_ok=True)
    report = os.path.join(out, "report.md")
    if not os.path.exists(os.path.join(folder, INDEX)) or not os.path.isdir(os.path.join(folder, "points")):
        with open(report, "w") as f:
            f.write(sinks.pending_report(f"{folder} has no fixtures with points"))
        return False
    rows = evaluate(spark, folder, params).persist()
    overall = evaluation.summarise(rows).first().asDict(recursive=True)
    by_type = {r.roof_type: r.asDict(recursive=True) for r in evaluation.summarise(rows.where("roof_type is not null"), ["roof_type"]).collect()}
    with open(os.path.join(out, "metrics.json"), "w") as f:
        json.dump({"overall": overall, "by_roof_type": by_type}, f, indent=2)
    sinks.write_csv(rows, os.path.join(out, "buildings.csv"), ("orientation_errors_deg",))
    measured = spark.createDataFrame([(k, float(v)) for k, v in overall.items() if isinstance(v, (int, float))], "metric string, value double")
    baseline = load_baseline(spark, folder)
    gating = bool(evaluation.baseline_is_set(baseline).first().gating)
    compared = evaluation.regressions(baseline, measured)
    with open(report, "w") as f:
        f.write(sinks.smoke_report(compared, gating))
    return gating and compared.where("regressed").count() > 0
