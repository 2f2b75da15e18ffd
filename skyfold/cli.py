"""Command line: ``python -m skyfold``. Each command is one job over the tables of an area."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

from skyfold.operators import evaluation
from skyfold.sources import archive, config, sinks

VERSION = "0.1.0"


def _human(size: float | None) -> str:
    for unit in ("B", "kB", "MB", "GB"):
        if size is None or size < 1000:
            break
        size /= 1000
    return "?" if size is None else f"{size:.0f} {unit}"


def plan(area: config.Entry, manifest: dict[str, config.Source], raw: str) -> list[dict]:
    """What an area needs: each member with its archive, its file here, its size and whether it is pinned and present."""
    wanted = [(f"{t}_2015.las", config.lidar_archive_for(t, manifest)) for t in area.bbox.lidar_tiles()]
    wanted += [(m, config.reference_archive_for(m, manifest)) for m in area.reference_tiles]
    out = []
    for key, source in wanted:
        member = source.member(key)
        path = os.path.join(raw, member.artifact)
        out.append({"key": key, "source": source.key, "url": source.url, "path": path, "size": member.size, "sha256": member.sha256, "present": os.path.exists(path)})
    return out


def lidar_paths(raw: str, tiles: list[str]) -> list[str]:
    paths = [os.path.join(raw, f"{t}_2015.las") for t in tiles]
    missing = [p for p in paths if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(f"missing point files: {', '.join(map(os.path.basename, missing))}")
    return paths


def fetch(items: list[dict], agent: str, force: bool = False) -> int:
    """Get what is not here or not what was pinned; one more try after a mismatch."""
    failed = 0
    for item in items:
        for _ in range(2):
            if item["present"] and not force and config.verify(item["path"], item["sha256"]):
                break
            remote = archive.Archive(archive.open_url(item["url"], agent))
            remote.extract(remote.member(item["key"]), item["path"])
            item["present"] = True
        failed += not config.verify(item["path"], item["sha256"])
    return failed


def _session(master: str | None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("skyfold").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


def load(tables: sinks.AreaTables, area: config.Entry, footprints: str, layer: str, gml: str, margin: float = 50.0) -> dict[str, int]:
    """Replace an area's inputs; what was derived from the old ones goes with them."""
    from pyspark.sql import functions as F

    from skyfold.sources import citygml
    from skyfold.sources import footprints as shapes

    b = area.bbox
    box = (b.xmin - margin, b.ymin - margin, b.xmax + margin, b.ymax + margin)
    outlines = shapes.read_shapefile(tables.spark, footprints, layer, box) if footprints.endswith(".zip") else shapes.read_geojson(tables.spark, footprints)
    buildings = citygml.read_buildings(tables.spark, gml)
    counts = tables.replace(area.name, {"footprints": outlines, "reference_buildings": buildings.withColumn("n_roof_surfaces", F.size("roofs")).drop("roofs"), "reference_roof_surfaces": citygml.roof_surfaces(buildings)})
    if area.expected_buildings is not None and counts["reference_buildings"] != area.expected_buildings:
        raise ValueError(f"{counts['reference_buildings']} reference buildings, {area.expected_buildings} expected")
    return counts


def _points(spark, area, raw: str):
    """The area's points of the classes in use: pid, x, y, z, cls."""
    from pyspark.sql import functions as F

    from skyfold.operators import clip
    from skyfold.sources import las

    lidar_paths(raw, area.bbox.lidar_tiles())
    b = area.bbox
    found = las.read_points(spark, raw, classes=clip.USED, bbox=(b.xmin - 50, b.ymin - 50, b.xmax + 50, b.ymax + 50))
    return found.select(F.concat_ws("|", "tile", F.col("point_id").cast("string")).alias("pid"), "x", "y", "z", F.col("classification").cast("int").alias("cls"))


def _area_of(edges):
    from pyspark.sql import functions as F

    return F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + e.x1 * e.y2 - e.x2 * e.y1)) / 2


#: Outlines that are reconstructed and committed together.
BATCH = 2_000


def reconstruct(tables: sinks.AreaTables, area, raw: str, limit: int | None, force: bool, batch: int = BATCH) -> dict:
    """Reconstruct the outlines that have no row yet, and commit a batch of rows, faces and solids at a time."""
    from pyspark.sql import functions as F

    from skyfold.functions import solids
    from skyfold.operators import clip, partition, spatial

    began, spark, run_id = time.time(), tables.spark, sinks.new_run_id()
    made = ("reconstructions", "roof_faces", "roof_points", "solids")
    if force:
        tables.replace(area.name, {}, keep=tuple(n for n in tables.current(area.name) if n not in (*made, "building_results")))
    shapes = tables.table(area.name, "footprints")
    done = None if "reconstructions" not in tables.current(area.name) else tables.table(area.name, "reconstructions")
    todo = sinks.resume(shapes, done, limit)
    points, total = _points(spark, area, raw), todo.count()
    part = F.pmod(F.xxhash64("footprint_id"), F.lit(max(1, -(-total // batch))))
    for k in range(max(1, -(-total // batch)) if total else 0):
        own = todo.where(part == k)
        outlines = own.select(F.col("footprint_id").alias("fid"), "edges")
        roof = clip.clip(points, outlines, bin_size=20.0, margin=2.0, height=1.5).persist()
        near = spatial.points_in_shapes(points, outlines, 20.0, 2.0)
        ground = near.groupBy("fid").agg(clip.floor_height("z", "cls").alias("ground_z"))
        shaped = own.select(F.col("footprint_id").alias("fid"), "rings").join(ground, "fid", "left").fillna(0.0, ["ground_z"])
        rows = partition.reconstruct_all(shaped, roof.select("fid", "pid", "x", "y", "z"), "fid", area.planes, area.topology).withColumnRenamed("fid", "footprint_id")
        rows = rows.join(own.select("footprint_id", _area_of(F.col("edges")).alias("_area")), "footprint_id").withColumn("density", F.coalesce(F.try_divide("n_points", "_area"), F.lit(0.0)))
        rows = rows.drop("_area").withColumn("run_id", F.lit(run_id)).persist()
        tables.append(
            area.name, "reconstructions", rows.drop("faces", "solid"),
            roof_faces=rows.select("footprint_id", F.inline("faces")),
            roof_points=roof.select(F.col("fid").alias("footprint_id"), "x", "y", "z", "cls"),
            solids=rows.where("solid is not null").select("footprint_id", solids.polyhedral_wkt(F.col("solid.surfaces"), F.col("solid.vertices")).alias("wkt"), F.transform("solid.surfaces", lambda x: x["kind"]).alias("surface_kinds")),
        )
        rows.unpersist(), roof.unpersist()
    status = {}
    if "reconstructions" in tables.current(area.name):
        status = {r.status: r["count"] for r in tables.table(area.name, "reconstructions").where(F.col("run_id") == run_id).groupBy("status").count().collect()}
    return {"run_id": run_id, "area": area.name, "rows": sum(status.values()), "status": status, "seconds": round(time.time() - began, 1)}


def evaluate(tables: sinks.AreaTables, area) -> int:
    """Score the area's reconstructions against its reference and replace building_results; the number of rows."""
    from pyspark.sql import functions as F

    from skyfold.operators import assessment

    t = lambda name: tables.table(area.name, name)
    face = F.struct("face", "plane_index", "nx", "ny", "nz", "d", "rings")
    faces = t("roof_faces").groupBy("footprint_id").agg(F.array_sort(F.collect_list(face)).alias("faces"))
    made = t("reconstructions").select("footprint_id", "status", "reason", "warnings", "density").join(faces, "footprint_id", "left")
    made = made.withColumn("faces", F.coalesce("faces", F.array().cast(faces.schema["faces"].dataType)))
    buildings = t("reference_buildings").select(F.col("gml_id").alias("building_id"), "is_grouped")
    roofs = t("reference_roof_surfaces").select(F.col("gml_id").alias("building_id"), "ordinal", "ring", "area_m2", "slope_deg")
    rows = assessment.evaluate(t("footprints").select("footprint_id", "lidar_derived", "edges"), made, buildings, roofs, t("roof_points"))
    keep = tuple(n for n in tables.current(area.name) if n != "building_results")
    return tables.replace(area.name, {"building_results": rows.withColumn("area", F.lit(area.name))}, keep=keep)["building_results"]


def build_fixtures(tables: sinks.AreaTables, area, raw: str, folder: str, most: int) -> int:
    """Write the outlines with reference buildings, up to a number asked for, as fixtures."""
    from pyspark.sql import functions as F

    from skyfold.sources import fixtures

    results = tables.table(area.name, "building_results").where("share is not null")
    wanted = results.select("footprint_id").distinct().orderBy("footprint_id").limit(most)
    roofs = tables.table(area.name, "reference_roof_surfaces").select(F.col("gml_id").alias("building_id"), "ordinal", "ring")
    return fixtures.write(folder, tables.table(area.name, "footprints").join(wanted, "footprint_id", "left_semi"), _points(tables.spark, area, raw), results.select("building_id", "footprint_id", "share"), roofs)


def export_scene(tables: sinks.AreaTables, area, out: str) -> dict:
    """Write scene.json and scene.bin of an evaluated area. What comes to the driver is the sample of points and one area's roofs."""
    import json

    from pyspark.sql import functions as F

    from skyfold.operators import area_scene

    t = lambda name: tables.table(area.name, name)
    results = t("building_results") if "building_results" in tables.current(area.name) else tables.spark.createDataFrame([], "footprint_id string, building_id string, status string, sum_sq_m2 double, n_valid_cells int, rmse_m double, coverage double, share double")
    outlines = [json.loads(x) for x in area_scene.listed(t("footprints"), t("reconstructions"), results).toJSON().collect()]
    roofs = t("reference_roof_surfaces")
    owners = tables.spark.createDataFrame([(f["footprint_id"], i) for i, f in enumerate(outlines)], "footprint_id string, owner int")
    own = area_scene.triangles(area_scene.raised(t("roof_faces")), "footprint_id").join(F.broadcast(owners), "footprint_id")
    points = area_scene.sample(area_scene.without_outliers(t("roof_points"), roofs), area_scene.QUOTAS)
    reference = area_scene.triangles(roofs.select("gml_id", F.array("ring").alias("rings")), "gml_id").withColumn("owner", F.lit(65535))
    shown = own.select("x", "y", "z", "owner").unionByName(reference.select("x", "y", "z", "owner"))
    return sinks.export_scene(points, shown, os.path.join(out, "scene"), lambda: {"area": area.name, "footprints": outlines})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("skyfold")
    p.add_argument("--areas", default="configs/areas"), p.add_argument("--manifest", default="data/manifest.yaml")
    p.add_argument("--raw", default="data/raw"), p.add_argument("--tables", default="data/tables"), p.add_argument("--out", default="data/out"), p.add_argument("--master")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("version"), c.add_parser("areas"), c.add_parser("export")
    for name in ("plan", "fetch", "verify", "checksums", "load", "reconstruct", "evaluate", "report", "export-scene", "fixtures"):
        q = c.add_parser(name)
        q.add_argument("-a", "--area", required=name != "evaluate")
        if name in ("evaluate", "fixtures"):
            q.add_argument("--fixtures", default="tests/fixtures")
        if name == "evaluate":
            q.add_argument("--smoke", action="store_true")
        if name == "fixtures":
            q.add_argument("--most", type=int, default=20)
        if name in ("fetch", "reconstruct"):
            q.add_argument("--force", action="store_true")
        if name == "reconstruct":
            q.add_argument("--limit", type=int)
        if name == "load":
            q.add_argument("--footprints", required=True), q.add_argument("--layer", default="CARTO-BAT-TOIT"), q.add_argument("--gml", required=True)
        if name == "report":
            q.add_argument("--gallery", type=int, default=20)
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "areas":
        for path in sorted(glob.glob(os.path.join(a.areas, "*.yaml"))):
            area = config.StudyArea.load(os.path.basename(path)[:-5], a.areas)
            print(f"{area.name}\t{area.borough}\t{area.bbox.area_km2:.2f} km²\t{len(area.bbox.lidar_tiles())} tiles")
        return 0
    if a.command == "export":
        raise NotImplementedError("3D Tiles are not written; reports and scenes are")
    if a.command == "evaluate" and a.smoke:
        from skyfold.sources import fixtures

        return int(fixtures.smoke(_session(a.master), a.fixtures, a.out))
    if a.area is None:
        p.error("evaluate needs an area or --smoke")
    area = config.StudyArea.load(a.area, a.areas)
    if a.command in ("plan", "fetch", "verify", "checksums"):
        with open(a.manifest) as f:
            items = plan(area, config.load_manifest(f.read()), a.raw)
        if a.command == "plan":
            for i in items:
                print(f"{i['key']}\t{_human(i['size'])}\t{i['source']}\t{'pinned' if i['sha256'] else 'unpinned'}\t{'here' if i['present'] else 'missing'}")
            return 0
        if a.command == "fetch":
            return int(fetch(items, "skyfold", a.force) > 0)
        here = [i for i in items if i["present"]]
        if a.command == "verify":
            bad = [i["key"] for i in here if not config.verify(i["path"], i["sha256"])]
            print(f"{len(here) - len(bad)} of {len(items)} verified" + (f"; wrong: {', '.join(bad)}" if bad else ""))
            return int(bool(bad))
        print(config.member_yaml_block([config.Member(i["key"], os.path.basename(i["path"]), config.sha256_file(i["path"]), os.path.getsize(i["path"])) for i in here]))
        return 0
    tables = sinks.AreaTables(_session(a.master), a.tables)
    if a.command == "load":
        print(load(tables, area, a.footprints, a.layer, a.gml))
    elif a.command == "reconstruct":
        run = reconstruct(tables, area, a.raw, a.limit, a.force)
        os.makedirs(a.out, exist_ok=True)
        sinks.write_log(os.path.join(a.out, f"{run['run_id']}.json"), run)
        print(run)
    elif a.command == "evaluate":
        print(f"{evaluate(tables, area)} rows of building results")
        os.makedirs(a.out, exist_ok=True)
        sinks.write_csv(tables.table(area.name, "building_results"), os.path.join(a.out, "building_results.csv"), ("orientation_errors_deg",))
    elif a.command == "fixtures":
        print(f"{build_fixtures(tables, area, a.raw, a.fixtures, a.most)} fixtures")
    elif a.command == "export-scene":
        print(f"{export_scene(tables, area, a.out)['bytes']} bytes")
    elif a.command == "report":
        results = tables.table(area.name, "building_results")
        os.makedirs(a.out, exist_ok=True)
        sinks.write_csv(evaluation.breakdown(results), os.path.join(a.out, "breakdown.csv"))
        for name, text in (("breakdown.md", sinks.breakdown_report(results, area.name)), ("gallery.md", sinks.gallery_report(results, a.gallery, area.name))):
            with open(os.path.join(a.out, name), "w") as f:
                f.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
