import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.sources import archive, citygml, config, footprints, las, sinks
from skyfold.streaming import incremental


def test_las_is_read_in_ranges_with_filters(spark, tmp_path):
    r = np.random.default_rng(0)
    xyz = np.round(r.uniform(0, 100, (1000, 3)) + [292000, 5035000, 0], 3)
    cls = r.choice([1, 2, 6], 1000)
    las.write_las(str(tmp_path / "292-5035_2015.las"), xyz, cls)
    las.write_las(str(tmp_path / "999-1_2015.las"), xyz[:10] + 1e6, cls[:10])
    df = las.read_points(spark, str(tmp_path), records=300)
    assert df.count() == 1010 and df.rdd.getNumPartitions() == 5
    near = las.read_points(spark, str(tmp_path), classes=(2, 6), bbox=(0, 0, 292050, 6e6))
    want = ((cls != 1) & (xyz[:, 0] <= 292050)).sum()
    assert near.count() == want and near.where("classification = 2").unionByName(near.where("classification = 6")).count() == want
    row = df.where("point_id = 5 and tile = '292-5035'").first()
    assert np.allclose([row.x, row.y, row.z], xyz[5], atol=5e-4) and row.classification == cls[5]
    h = las.read_header(str(tmp_path / "292-5035_2015.las"))
    assert h.version == "1.2" and h.point_count == 1000 and h.point_format == 1 and abs(h.density - 1000 / h.area_m2) < 1e-9


def test_bad_las_headers():
    with pytest.raises(ValueError, match="227"):
        las.parse_header(b"LASF")
    with pytest.raises(ValueError, match="signature"):
        las.parse_header(b"x" * 300)


GML = """<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g" xmlns:gen="n">
<core:cityObjectMember><bldg:Building gml:id="Groupe7"><gen:stringAttribute name="Parcelle"><gen:value>12</gen:value></gen:stringAttribute>
<bldg:boundedBy><bldg:RoofSurface gml:id="r1"><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 5 4 0 5 4 3 5 0 3 5 0 0 5</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:RoofSurface></bldg:boundedBy>
<bldg:boundedBy><bldg:WallSurface gml:id="w1"/></bldg:boundedBy></bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building gml:id="V01_2"/></core:cityObjectMember></core:CityModel>"""


def test_citygml(spark, tmp_path):
    (tmp_path / "V01_2016.gml").write_text(GML)
    b = citygml.read_buildings(spark, str(tmp_path / "V01_2016.gml"))
    rows = {r.gml_id: r for r in b.collect()}
    assert set(rows) == {"V01:Groupe7", "V01_2"} and rows["V01:Groupe7"].is_grouped and rows["V01:Groupe7"].attributes == {"Parcelle": "12"}
    s = citygml.roof_surfaces(b).collect()
    assert len(s) == 1 and s[0].area_m2 == 12.0 and s[0].slope_deg == 0.0 and s[0].surface_id == "r1"
    with pytest.raises(Exception, match="multiple of 3"):
        spark.sql("select '1 2 3 4' t").select(citygml.parse_poslist(F.col("t"))).collect()


def shapefile(rings, rows):
    shp = bytearray(100)
    for i, polygon in enumerate(rings):
        points = [p for r in polygon for p in r]
        starts = np.cumsum([0] + [len(r) for r in polygon[:-1]])
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(polygon), len(points)) + struct.pack(f"<{len(polygon)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
    fields = ["methode", "source", "MAJ"]
    head = struct.pack("<B3BIHH20x", 3, 0, 0, 0, len(rows), 32 + 32 * 3 + 1, 1 + 3 * 30) + b"".join(f.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([30]) + b"\0" * 15 for f in fields) + b"\r"
    return bytes(shp), head + b"".join(b" " + b"".join(v.encode().ljust(30) for v in r) for r in rows)


def test_shapefile_in_a_zip(spark, tmp_path):
    square = lambda x: [[(x, 0.0), (x, 10.0), (x + 10, 10.0), (x + 10, 0.0), (x, 0.0)]]
    shp, dbf = shapefile([square(0.0), square(0.0), square(100.0)], [["m", "relevé", "2016"], ["m", "LiDAR aérien 2015", "2016"], ["m", "relevé", "2016"]])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/ROOFS.shp", shp)
        z.writestr("x/ROOFS.dbf", dbf)
    got = {r.footprint_id: r.lidar_derived for r in footprints.read_shapefile(spark, str(tmp_path / "a.zip"), "ROOFS").collect()}
    assert got == {"fp-50-50": True, "fp-1050-50": False}
    assert footprints.read_shapefile(spark, str(tmp_path / "a.zip"), "ROOFS", (0, 0, 50, 50)).count() == 1


def test_archive_over_ranges(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/292-5034_2015.las", b"x" * 100_000)
        z.writestr("a/b.gml", b"<gml/>")
    raw = data.getvalue()
    f = archive.RangeFile(lambda a, b: raw[a:b], len(raw), block=64)
    a = archive.Archive(f)
    assert a.read(a.member("292-5034")) == b"x" * 100_000
    for fragment in ("a/", "nothing"):
        with pytest.raises(KeyError):
            a.member(fragment)
    short = archive.RangeFile(lambda a, b: raw[a : b - 1], len(raw), block=64)
    with pytest.raises((OSError, zipfile.BadZipFile)):
        archive.Archive(short)
    (tmp_path / "n.zip").write_bytes(raw)
    assert open(archive.extract_citygml(str(tmp_path / "n.zip"), str(tmp_path / "out")), "rb").read() == b"<gml/>"


def test_areas_and_manifest(tmp_path):
    area = config.StudyArea.parse("name: a\nbbox: {xmin: 292347.25, ymin: 5034885, xmax: 293000, ymax: 5035969.5}\nreference_tiles: [T1]\nplanes: {seed: 3}")
    assert area.bbox.lidar_tiles() == ["292-5034", "292-5035", "293-5034", "293-5035"] and area.planes.seed == 3
    with pytest.raises(ValueError, match="sed is no key"):
        config.StudyArea.parse("name: a\nbbox: {xmin: 0, ymin: 0, xmax: 1, ymax: 1}\nplanes: {sed: 3}")
    with pytest.raises(ValueError, match="no extent along x"):
        config.BBox(1, 0, 1, 1)
    area = config.StudyArea.parse("name: a\nbbox: {xmin: 0, ymin: 0, xmax: 1, ymax: 1}\ntopology: {corner_sigma_m: 0.5}")
    assert area.topology.corner_sigma_m == 0.5 and area.planes.seed == 0
    with pytest.raises(ValueError, match="corner is no key"):
        config.StudyArea.parse("name: a\nbbox: {xmin: 0, ymin: 0, xmax: 1, ymax: 1}\ntopology: {corner: 1}")
    with pytest.raises(ValueError, match="name is missing; bbox: bounds: ymax is missing"):
        config.StudyArea.parse("bbox: {xmin: 0, ymin: 0, xmax: 1}")
    with pytest.raises(ValueError, match="is no SHA-256"):
        config.load_manifest("sources:\n  a: {url: u, sha256: abc}")
    digest = "0" * 64
    m = config.load_manifest(f"sources:\n  lidar_290-294:\n    kind: archive\n    url: u\n    members:\n      t.las: {{sha256: '{digest}', size: 3}}")
    assert m["lidar_290-294"].member("t.las").is_pinned and not m["lidar_290-294"].member("z").is_pinned
    assert config.lidar_archive_for("292-5034", m).key == "lidar_290-294"
    assert f'sha256: "{digest}"' in config.member_yaml_block(list(m["lidar_290-294"].members.values()))
    with pytest.raises(ValueError):
        config.load_manifest(f"sources:\n  a: {{kind: archive, url: u, sha256: '{digest}'}}")
    (tmp_path / "f").write_bytes(b"abc")
    assert config.verify(str(tmp_path / "f"), None) and not config.verify(str(tmp_path / "f"), digest)
    with pytest.raises(config.ChecksumMismatchError):
        config.verify_or_raise(str(tmp_path / "f"), digest)


def test_area_tables_change_together(spark, tmp_path):
    t = sinks.AreaTables(spark, f"file://{tmp_path}")
    assert t.replace("a", {"x": spark.range(3), "y": spark.range(2)}) == {"x": 3, "y": 2}
    t.replace("a", {"x": spark.range(5)})
    assert t.table("a", "x").count() == 5 and set(t.current("a")) == {"x"}
    t.append("a", "x", spark.range(2))
    t.append("a", "z", spark.range(1))
    assert t.table("a", "x").count() == 7 and t.table("a", "z").count() == 1 and t.current("b") == {}
    (tmp_path / "a" / "part-of-a-killed-run").write_text("{")  # is never read
    assert t.table("a", "x").count() == 7
    t.replace("a", {"y": spark.range(1)}, keep=("x",))
    assert t.table("a", "x").count() == 7 and set(t.current("a")) == {"x", "y"}
    runs = spark.createDataFrame([("f", "1", "ok"), ("f", "2", "error")], "footprint_id string, run_id string, status string")
    assert sinks.latest(runs).first().status == "error"
    todo = spark.createDataFrame([("f",), ("g",), ("h",)], "footprint_id string")
    assert [r[0] for r in sinks.resume(todo, runs, 1).collect()] == ["g"]


def test_exports(spark, tmp_path):
    q = sinks.Quantiser([0, 0, 0], [650, 10, 10])
    xyz = np.array([[0, 0, 0], [650, 10, 10], [3.3, 1, 1]])
    assert np.abs(q.decode(q.encode(xyz)) - xyz).max() <= q.scale / 2 + 1e-9
    with pytest.raises(ValueError):
        q.encode(np.array([[700, 0, 0]]))
    p = spark.createDataFrame([(0.0, 0.0, 1.0, 6)], "x double, y double, z double, cls int")
    t = spark.createDataFrame([(0.0, 0.0, 5.0, 1), (1.0, 0.0, 5.0, 1), (1.0, 1.0, 5.0, 1)], "x double, y double, z double, owner int")
    meta = sinks.export_scene(p, t, str(tmp_path / "s"))
    told = json.loads((tmp_path / "s" / "scene.json").read_text())
    assert told["bytes"] == (tmp_path / "s" / "scene.bin").stat().st_size == meta["bytes"]
    df = spark.createDataFrame([("a", [1.0, 2.0], ["x", "y"])], "id string, angles array<double>, w array<string>")
    assert sinks.flat(df, ("angles",)).first() == ("a", "1.000;2.000", "x;y")
    with pytest.raises(NotImplementedError):
        sinks.write_tileset()


def test_reports(spark):
    from skyfold.plans.scene import Scene

    r = Scene(spark, "/root/testdata/sf0.001").results
    text = sinks.breakdown_report(r, "Area")
    assert "LiDAR-derived footprints" in text and "| >=20 |" in text
    cells = {c: F.lit(None).cast("double") for c in ("bias_m", "n_cells", "n_bad", "bad_median_m", "rest_rmse_m", "orientation_median_deg")}
    assert "Not scored" in sinks.gallery_report(r.withColumns(cells).withColumn("reason", F.lit(None).cast("string")), 3, "Worst")


def test_incremental_runs_do_each_file_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.run(spark, str(tmp_path / "in"), "id bigint", lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_hexadecimal_geometries(spark):
    import struct

    from skyfold.functions import wkb

    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]
    df = spark.createDataFrame([(1, rings), (2, None)], "id int, rings array<array<struct<x:double,y:double>>>")
    out = {r.id: r for r in df.select("id", wkb.ewkb(F.col("rings")).alias("one"), wkb.ewkb(F.col("rings"), multi=True).alias("many")).collect()}
    data = bytes.fromhex(out[1].one)
    assert struct.unpack_from("<BIII", data) == (1, 0x20000003, 2950, 2) and out[2].one is None
    assert struct.unpack_from("<I8d", data, 13) == (4, 0, 0, 4, 0, 4, 3, 0, 0)  # closed
    assert len(data) == 13 + 2 * (4 + 64)
    many = bytes.fromhex(out[1].many)
    assert struct.unpack_from("<BIII", many) == (1, 0x20000006, 2950, 1) and struct.unpack_from("<BII", many, 13) == (1, 3, 2) and many[22:] == data[13:]
    ring = [[(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 1.0)]]
    z = spark.createDataFrame([(ring,)], "r array<array<struct<x:double,y:double,z:double>>>").select(wkb.ewkb(F.col("r"), z=True)).first()[0]
    assert z.startswith("01" + "030000A0" + "860B0000" + "01000000" + "04000000")
