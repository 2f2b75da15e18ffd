"""The commands, from files to reconstructed outlines."""

import hashlib
import json

import numpy as np
import pytest

from skyfold import cli
from skyfold.sources import las

AREA = "name: a\nborough: B\nbbox: {xmin: 292000, ymin: 5034000, xmax: 292900, ymax: 5034900}\nexpected_buildings: 1\nplanes: {iterations: 100}"
GML = '<m xmlns:bldg="b" xmlns:gml="g"><bldg:Building gml:id="V1"><bldg:boundedBy><bldg:RoofSurface gml:id="r"><bldg:lod2MultiSurface><gml:posList>292010 5034010 6 292020 5034010 6 292020 5034018 6 292010 5034018 6 292010 5034010 6</gml:posList></bldg:lod2MultiSurface></bldg:RoofSurface></bldg:boundedBy></bldg:Building></m>'


@pytest.fixture
def folder(tmp_path):
    for d in ("areas", "raw"):
        (tmp_path / d).mkdir()
    (tmp_path / "areas" / "a.yaml").write_text(AREA)
    r = np.random.default_rng(0)
    x, y = r.uniform(0, 10, 4000), r.uniform(0, 8, 4000)
    roof = np.stack((x + 292010, y + 5034010, 6 + np.minimum(y, 8 - y) / 2 + r.normal(0, 0.02, 4000)), 1)
    ground = np.stack((r.uniform(292009, 292021, 200), np.full(200, 5034009.0), np.zeros(200)), 1)
    las.write_las(str(tmp_path / "raw" / "292-5034_2015.las"), np.vstack((roof, ground)), np.array([6] * 4000 + [2] * 200))
    digest = hashlib.sha256((tmp_path / "raw" / "292-5034_2015.las").read_bytes()).hexdigest()
    (tmp_path / "manifest.yaml").write_text(f"sources:\n  lidar_290-294:\n    kind: archive\n    url: u\n    members:\n      292-5034_2015.las: {{sha256: '{digest}', size: 5}}")
    (tmp_path / "V1_2016.gml").write_text(GML)
    ring = [[292010, 5034010], [292020, 5034010], [292020, 5034018], [292010, 5034018], [292010, 5034010]]
    feature = {"properties": {"footprint_id": "fp-1", "lidar_derived": False, "methode": "m", "source": "s", "MAJ": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "f.geojson").write_text(json.dumps({"features": [feature, feature | {"properties": feature["properties"] | {"footprint_id": "fp-2"}, "geometry": {"type": "Polygon", "coordinates": [[[p[0] + 100, p[1]] for p in ring]]}}]}))
    return tmp_path


def test_commands(spark, folder, capsys):
    base = ["--areas", str(folder / "areas"), "--manifest", str(folder / "manifest.yaml"), "--raw", str(folder / "raw"), "--tables", f"file://{folder}/tables", "--out", str(folder / "out")]
    assert cli.main([*base, "version"]) == 0 and cli.main([*base, "areas"]) == 0
    assert cli.main([*base, "plan", "-a", "a"]) == 0 and cli.main([*base, "verify", "-a", "a"]) == 0 and cli.main([*base, "checksums", "-a", "a"]) == 0
    assert "1 of 1 verified" in capsys.readouterr().out
    assert cli.main([*base, "load", "-a", "a", "--footprints", str(folder / "f.geojson"), "--gml", str(folder / "V1_2016.gml")]) == 0
    assert cli.main([*base, "reconstruct", "-a", "a", "--limit", "1"]) == 0
    assert cli.main([*base, "reconstruct", "-a", "a"]) == 0
    from skyfold.sources.sinks import AreaTables

    got = {r.footprint_id: r for r in AreaTables(spark, f"file://{folder}/tables").table("a", "reconstructions").collect()}
    assert got["fp-1"].status == "ok" and got["fp-1"].n_planes == 2 and got["fp-1"].n_faces == 2
    assert got["fp-2"].status == "too-few-points"
    tables = AreaTables(spark, f"file://{folder}/tables")
    assert tables.table("a", "roof_faces").where("footprint_id = 'fp-1'").count() == 2
    solid = tables.table("a", "solids").where("footprint_id = 'fp-1'").first()
    assert solid.wkt.startswith("POLYHEDRALSURFACE Z (((") and sorted(set(solid.surface_kinds)) == ["floor", "roof", "wall"]
    assert cli.main([*base, "evaluate", "-a", "a"]) == 0 and cli.main([*base, "report", "-a", "a"]) == 0
    rows = {r.building_id: r for r in tables.table("a", "building_results").collect()}
    assert rows["V1"].status == "ok" and rows["V1"].footprint_id == "fp-1" and rows["V1"].share > 0.999 and rows["V1"].coverage == 1 and 0.8 < rows["V1"].rmse_m < 1.4
    assert rows["V1"].n_ref_faces == 1 and rows["V1"].n_pred_faces == 2 and rows["fp-2"].status == "no-reference" and len(rows) == 2
    assert "V1" in (folder / "out" / "gallery.md").read_text() and "all buildings" in (folder / "out" / "breakdown.md").read_text()
    assert cli.main([*base, "export-scene", "-a", "a"]) == 0
    told = json.loads((folder / "out" / "scene" / "scene.json").read_text())
    assert told["arrays"]["points"]["length"] > 0 and told["arrays"]["triangles"]["length"] > 0 and [b["building_id"] for f in told["footprints"] for b in f["buildings"]] == ["V1"]
    fixtures = ["--fixtures", str(folder / "fixtures")]
    assert cli.main([*base, "evaluate", "--smoke", *fixtures]) == 0 and "nothing measured" in (folder / "out" / "report.md").read_text()
    assert cli.main([*base, "fixtures", "-a", "a", *fixtures]) == 0
    index = json.loads((folder / "fixtures" / "index.json").read_text())
    assert [(f["footprint_id"], f["n_points"], f["reference_buildings"]) for f in index["footprints"]] == [("fp-1", 4200, ["V1"])]
    assert cli.main([*base, "evaluate", "--smoke", *fixtures]) == 0 and "no baseline" in (folder / "out" / "report.md").read_text()
    metrics = json.loads((folder / "out" / "metrics.json").read_text())["overall"]
    assert metrics["n_assigned"] == 1 and abs(metrics["vertical_rmse_m"] - rows["V1"].rmse_m) < 0.02
    for worse, code in ((0.0, 0), (0.5, 1)):
        (folder / "fixtures" / "baseline_metrics.json").write_text(json.dumps({"tolerances": {"_comment": "x", "vertical_rmse_m": 0.02, "coverage": -0.01}, "metrics": {"overall": {"vertical_rmse_m": metrics["vertical_rmse_m"] - worse, "coverage": 1.0}}}))
        assert cli.main([*base, "evaluate", "--smoke", *fixtures]) == code
    assert cli.main([*base, "reconstruct", "-a", "a", "--force"]) == 0 and "building_results" not in tables.current("a")
    with pytest.raises(NotImplementedError):
        cli.main([*base, "export"])
    with pytest.raises(FileNotFoundError, match="no area zz"):
        cli.main([*base, "plan", "-a", "zz"])
