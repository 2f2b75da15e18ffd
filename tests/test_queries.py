"""Every query against its checking SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from skyfold.plans import registry

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for f in glob.glob(f"{PATH}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    return None if math.isnan(float(v)) else round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, engine, name):
    df = registry.QUERIES[name](spark, PATH)
    relation = engine.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=str)
    assert got == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spatial_joins_are_equi_joins(spark):
    from skyfold.operators import clip, spatial

    edge = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    shapes = spark.createDataFrame([], f"fid int, edges {edge}")
    points = spark.createDataFrame([], "pid int, x double, y double, z double, cls int")
    faces = spark.createDataFrame([], f"fid int, edges {edge}, plane struct<nx:double,ny:double,nz:double,d:double>")
    cells = spatial.cells_of(shapes, 0.5, 0.5)
    joins = [
        spatial.points_in_shapes(points, shapes, 20.0, 2.0), cells, spatial.surface(cells, faces, ["fid"], 20.0, "z"),
        clip.overlaps(shapes.withColumnRenamed("edges", "edges_a"), shapes.withColumnsRenamed({"edges": "edges_b", "fid": "other"}), 20.0), clip.clip(points, shapes, 20.0, 2.0, 1.5),
    ]
    for df in joins:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
