"""Queries of the solid kernel, checked by closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators import extrude
from skyfold.plans.scene import Scene

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def extruded_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solids of the outlines, the west half and the east half a face each."""
    f = Scene(spark, sf_dir).sql("footprints").where("shape = 'R'")
    w, d = F.col("w") / 1000, F.col("d") / 1000
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    face = lambda i, a, b: F.struct(F.lit(i).alias("face"), F.lit(0.0).alias("nx"), F.lit(-0.1 * (1 - i)).alias("ny"), F.lit(1.0).alias("nz"), F.lit(6.0 + i).alias("d"), F.array(F.array(corner(a, F.lit(0.0)), corner(b, F.lit(0.0)), corner(b, d), corner(a, d))).alias("rings"))
    faces = f.select("fid", F.lit(0.0).alias("ground_z"), F.inline(F.array(face(0, F.lit(0.0), w / 2), face(1, w / 2, w))))
    out = extrude.extrude_faces(faces, "fid")
    return out.select("fid", "n_faces", F.round("volume_m3", 6).alias("volume_m3"), "watertight", F.array_join("problems", ";").alias("problems"))


# prisms: the flat east half and the sloping west half, whose mean height is 6 + d / 20
ORACLE_SQL["extruded_solids"] = """SELECT CAST(s_suppkey AS BIGINT) AS fid, 2 AS n_faces, round(w * d / 2 * 7 + w * d / 2 * (6 + d / 20), 6) AS volume_m3, true AS watertight, '' AS problems
FROM (SELECT s_suppkey, CAST(8 + s_suppkey % 7 AS DOUBLE) AS w, CAST(6 + s_suppkey % 5 AS DOUBLE) AS d FROM supplier WHERE s_suppkey % 3 <> 0)"""
