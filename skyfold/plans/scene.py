"""A deterministic scene of outlines, points and reference roofs, derived from the harness's
tables by integer arithmetic alone. The SQL is read alike by Spark and by the checking engine.
All lengths are millimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import geo

# outlines: a rectangle, or every third an L, on a lattice of 40 m
FOOTPRINTS = """
SELECT fid, ox, oy, w, d, shape, lidar_derived,
       CASE WHEN shape = 'L' THEN w * d - (w / 2) * (d / 2) ELSE w * d END AS area
FROM (
  SELECT CAST(s_suppkey AS BIGINT) AS fid,
         CAST((292000 + (s_suppkey % 32) * 40) * CAST(1000 AS BIGINT) AS BIGINT) AS ox,
         CAST((5035000 + CAST(floor(s_suppkey / 32.0) AS BIGINT) * 40) * 1000 AS BIGINT) AS oy,
         CAST((8 + s_suppkey % 7) * 1000 AS DOUBLE) AS w, CAST((6 + s_suppkey % 5) * 1000 AS DOUBLE) AS d,
         CASE WHEN s_suppkey % 3 = 0 THEN 'L' ELSE 'R' END AS shape,
         s_suppkey % 12 = 0 AS lidar_derived
  FROM supplier) t
"""

# corners in order; those beyond the fourth are an L's
CORNERS = """
SELECT f.fid, c.k, CAST(f.ox + CASE WHEN f.shape = 'L' THEN c.lx ELSE c.rx END * f.w / 2 AS BIGINT) AS x,
       CAST(f.oy + CASE WHEN f.shape = 'L' THEN c.ly ELSE c.ry END * f.d / 2 AS BIGINT) AS y
FROM footprints f CROSS JOIN (VALUES (0, 0, 0, 0, 0), (1, 2, 0, 2, 0), (2, 2, 1, 2, 2), (3, 1, 1, 0, 2), (4, 1, 2, -1, -1), (5, 0, 2, -1, -1)) AS c(k, lx, ly, rx, ry)
WHERE f.shape = 'L' OR c.k < 4
"""

EDGES = """
SELECT a.fid, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
FROM corners a JOIN (SELECT fid, max(k) AS last FROM corners GROUP BY fid) m ON m.fid = a.fid
JOIN corners b ON b.fid = a.fid AND b.k = CASE WHEN a.k = m.last THEN 0 ELSE a.k + 1 END
"""

# points on and around their outline: a gable, a shed or a flat roof with noise; ground beside it
POINTS = """
SELECT pid, fid, x, y, cls,
       CAST(CASE WHEN cls = 2 THEN 30000 + noise
            WHEN fid % 3 = 1 THEN 36000 + floor(least(greatest(y - oy, 0), greatest(oy + d - y, 0)) / 2.0) + noise
            WHEN fid % 3 = 2 THEN 36000 + floor((x - ox) / 4.0) + noise
            ELSE 36000 + noise END AS BIGINT) AS z
FROM (
  SELECT concat(CAST(l_orderkey AS STRING), '|', CAST(l_linenumber AS STRING), '|', CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING)) AS pid,
         f.fid, f.ox, f.oy, f.d,
         CAST(f.ox - 2000 + ((l_partkey * 37 + l_orderkey * 11) % 1000) * ((f.w + 4000) / 1000) AS BIGINT) AS x,
         CAST(f.oy - 2000 + ((l_partkey * 53 + l_orderkey * 29 + l_linenumber * 131) % 1000) * ((f.d + 4000) / 1000) AS BIGINT) AS y,
         CAST(round(l_discount * 1000) AS BIGINT) AS noise,
         CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 6 THEN 7 WHEN 7 THEN 28 ELSE 6 END AS cls
  FROM lineitem JOIN footprints f ON f.fid = l_suppkey) t
"""

# reference buildings: strips of the outline's bounds, some moved, some grouped
BUILDINGS = """
SELECT concat(CASE WHEN fid % 10 = 9 THEN 'Groupe' ELSE 'B' END, CAST(fid AS STRING), '-', CAST(i AS STRING)) AS building_id, fid AS home,
       CAST(ox + floor(w * i / n) + CASE WHEN fid % 8 = 5 THEN 5500 ELSE 0 END AS BIGINT) AS x0,
       CAST(ox + floor(w * (i + 1) / n) + CASE WHEN fid % 8 = 5 THEN 5500 ELSE 0 END AS BIGINT) AS x1,
       oy AS y0, CAST(oy + d AS BIGINT) AS y1, CAST(oy + floor(d / 2) AS BIGINT) AS ym, fid % 3 AS kind
FROM (SELECT *, 1 + fid % 3 AS n FROM footprints) f CROSS JOIN (VALUES (0), (1), (2)) AS s(i) WHERE i < n
"""

# roof faces of a building: a south and a north half, as a plane nx*x + ny*y + nz*z = d about the corner (x0, y0)
ROOFS = """
SELECT building_id, 0 AS ordinal, x0, x1, y0 AS ya, ym AS yb, x0 AS px, y0 AS py, 0 AS sx, CASE kind WHEN 1 THEN 1 ELSE 0 END AS sy, 36000 AS h FROM buildings
UNION ALL
SELECT building_id, 1 AS ordinal, x0, x1, ym AS ya, y1 AS yb, x0 AS px, y1 AS py, 0 AS sx, CASE kind WHEN 1 THEN -1 ELSE 0 END AS sy, CASE kind WHEN 2 THEN 37000 ELSE 36000 END AS h FROM buildings
"""

# results of buildings, one an order, for the aggregates and reports
RESULTS = """
SELECT CAST(o_orderkey AS BIGINT) AS building_id,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS footprint_id,
       CASE WHEN o_orderkey % 31 = 0 THEN 'no-reference' WHEN o_orderkey % 29 = 0 THEN 'grouped-reference' WHEN o_orderkey % 23 = 0 THEN 'no-match'
            WHEN o_orderkey % 13 = 0 THEN 'suspect-temporal' WHEN o_orderkey % 11 = 0 THEN 'no-planes' WHEN o_orderkey % 17 = 0 THEN 'too-few-points' ELSE 'ok' END AS status,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'flat' WHEN o_orderkey % 3 = 1 THEN 'mixed' ELSE 'pitched' END AS roof_type,
       CAST(20 + o_custkey % 1300 AS DOUBLE) AS outline_area_m2,
       CASE WHEN o_orderkey % 23 = 0 OR o_orderkey % 31 = 0 THEN NULL ELSE 0.5 + CAST(o_custkey % 64 AS DOUBLE) / 128 END AS share,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / 4 END AS point_density,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_custkey % 12 = 0 END AS lidar_derived,
       CAST(10 + o_custkey % 90 AS BIGINT) AS n_ref_cells,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 OR o_orderkey % 31 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(10 + o_custkey % 80 AS BIGINT) END AS n_valid_cells,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 23 = 0 OR o_orderkey % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((o_orderkey % 512) / 8.0 AS DOUBLE) END AS sum_sq_m2,
       CASE WHEN o_orderkey % 13 = 0 THEN CAST(2.0 AS DOUBLE) ELSE CAST((o_custkey % 16) / 16.0 AS DOUBLE) END AS temporal_offset_m,
       CAST((o_custkey % 40) / 4.0 AS DOUBLE) AS a1, CAST((o_orderkey % 28) / 4.0 AS DOUBLE) AS a2,
       o_orderkey % 4 AS n_unmatched_pred, o_orderkey % 5 AS n_unmatched_ref, 1 + o_custkey % 6 AS n_pred_faces, 1 + o_orderkey % 6 AS n_ref_faces
FROM orders
"""

NAMES = {"footprints": FOOTPRINTS, "corners": CORNERS, "edges": EDGES, "points": POINTS, "buildings": BUILDINGS, "roofs": ROOFS, "results": RESULTS}
_NEEDS = {"corners": ("footprints",), "edges": ("corners", "footprints"), "points": ("footprints",), "buildings": ("footprints",), "roofs": ("buildings", "footprints")}


def with_clause(*names: str) -> str:
    """WITH ... of the named tables and what they need."""
    need = [n for n in NAMES if n in names or any(n in _NEEDS.get(m, ()) for m in names)]
    return "WITH " + ", ".join(f"{n} AS ({NAMES[n]})" for n in need) + "\n"


class Scene:
    """The scene's tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, name: str) -> DataFrame:
        base = {t: self.table(t) for t in ("supplier", "lineitem", "orders")}
        text = with_clause(name) + f"SELECT * FROM {name}"
        for t, df in base.items():
            df.createOrReplaceTempView(f"scene_{t}")
            text = text.replace(f"FROM {t}", f"FROM scene_{t}")
        return self.spark.sql(text)

    @property
    def footprints(self) -> DataFrame:
        """fid, area, lidar_derived and edges."""
        corners = self.sql("corners").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("ring"))
        out = corners.join(self.sql("footprints").select("fid", "area", "lidar_derived", "ox", "oy", "w", "d"), "fid")
        return out.withColumn("edges", geo.ring_edges(F.col("ring")))

    @property
    def points(self) -> DataFrame:
        """pid, fid (of the outline that it was made for), x, y, z, cls."""
        return self.sql("points")

    @property
    def buildings(self) -> DataFrame:
        """building_id, home and edges of the reference outlines."""
        b = self.sql("buildings")
        corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
        return b.withColumn("ring", ring).withColumn("edges", geo.ring_edges(F.col("ring")))

    @property
    def roofs(self) -> DataFrame:
        """building_id, ordinal, edges, ring (x, y, z) and plane of the reference faces: z = h + (y - py) * sy / 2."""
        r = self.sql("roofs")
        z = lambda y: (F.col("h") + (F.col(y) - F.col("py")) * F.col("sy") / 2).cast("double")
        corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), z(y).alias("z"))
        ring = F.array(corner("x0", "ya"), corner("x1", "ya"), corner("x1", "yb"), corner("x0", "yb"))
        plane = F.struct(F.lit(0.0).alias("nx"), (-F.col("sy") / 2).cast("double").alias("ny"), F.lit(1.0).alias("nz"), (F.col("h") - F.col("py") * F.col("sy") / 2).cast("double").alias("d"))
        return r.withColumn("ring", ring).withColumn("edges", geo.ring_edges(F.transform("ring", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))).withColumn("plane", plane)

    @property
    def results(self) -> DataFrame:
        r = self.sql("results").withColumn("rmse_m", F.sqrt(F.try_divide("sum_sq_m2", "n_valid_cells"))).withColumn("coverage", F.when(~F.col("status").isin("no-reference", "no-match"), F.try_divide("n_valid_cells", "n_ref_cells")))
        angles = F.when(F.col("status").isin("ok", "suspect-temporal"), F.array("a1", "a2")).otherwise(F.array().cast("array<double>"))
        agree = F.when(F.col("status").isin("ok", "suspect-temporal"), F.least("n_pred_faces", "n_ref_faces") / F.greatest("n_pred_faces", "n_ref_faces"))
        return r.withColumn("orientation_errors_deg", angles).withColumn("face_count_agreement", agree).withColumn("warnings", F.when(F.col("building_id") % 7 == 0, F.array(F.lit("saddle"), F.lit("sliver"))).otherwise(F.array().cast("array<string>")))
