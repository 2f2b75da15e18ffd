"""Houses of sixteen points a square metre and their reference roofs, derived from the supplier table by
arithmetic alone, so that planes, solids and scores have closed forms. Lengths are metres.

Kinds: 0 flat, 1 a gable of 45 degrees with its ridge a metre off the middle, 2 a shed of one in two, 3 a step
between two flat halves. By fid % 25: 1 the reference is grouped, 6 it lies 30 m away, 11 it stands
three metres too high, 16 there is none, 21 it is as it should be (a quarter of a metre above the points).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import assessment, clip, evaluation, partition, planes
from skyfold.sources import sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
GROUND = 30.0

HOUSES = """
SELECT fid, kind, what, ox, oy, w, d, r, s FROM (
  SELECT fid, CAST(floor(fid / 25.0) AS INT) % 4 AS kind, CAST(fid % 25 AS INT) AS what, CAST(292000 + (fid % 32) * 40 AS DOUBLE) AS ox, CAST(5035000 + CAST(floor(fid / 32.0) AS INT) * 40 AS DOUBLE) AS oy,
         CAST(8 + 2 * (fid % 4) AS DOUBLE) AS w, CAST(8 + 2 * (fid % 3) AS DOUBLE) AS d, CAST(5 + fid % 3 AS DOUBLE) AS r, CAST(5 + fid % 4 AS DOUBLE) AS s
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS fid FROM {supplier} WHERE s_suppkey % 5 = 1) t) t
"""
# faces in plan, from (xa, ya) to (xb, yb) about (ox, oy), and their height h + gx * x + gy * y there
FACES = """
SELECT fid, 0 AS face, 0.0 AS xa, 0.0 AS ya, CASE kind WHEN 3 THEN s ELSE w END AS xb, CASE kind WHEN 1 THEN r ELSE d END AS yb, CASE kind WHEN 0 THEN 46.0 WHEN 3 THEN 44.0 ELSE 40.0 END AS h,
       CASE kind WHEN 2 THEN 0.5 ELSE 0.0 END AS gx, CASE kind WHEN 1 THEN 1.0 ELSE 0.0 END AS gy FROM houses
UNION ALL
SELECT fid, 1, CASE kind WHEN 3 THEN s ELSE 0.0 END, CASE kind WHEN 1 THEN r ELSE 0.0 END, w, d, CASE kind WHEN 1 THEN 40 + 2 * r ELSE 48.0 END, 0.0, CASE kind WHEN 1 THEN -1.0 ELSE 0.0 END FROM houses WHERE kind IN (1, 3)
"""
_WITH = f"WITH houses AS ({HOUSES.format(supplier='supplier')}), faces AS ({FACES})"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _WITH + sql
        return f

    return register


class Village:
    """The tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("village_supplier")
        self.houses = spark.sql(HOUSES.format(supplier="village_supplier"))
        self.spark = spark

    @property
    def faces(self) -> DataFrame:
        self.houses.createOrReplaceTempView("houses")
        casts = (F.col(c).cast("double").alias(c) for c in ("xa", "ya", "xb", "yb", "h", "gx", "gy"))
        return self.spark.sql(FACES).select("fid", "face", *casts)

    @property
    def footprints(self) -> DataFrame:
        """fid, ring, edges, lidar_derived."""
        c = lambda x, y: F.struct((F.col("ox") + x).alias("x"), (F.col("oy") + y).alias("y"))
        zero = F.lit(0.0)
        f = self.houses.withColumn("ring", F.array(c(zero, zero), c(F.col("w"), zero), c(F.col("w"), F.col("d")), c(zero, F.col("d"))))
        return f.select("fid", "ring", geo.ring_edges(F.col("ring")).alias("edges"), (F.col("fid") % 2 == 0).alias("lidar_derived"))

    @property
    def points(self) -> DataFrame:
        """pid, x, y, z, cls: four by four a square metre on the roof, every eleventh unclassified; some low ones beneath it; ground within 1.5 m."""
        f = self.faces.join(self.houses.select("fid", "ox", "oy", "w", "d"), "fid")
        at = lambda a, b, step: F.explode(F.sequence(F.lit(0), ((F.col(b) - F.col(a)) / step).cast("int") - 1))
        roof = f.withColumn("i", at("xa", "xb", 0.25)).withColumn("j", at("ya", "yb", 0.25))
        roof = roof.withColumn("px", F.col("xa") + 0.125 + F.col("i") * 0.25).withColumn("py", F.col("ya") + 0.125 + F.col("j") * 0.25)
        mark = F.col("i") + 3 * F.col("j")
        roof = roof.select("fid", "ox", "oy", "px", "py", (F.col("h") + F.col("gx") * F.col("px") + F.col("gy") * F.col("py")).alias("z"), F.when(mark % 11 == 0, 1).otherwise(6).alias("cls"))
        low = roof.where("cls = 1").withColumn("z", F.lit(GROUND + 0.5)).withColumn("cls", F.lit(28))
        g = self.houses.withColumn("i", F.explode(F.sequence(F.lit(-1), F.col("w").cast("int")))).withColumn("j", F.explode(F.sequence(F.lit(-1), F.col("d").cast("int"))))
        g = g.where("i = -1 or j = -1 or i = w or j = d").select("fid", "ox", "oy", (F.col("i") + 0.5).cast("double").alias("px"), (F.col("j") + 0.5).cast("double").alias("py"), F.lit(GROUND).alias("z"), F.lit(2).alias("cls"))
        every = roof.unionByName(low).unionByName(g)
        return every.select(F.concat_ws("|", "fid", "cls", "px", "py").alias("pid"), (F.col("ox") + F.col("px")).alias("x"), (F.col("oy") + F.col("py")).alias("y"), "z", "cls")

    @property
    def roofs(self) -> DataFrame:
        """building_id, ordinal, ring, area_m2, slope_deg of the reference; a flat house's is cut in two."""
        f = self.faces.join(self.houses.select("fid", "kind", "what", "ox", "oy", "w"), "fid").where("what <> 16")
        part = F.explode(F.when(F.col("kind") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))).alias("part")
        f = f.select("*", part).withColumn("x0", F.when(F.col("part") == 1, F.col("w") / 2).otherwise(F.col("xa"))).withColumn("x1", F.when(F.col("part") == 0, F.col("w") / 2).otherwise(F.col("xb")))
        up = F.when(F.col("what") == 11, 3.0).otherwise(0.25)
        c = lambda x, y: F.struct((F.col("ox") + F.col(x) + F.when(F.col("what") == 6, 30.0).otherwise(0.0)).alias("x"), (F.col("oy") + F.col(y)).alias("y"), (F.col("h") + F.col("gx") * F.col(x) + F.col("gy") * F.col(y) + up).alias("z"))
        ring = F.array(c("x0", "ya"), c("x1", "ya"), c("x1", "yb"), c("x0", "yb"))
        f = f.select(building_id(), (F.col("face") + F.greatest("part", F.lit(0))).alias("ordinal"), ring.alias("ring"))
        return f.withColumn("area_m2", geo.ring_area(F.col("ring"))).withColumn("slope_deg", geo.slope_degrees(geo.newell(F.col("ring"))))

    @property
    def buildings(self) -> DataFrame:
        return self.houses.where("what <> 16").select(building_id(), (F.col("what") == 1).alias("is_grouped"))

    @property
    def roof_points(self) -> DataFrame:
        return clip.clip(self.points, self.footprints, bin_size=20.0, margin=2.0, height=1.5)

    def reconstructions(self, roof_points: DataFrame | None = None) -> DataFrame:
        shapes = self.footprints.select("fid", "ring", F.lit(GROUND).alias("ground_z"))
        return partition.reconstruct_all(shapes, self.roof_points if roof_points is None else roof_points, "fid")

    @property
    def results(self) -> DataFrame:
        """building_results of the whole village, from its points on."""
        points = self.roof_points.persist()  # the kernels' results are read by several joins
        area = self.houses.select("fid", (F.col("w") * F.col("d")).alias("area"))
        made = self.reconstructions(points).join(area, "fid").withColumn("density", F.col("n_points") / F.col("area"))
        made = made.select(F.col("fid").alias("footprint_id"), "status", "reason", F.array().cast("array<string>").alias("warnings"), "density", "faces").persist()
        return assessment.evaluate(self.footprints.select(F.col("fid").alias("footprint_id"), "lidar_derived", "edges"), made, self.buildings, self.roofs, points.withColumnRenamed("fid", "footprint_id"))


def building_id():
    return F.format_string("B%d", "fid").alias("building_id")


_SLOPE = "sqrt(1 + gx * gx + gy * gy)"


@query(f""" SELECT f.fid, CAST(row_number() OVER (PARTITION BY f.fid ORDER BY (xb - xa) * (yb - ya) DESC) - 1 AS INT) AS plane_index, round(-gx / {_SLOPE} + 0.0, 4) AS nx, round(-gy / {_SLOPE} + 0.0, 4) AS ny, round(1 / {_SLOPE}, 4) AS nz,
  round(h / {_SLOPE}, 4) AS d, CAST((xb - xa) * (yb - ya) * 16 AS BIGINT) AS n_inliers, CAST(w * hd * 16 AS BIGINT) AS n_points, 1.0 AS coverage FROM faces f JOIN (SELECT fid, w, d AS hd FROM houses) k ON k.fid = f.fid""")
def detect_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes found in the points of each house, about its corner, and the share of points that they take."""
    v = Village(spark, sf_dir)
    local = v.roof_points.join(v.houses.select("fid", "ox", "oy"), "fid").select("fid", "pid", (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y"), "z")
    found = planes.detect_planes(local, "fid").where("plane_index >= 0")
    taken = found.groupBy("fid").agg((F.sum("n_inliers") / F.max("n_points")).alias("coverage"))
    return found.join(taken, "fid").select("fid", "plane_index", *((F.round(c, 4) + 0.0).alias(c) for c in ("nx", "ny", "nz", "d")), "n_inliers", "n_points", "coverage")


# each face's prism over the ground: its area times the height at its middle
_VOLUME = "sum((xb - xa) * (yb - ya) * (h + gx * (xa + xb) / 2 + gy * (ya + yb) / 2 - 30))"


@query(f" SELECT f.fid, 'ok' AS status, CAST(max(w * k.d * 16) AS BIGINT) AS n_points, CAST(count(*) AS INT) AS n_planes, CAST(count(*) AS INT) AS n_faces, round({_VOLUME}, 3) AS volume_m3 FROM faces f JOIN houses k ON k.fid = f.fid GROUP BY f.fid")
def reconstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes, partition and solid of every house, a row for each, failures too."""
    out = Village(spark, sf_dir).reconstructions()
    return out.select("fid", "status", "n_points", "n_planes", "n_faces", F.round("volume_m3", 3).alias("volume_m3"))


@query(f" SELECT f.fid, face, CAST(round(-gx / {_SLOPE} + 0.0, 4) AS DOUBLE) AS nx, CAST(round(-gy / {_SLOPE} + 0.0, 4) AS DOUBLE) AS ny, round((xb - xa) * (yb - ya), 4) AS area_m2 FROM (SELECT fid, xa, ya, xb, yb, gx, gy, row_number() OVER (PARTITION BY fid ORDER BY (xb - xa) * (yb - ya) DESC) - 1 AS face FROM faces) f")
def roof_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faces that come out, by area, with their planes' tilt."""
    faces = Village(spark, sf_dir).reconstructions().select("fid", F.explode("faces").alias("f"))
    area = F.aggregate(F.transform("f.rings", geo.shoelace), F.lit(0.0), lambda a, b: a + b)
    faces = faces.select("fid", "f.nx", "f.ny", area.alias("area_m2"))
    listed = faces.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("area_m2", "nx", "ny")), asc=False).alias("l"))
    return listed.select("fid", F.posexplode("l").alias("face", "r")).select("fid", F.col("face").cast("bigint").alias("face"), *((F.round(f"r.{c}", 4) + 0.0).alias(c) for c in ("nx", "ny", "area_m2")))


_RESULTS = f"""SELECT CASE what WHEN 16 THEN CAST(k.fid AS VARCHAR) ELSE 'B' || CAST(k.fid AS VARCHAR) END AS building_id, CASE WHEN what NOT IN (1, 6) THEN k.fid END AS footprint_id,
  CASE what WHEN 1 THEN 'grouped-reference' WHEN 6 THEN 'no-match' WHEN 11 THEN 'suspect-temporal' WHEN 16 THEN 'no-reference' ELSE 'ok' END AS status,
  CASE WHEN what <> 16 THEN CASE WHEN kind IN (0, 3) THEN 'flat' ELSE 'pitched' END END AS roof_type, CASE WHEN what <> 16 THEN w * d END AS outline_area_m2, CASE WHEN what IN (11, 21) THEN 1.0 END AS share,
  CASE WHEN what NOT IN (1, 6) THEN 16.0 END AS point_density, CASE WHEN what NOT IN (1, 6) THEN k.fid % 2 = 0 END AS lidar_derived,
  CASE WHEN what IN (11, 21) THEN CAST((2 * w - 2) * (2 * d - 2) AS INT) END AS n_ref_cells, CASE WHEN what IN (11, 21) THEN CAST((2 * w - 2) * (2 * d - 2) AS INT) END AS n_valid_cells,
  CAST(CASE WHEN what IN (11, 21) THEN CASE what WHEN 11 THEN 3.0 ELSE 0.25 END END AS DOUBLE) AS rmse_m, CASE WHEN what IN (11, 21) THEN 1.0 END AS coverage, CASE WHEN what IN (11, 21) THEN CASE what WHEN 11 THEN -3.0 ELSE -0.25 END END AS temporal_offset_m,
  CASE WHEN what IN (11, 21) THEN CASE kind WHEN 1 THEN '0.0,0.0' WHEN 3 THEN '0.0,0.0' ELSE '0.0' END END AS angles,
  CASE WHEN what IN (11, 21) THEN CAST(CASE kind WHEN 0 THEN 1 ELSE 0 END AS INT) END AS n_unmatched_ref, CASE WHEN what IN (11, 21) THEN CAST(0 AS INT) END AS n_unmatched_pred, CASE WHEN what IN (11, 21) THEN CASE kind WHEN 0 THEN 0.5 ELSE 1.0 END END AS face_count_agreement
  FROM houses k
  UNION ALL SELECT CAST(fid AS VARCHAR), fid, 'no-reference', NULL, NULL, NULL, 16.0, fid % 2 = 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM houses WHERE what IN (1, 6)"""


@query(" " + _RESULTS)
def evaluated_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every reference building, from the points on: clip, planes, partition, solids, cells, matched planes."""
    r = Village(spark, sf_dir).results
    rounded = lambda c, n=4: (F.round(c, n) + 0.0).alias(c)
    angles = F.when(F.col("orientation_errors_deg").isNotNull(), F.array_join(F.transform("orientation_errors_deg", lambda a: (F.round(a, 3) + 0.0).cast("string")), ","))
    return r.select(
        "building_id", "footprint_id", "status", "roof_type", rounded("outline_area_m2"), rounded("share"), rounded("point_density"), "lidar_derived", "n_ref_cells", "n_valid_cells", rounded("rmse_m"), rounded("coverage"), rounded("temporal_offset_m"),
        angles.alias("angles"), "n_unmatched_ref", "n_unmatched_pred", rounded("face_count_agreement"),
    )


@query(f""", r AS ({_RESULTS}) SELECT CAST(count(*) FILTER (WHERE status <> 'no-reference') AS BIGINT) AS n_buildings, CAST(count(*) FILTER (WHERE share IS NOT NULL) AS BIGINT) AS n_assigned, CAST(count(*) FILTER (WHERE status IN ('ok', 'suspect-temporal')) AS BIGINT) AS buildings_reconstructed,
  round(sqrt(sum(rmse_m * rmse_m * n_valid_cells) / sum(n_valid_cells)), 6) AS vertical_rmse_m, round(median(rmse_m), 6) AS median_building_rmse_m, round(sum(n_valid_cells) / sum(n_ref_cells), 6) AS coverage, round(avg(face_count_agreement), 6) AS face_count_agreement,
  round(count(*) FILTER (WHERE share IS NOT NULL) / nullif(count(*) FILTER (WHERE status NOT IN ('no-reference', 'grouped-reference')), 0), 6) AS match_rate FROM r""")
def evaluated_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline metrics of the whole village, from its points on."""
    m = evaluation.summarise(Village(spark, sf_dir).results)
    names = ("vertical_rmse_m", "median_building_rmse_m", "coverage", "face_count_agreement", "match_rate")
    return m.select("n_buildings", "n_assigned", "buildings_reconstructed", *(F.round(c, 6).alias(c) for c in names))


@query(" SELECT fid AS footprint_id FROM houses WHERE what IN (1, 6, 16)")
def no_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines that no single reference building lies in."""
    v = Village(spark, sf_dir)
    single = assessment.roof_outlines(v.roofs).join(v.buildings.where("not is_grouped"), "building_id").select("building_id", "edges")
    footprints = v.footprints.select(F.col("fid").alias("footprint_id"), "edges")
    return evaluation.no_reference(footprints.select("footprint_id"), clip.assign(footprints, single, 20.0, name="footprint_id"))


@query(" SELECT fid AS footprint_id FROM houses WHERE what = 16 ORDER BY 1 LIMIT 100")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines that have no run yet, in order, up to a limit asked for; those with a reference have been run."""
    v = Village(spark, sf_dir)
    return sinks.resume(v.houses.select(F.col("fid").alias("footprint_id")), v.houses.where("what <> 16").select(F.col("fid").alias("footprint_id")), 100)


@query(""" SELECT 'B' || CAST(k.fid AS VARCHAR) AS building_id, CAST(CASE kind WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS INT) AS n_pred_planes, CAST(CASE kind WHEN 2 THEN 1 ELSE 2 END AS INT) AS n_ref_planes,
  CAST(CASE kind WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS INT) AS n_pairs, 0.0 AS worst_deg FROM houses k WHERE what IN (11, 21)""")
def plane_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of reconstructions and of the reference that overlap by the least share, matched one to one."""
    r = Village(spark, sf_dir).results.where("share is not null")
    return r.select("building_id", "n_pred_planes", "n_ref_planes", F.size("orientation_errors_deg").alias("n_pairs"), (F.round(F.array_max("orientation_errors_deg"), 3) + 0.0).alias("worst_deg"))
