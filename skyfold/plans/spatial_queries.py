"""Queries of the spatial operators over the scene, each with the plain SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import clip, planes_sql, regions, spatial
from skyfold.plans.scene import Scene, with_clause

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CELL, MARGIN, BIN = 500, 2000, 20_000  # millimetres

# the even-odd rule as a relation: edges crossed by a ray from the point, edges that hold it, and the distance
_INSIDE = """
SELECT p.pid, e.fid,
       sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND ((e.x2 - e.x1) * (p.y - e.y1) - (p.x - e.x1) * (e.y2 - e.y1)) * sign(e.y2 - e.y1) > 0 THEN 1 ELSE 0 END) % 2 = 1 AS odd,
       bool_or((e.x2 - e.x1) * (p.y - e.y1) = (p.x - e.x1) * (e.y2 - e.y1) AND p.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS edge,
       min(greatest(0, least(e.x1, e.x2) - p.x, p.x - greatest(e.x1, e.x2)) ** 2 + greatest(0, least(e.y1, e.y2) - p.y, p.y - greatest(e.y1, e.y2)) ** 2) AS d2
FROM points p JOIN edges e ON e.fid = p.fid GROUP BY p.pid, e.fid
"""


def query(sql: str | None = None, *names: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (with_clause(*names) if names else "") + sql
        return f

    return register


@query("SELECT concat(CAST(CAST(floor(x / 1000000.0) AS BIGINT) AS VARCHAR), '-', CAST(CAST(floor(y / 1000000.0) AS BIGINT) AS VARCHAR)) AS tile, count(*) AS n FROM points GROUP BY 1", "points")
def tile_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scene(spark, sf_dir).points.groupBy(geo.tile_name(F.col("x"), F.col("y"), 1000).alias("tile")).agg(F.count("*").alias("n"))


@query("""SELECT 'fp-' || CAST(CAST(floor((ox + w / 2) / 1000 * 10 + 0.5) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor((oy + d / 2) / 1000 * 10 + 0.5) AS BIGINT) AS VARCHAR) AS footprint_id,
  bool_or(lidar_derived OR dup) AS lidar_derived, min(ordinal) AS ordinal
  FROM (SELECT *, fid AS ordinal, false AS dup FROM footprints UNION ALL SELECT *, fid + 1000000, true FROM footprints WHERE fid % 10 = 0) t GROUP BY 1""", "footprints")
def footprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Scene(spark, sf_dir).sql("footprints")
    f = f.withColumn("ordinal", F.col("fid")).unionByName(f.where("fid % 10 = 0").withColumn("ordinal", F.col("fid") + 1000000).withColumn("lidar_derived", F.lit(True)))
    f = f.withColumn("footprint_id", geo.footprint_id((F.col("ox") + F.col("w") / 2) / 1000, (F.col("oy") + F.col("d") / 2) / 1000))
    return clip.dedup_footprints(f).select("footprint_id", "lidar_derived", "ordinal")


@query("""SELECT cls, CASE WHEN cls IN (1, 28) THEN 'keep_if_elevated' WHEN cls = 6 THEN 'keep' ELSE 'drop' END AS policy, count(*) AS n FROM points GROUP BY 1, 2""", "points")
def class_policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Scene(spark, sf_dir).points
    return p.withColumn("policy", clip.policy(F.col("cls"))).groupBy("cls", "policy").agg(F.count("*").alias("n"))


@query(f"""SELECT i.fid, count(*) AS n_points, sum(p.z) AS sum_z FROM ({_INSIDE}) i JOIN points p ON p.pid = i.pid AND p.fid = i.fid WHERE odd OR d2 < 4000000 GROUP BY i.fid""", "points", "edges")
def points_in_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    met = spatial.points_in_shapes(s.points.drop("fid"), s.footprints.select("fid", "edges"), BIN, MARGIN)
    return met.groupBy("fid").agg(F.count("*").alias("n_points"), F.sum("z").alias("sum_z"))


@query("""SELECT f.fid, count(*) AS n, min(p.z) AS z_min FROM footprints f JOIN points p ON p.x BETWEEN f.ox AND f.ox + f.w AND p.y BETWEEN f.oy AND f.oy + f.d GROUP BY f.fid""", "points", "footprints")
def window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    w = s.sql("footprints").select("fid", F.col("ox").alias("xmin"), F.col("oy").alias("ymin"), (F.col("ox") + F.col("w")).alias("xmax"), (F.col("oy") + F.col("d")).alias("ymax"))
    return spatial.window_query(s.points.drop("fid"), w, BIN).groupBy("fid").agg(F.count("*").alias("n"), F.min("z").alias("z_min"))


@query("""SELECT fid, pid, median(z) AS ground FROM (
  SELECT q.fid, q.pid, t.z, row_number() OVER (PARTITION BY q.fid, q.pid ORDER BY (q.x - t.x) ** 2 + (q.y - t.y) ** 2, t.pid) AS rn
  FROM points q JOIN points t ON t.fid = q.fid AND t.cls = 2 WHERE q.cls = 28) WHERE rn <= 8 GROUP BY fid, pid""", "points")
def local_ground_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Scene(spark, sf_dir).points
    return spatial.nearest_median(p.where("cls = 28").select("fid", "pid", "x", "y"), p.where("cls = 2"), "fid", 8)


@query("""SELECT fid, round(coalesce(quantile_cont(z, 0.05) FILTER (WHERE cls = 2), min(z)), 4) AS ground_z FROM points GROUP BY fid""", "points")
def floor_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scene(spark, sf_dir).points.groupBy("fid").agg(F.round(clip.floor_height("z", "cls"), 4).alias("ground_z"))


@query(f"""SELECT f.fid, count(i.pid) AS n, count(*) FILTER (WHERE i.cls = 1) AS n_1, count(*) FILTER (WHERE i.cls = 6) AS n_6, count(*) FILTER (WHERE i.cls = 28) AS n_28,
  round(count(i.pid) / (f.area / 1000000), 6) AS density, CASE WHEN count(i.pid) / (f.area / 1000000) < 5 THEN '<5' WHEN count(i.pid) / (f.area / 1000000) < 10 THEN '5-10' WHEN count(i.pid) / (f.area / 1000000) < 20 THEN '10-20' ELSE '>=20' END AS bin
  FROM footprints f LEFT JOIN (SELECT i.fid, p.pid, p.cls FROM ({_INSIDE}) i JOIN points p ON p.pid = i.pid AND p.fid = i.fid
    LEFT JOIN (SELECT fid, pid, median(z) AS ground FROM (SELECT q.fid, q.pid, t.z, row_number() OVER (PARTITION BY q.fid, q.pid ORDER BY (q.x - t.x) ** 2 + (q.y - t.y) ** 2, t.pid) AS rn
      FROM points q JOIN points t ON t.fid = q.fid AND t.cls = 2 WHERE q.cls IN (1, 28)) WHERE rn <= 8 GROUP BY fid, pid) g ON g.fid = p.fid AND g.pid = p.pid
    WHERE (i.odd OR i.edge) AND (p.cls = 6 OR (p.cls IN (1, 28) AND p.z - g.ground > 1500))) i ON i.fid = f.fid GROUP BY f.fid, f.area""", "points", "edges")
def density_by_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roof points of every outline, by class, and their density."""
    s = Scene(spark, sf_dir)
    shapes = s.footprints.select("fid", "edges", "area")
    kept = clip.clip(s.points.drop("fid"), shapes.drop("area"), bin_size=BIN, margin=MARGIN, height=1500)
    counts = kept.groupBy("fid").agg(F.count("*").alias("n"), *(F.count_if(F.col("cls") == c).alias(f"n_{c}") for c in (1, 6, 28)))
    out = shapes.drop("edges").join(counts, "fid", "left").fillna(0, ["n", "n_1", "n_6", "n_28"])
    density = F.when(F.col("area") > 0, F.col("n") / (F.col("area") / 1000000)).otherwise(0.0)
    return out.withColumn("bin", geo.density_bin(density)).withColumn("density", F.round(density, 6)).drop("area")


@query("""SELECT building_id, ordinal, round((x1 - x0) * (yb - ya) * sqrt(1 + sy * sy / 4.0) / 1e6, 6) AS area_m2, round(CASE WHEN sy = 0 THEN 0 ELSE degrees(atan(0.5)) END, 6) AS slope_deg FROM roofs""", "roofs")
def newell_area_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Scene(spark, sf_dir).roofs
    return r.select("building_id", "ordinal", F.round(geo.ring_area(F.col("ring")) / 1e6, 6).alias("area_m2"), F.round(geo.slope_degrees(geo.newell(F.col("ring"))), 6).alias("slope_deg"))


@query("""SELECT building_id, round(sum(a), 6) AS roof_area_m2, round(sum(a * s) / sum(a), 6) AS mean_slope_deg, round(sum(CASE WHEN s >= 15 THEN a ELSE 0 END) / sum(a), 6) AS steep_fraction,
  CASE WHEN sum(CASE WHEN s >= 15 THEN a ELSE 0 END) / sum(a) < 0.1 THEN 'flat' WHEN sum(CASE WHEN s >= 15 THEN a ELSE 0 END) / sum(a) < 0.6 THEN 'mixed' ELSE 'pitched' END AS roof_type
  FROM (SELECT building_id, (x1 - x0) * (yb - ya) * sqrt(1 + sy * sy / 4.0) / 1e6 AS a, CASE WHEN sy = 0 THEN 0 ELSE degrees(atan(0.5)) END AS s FROM roofs) t GROUP BY building_id""", "roofs")
def roof_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clip.roof_summary(Scene(spark, sf_dir).roofs.withColumn("area_m2", geo.ring_area(F.col("ring")) / 1e6).withColumn("slope_deg", geo.slope_degrees(geo.newell(F.col("ring")))), "building_id")
    return out.select("building_id", *(F.round(c, 6).alias(c) for c in ("roof_area_m2", "mean_slope_deg", "steep_fraction")), "roof_type")


@query("""SELECT fid, round(covar_pop(x, x), 2) AS xx, round(covar_pop(x, y), 2) AS xy, round(covar_pop(y, y), 2) AS yy, round(covar_pop(x, z), 2) AS xz, round(covar_pop(y, z), 2) AS yz, round(covar_pop(z, z), 2) AS zz
  FROM (SELECT p.fid, CAST(p.x - f.ox AS DOUBLE) / 1000 AS x, CAST(p.y - f.oy AS DOUBLE) / 1000 AS y, CAST(p.z AS DOUBLE) / 1000 AS z FROM points p JOIN footprints f ON f.fid = p.fid WHERE p.cls = 6) GROUP BY fid""", "points", "footprints")
def plane_fit_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scatter from which a total least squares plane is solved."""
    m = planes_sql.moments(_local(spark, sf_dir).where("cls = 6"), "fid")
    return m.select("fid", *(F.round(c, 2).alias(c) for c in ("xx", "xy", "yy", "xz", "yz", "zz")))


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in metres about their outline's origin."""
    s = Scene(spark, sf_dir)
    f = s.sql("footprints").select("fid", "ox", "oy")
    m = lambda c, o=None: ((F.col(c) - F.col(o) if o else F.col(c)).cast("double") / 1000).alias(c)
    return s.points.join(f, "fid").select("fid", "pid", "cls", m("x", "ox"), m("y", "oy"), m("z"))


# the least eigenvalue of the scatter by its trigonometric form, its vector by the longest cross product of two rows
_TLS = """, m AS (SELECT p.fid, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, y) AS d, covar_pop(y, z) AS e, covar_pop(z, z) AS f
  FROM (SELECT p.fid, CAST(p.x - f.ox AS DOUBLE) / 1000 AS x, CAST(p.y - f.oy AS DOUBLE) / 1000 AS y, CAST(p.z AS DOUBLE) / 1000 AS z FROM points p JOIN footprints f ON f.fid = p.fid WHERE p.cls = 6) p GROUP BY p.fid HAVING count(*) >= 3),
  q AS (SELECT *, (a + d + f) / 3 AS q FROM m), s AS (SELECT *, sqrt(((a - q) ** 2 + (d - q) ** 2 + (f - q) ** 2 + 2 * (b * b + c * c + e * e)) / 6) AS s FROM q),
  l AS (SELECT *, q + 2 * s * cos(acos(greatest(-1, least(1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * s ** 3)))) / 3 + 2 * pi() / 3) AS v FROM s),
  x AS (SELECT *, b * e - c * (d - v) AS x1, c * b - (a - v) * e AS y1, (a - v) * (d - v) - b * b AS z1, b * (f - v) - c * e AS x2, c * c - (a - v) * (f - v) AS y2, (a - v) * e - b * c AS z2, (d - v) * (f - v) - e * e AS x3, e * c - b * (f - v) AS y3, b * e - (d - v) * c AS z3 FROM l),
  k AS (SELECT *, x1 * x1 + y1 * y1 + z1 * z1 AS n1, x2 * x2 + y2 * y2 + z2 * z2 AS n2, x3 * x3 + y3 * y3 + z3 * z3 AS n3 FROM x),
  o AS (SELECT fid, n, mx, my, mz, CASE WHEN n1 >= n2 AND n1 >= n3 THEN [x1, y1, z1] WHEN n2 >= n3 THEN [x2, y2, z2] ELSE [x3, y3, z3] END AS w, sqrt(greatest(n1, n2, n3)) AS size FROM k),
  u AS (SELECT fid, n, mx, my, mz, w[1] / size * sign(w[3]) AS nx, w[2] / size * sign(w[3]) AS ny, w[3] / size * sign(w[3]) AS nz FROM o)"""


@query(_TLS + " SELECT fid, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz, round(nx * mx + ny * my + nz * mz, 4) AS d, n FROM u", "points", "footprints")
def plane_fit_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planes_sql.fit(_local(spark, sf_dir).where("cls = 6"), "fid")
    return out.select("fid", *((F.round(c, 5) + 0.0).alias(c) for c in ("nx", "ny", "nz")), F.round("d", 4).alias("d"), "n")


_PLANES = """planes(k, sx, sy, h) AS (VALUES (0, 0.0, 0.0, 36.0), (1, 0.0, 0.5, 36.0), (2, 0.25, 0.0, 36.0), (3, 0.0, 0.0, 30.0)),
 local AS (SELECT p.fid, p.pid, p.cls, CAST(p.x - f.ox AS DOUBLE) / 1000 AS x, CAST(p.y - f.oy AS DOUBLE) / 1000 AS y, CAST(p.z AS DOUBLE) / 1000 AS z FROM points p JOIN footprints f ON f.fid = p.fid),
 far AS (SELECT l.*, k, abs(z - h - sx * x - sy * y) / sqrt(1 + sx * sx + sy * sy) AS dist, sx, sy FROM local l CROSS JOIN planes)"""


def _planes(spark: SparkSession) -> DataFrame:
    p = spark.createDataFrame([(0, 0.0, 0.0, 36.0), (1, 0.0, 0.5, 36.0), (2, 0.25, 0.0, 36.0), (3, 0.0, 0.0, 30.0)], "k int, sx double, sy double, h double")
    n = F.sqrt(1 + F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    return F.broadcast(p.select("k", F.struct((-F.col("sx") / n).alias("nx"), (-F.col("sy") / n).alias("ny"), (1 / n).alias("nz"), (F.col("h") / n).alias("d")).alias("plane")))


def _far(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = _local(spark, sf_dir).crossJoin(_planes(spark))  # four fixed planes
    return far.withColumn("dist", geo.plane_distance(F.col("plane"), F.col("x"), F.col("y"), F.col("z")))


@query(", " + _PLANES + "SELECT fid, k, count(*) AS n, round(avg(dist), 6) AS mean_dist FROM far WHERE dist <= 0.1501 GROUP BY fid, k", "points", "footprints")
def plane_distance_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _far(spark, sf_dir).where("dist <= 0.1501").groupBy("fid", "k").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("mean_dist"))


@query(", " + _PLANES + "SELECT fid, k, round(quantile_cont(along, 0.95) - quantile_cont(along, 0.05), 6) AS depth FROM (SELECT *, -(x * sx + y * sy) / sqrt(sx * sx + sy * sy) * sqrt(1 + sx * sx + sy * sy) AS along FROM far WHERE dist <= 0.1501 AND sx + sy > 0) GROUP BY fid, k", "points", "footprints")
def downslope_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = _far(spark, sf_dir).where("dist <= 0.1501").where("plane.nx <> 0 or plane.ny <> 0")
    p, run = F.col("plane"), F.sqrt(F.col("plane.nx") ** 2 + F.col("plane.ny") ** 2)
    along = (F.col("x") * p.nx + F.col("y") * p.ny) / run / p.nz
    return far.groupBy("fid", "k").agg(F.round(F.percentile(along, 0.95) - F.percentile(along, 0.05), 6).alias("depth"))


@query(", " + _PLANES + """, owned AS (SELECT fid, pid, x, y, min_by(k, dist * 100 + k / 1e6) AS k FROM far WHERE dist <= 0.1501 GROUP BY fid, pid, x, y)
  SELECT a.fid, a.k AS a, b.k AS b, count(DISTINCT b.pid) AS n FROM owned a JOIN owned b ON a.fid = b.fid AND a.k < b.k AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.5625 GROUP BY 1, 2, 3 HAVING count(DISTINCT b.pid) >= 3""", "points", "footprints")
def plane_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = planes_sql.nearest_plane(_far(spark, sf_dir), ["fid", "pid", "x", "y"], 0.1501)
    return planes_sql.adjacency(owned, "fid", 0.75, 3)


@query(", " + _PLANES + "SELECT fid, pid, min_by(k, dist * 100 + k / 1e6) AS k FROM far WHERE dist <= 0.5 AND cls <> 2 GROUP BY fid, pid", "points", "footprints")
def absorb_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes_sql.nearest_plane(_far(spark, sf_dir).where("cls <> 2"), ["fid", "pid"], 0.5)


_LABELS = ", " + _PLANES + """, cells AS (SELECT fid, CAST(floor(x * 2) AS BIGINT) AS cx, CAST(floor(y * 2) AS BIGINT) AS cy, median(z) AS z FROM local WHERE cls = 6 GROUP BY 1, 2, 3),
  labels AS (SELECT fid, cx, cy, min_by(k, round(abs(z - h - sx * (cx / 2.0 + 0.25) - sy * (cy / 2.0 + 0.25)), 9) * 1000 + k / 1e3) AS label FROM cells CROSS JOIN planes GROUP BY fid, cx, cy)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _local(spark, sf_dir).where("cls = 6")
    cells = spatial.cell_median(p, ["fid"], 0.5, "z").withColumn("x", F.col("cx") / 2 + 0.25).withColumn("y", F.col("cy") / 2 + 0.25)
    return planes_sql.label_cells(cells, _planes(spark), ["fid", "cx", "cy"])


@query(_LABELS + " SELECT fid, cx, cy, label FROM labels", "points", "footprints")
def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query(_LABELS + """, near AS (SELECT a.fid, a.cx, a.cy, a.label AS own, b.label, count(*) AS n FROM labels a JOIN labels b ON a.fid = b.fid AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY 1, 2, 3, 4, 5)
  SELECT fid, cx, cy, CASE WHEN max(n) = coalesce(max(n) FILTER (WHERE label = own), 0) THEN own ELSE min_by(label, -n * 100 + label) END AS label FROM near GROUP BY fid, cx, cy, own""", "points", "footprints")
def majority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes_sql.majority(_labels(spark, sf_dir), "fid")


@query()
def label_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the labelled cells: those of one label that touch by a side."""
    return regions.label_regions(_labels(spark, sf_dir), "fid")


ORACLE_SQL["label_regions"] = (with_clause("points", "footprints") + _LABELS).replace("WITH ", "WITH RECURSIVE ", 1) + """, reach AS (SELECT fid, label, cx, cy, cx AS rx, cy AS ry FROM labels
  UNION SELECT r.fid, r.label, b.cx, b.cy, r.rx, r.ry FROM reach r JOIN labels b ON b.fid = r.fid AND b.label = r.label AND abs(b.cx - r.cx) + abs(b.cy - r.cy) = 1)
  SELECT fid, label, first.rx AS first_cx, first.ry AS first_cy, count(*) AS n FROM (SELECT fid, label, cx, cy, min({'ry': ry, 'rx': rx}) AS first FROM reach GROUP BY fid, label, cx, cy) GROUP BY ALL"""


@query("""SELECT b.building_id, CASE WHEN max(share) >= 0.5 THEN min(fid) FILTER (WHERE share >= top - 1e-9) END AS fid, round(CASE WHEN max(share) >= 0.5 THEN max(share) END, 6) AS share FROM buildings b LEFT JOIN (
  SELECT *, max(share) OVER (PARTITION BY building_id) AS top FROM (SELECT b.building_id, f.fid,
   (greatest(0, least(b.x1, f.ox + f.w) - greatest(b.x0, f.ox)) * greatest(0, least(b.y1, f.oy + f.d) - greatest(b.y0, f.oy))
    - CASE WHEN f.shape = 'L' THEN greatest(0, least(b.x1, f.ox + f.w) - greatest(b.x0, f.ox + f.w / 2)) * greatest(0, least(b.y1, f.oy + f.d) - greatest(b.y0, f.oy + f.d / 2)) ELSE 0 END)
   / CAST((b.x1 - b.x0) * (b.y1 - b.y0) AS DOUBLE) AS share FROM buildings b JOIN footprints f ON b.x0 <= f.ox + f.w AND b.x1 >= f.ox AND b.y0 <= f.oy + f.d AND b.y1 >= f.oy) WHERE share > 0) s ON s.building_id = b.building_id GROUP BY b.building_id""", "buildings", "footprints")
def assign_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    got = clip.assign(s.footprints.select("fid", "edges"), s.buildings.select("building_id", "edges"), BIN)
    return s.buildings.select("building_id").join(got, "building_id", "left").select("building_id", "fid", F.round("share", 6).alias("share"))


_CELLS = """, cells AS (SELECT building_id, cx, cy, cx * 500 + 250 AS x, cy * 500 + 250 AS y FROM (SELECT building_id, x0, x1, y0, y1, cx, unnest(range(CAST(floor(y0 / 500.0) AS BIGINT), CAST(floor(y1 / 500.0) AS BIGINT) + 1)) AS cy
  FROM (SELECT building_id, x0, x1, y0, y1, unnest(range(CAST(floor(x0 / 500.0) AS BIGINT), CAST(floor(x1 / 500.0) AS BIGINT) + 1)) AS cx FROM buildings))
  WHERE cx * 500 + 250 - x0 > 500 AND x1 - (cx * 500 + 250) > 500 AND cy * 500 + 250 - y0 > 500 AND y1 - (cy * 500 + 250) > 500)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cells_of(Scene(spark, sf_dir).buildings.select("building_id", "edges"), CELL, CELL)


@query(_CELLS + " SELECT building_id, count(*) AS n, min(cx) AS cx_min, max(cy) AS cy_max FROM cells GROUP BY building_id", "buildings", "footprints")
def eval_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("building_id").agg(F.count("*").alias("n"), F.min("cx").alias("cx_min"), F.max("cy").alias("cy_max"))


_REF = _CELLS + """, ref AS (SELECT c.building_id, c.cx, c.cy, c.x, c.y, max(r.h + (c.y - r.py) * r.sy / 2.0) AS z_ref FROM cells c LEFT JOIN roofs r ON r.building_id = c.building_id AND c.x BETWEEN r.x0 AND r.x1 AND c.y BETWEEN r.ya AND r.yb GROUP BY ALL)"""


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = Scene(spark, sf_dir).roofs.select("building_id", "edges", "plane")
    return spatial.surface(_cells(spark, sf_dir), faces, ["building_id"], BIN, "z_ref")


@query(_REF + " SELECT building_id, count(z_ref) AS n, round(sum(z_ref), 1) AS total, round(max(z_ref), 3) AS top FROM ref GROUP BY building_id", "roofs")
def reference_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference(spark, sf_dir).groupBy("building_id").agg(F.count("z_ref").alias("n"), F.round(F.sum("z_ref"), 1).alias("total"), F.round(F.max("z_ref"), 3).alias("top"))


_LIDAR = ", medians AS (SELECT CAST(floor(x / 500.0) AS BIGINT) AS cx, CAST(floor(y / 500.0) AS BIGINT) AS cy, median(z) AS z_lidar FROM points WHERE cls = 6 GROUP BY 1, 2)"


@query("SELECT CAST(floor(x / 500.0) AS BIGINT) AS cx, CAST(floor(y / 500.0) AS BIGINT) AS cy, median(z) AS z_lidar FROM points WHERE cls = 6 GROUP BY 1, 2", "points")
def lidar_cell_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cell_median(Scene(spark, sf_dir).points.where("cls = 6"), [], CELL)


# the predicted surface: the outline's faces by the scene's own rule of its roof
_PRED = _REF + _LIDAR + """, pred AS (SELECT r.building_id, r.cx, r.cy, z_ref, z_lidar, CASE WHEN r.x BETWEEN b.ox AND b.ox + b.w THEN 36000 + CASE b.fid % 3 WHEN 2 THEN (r.x - b.ox) / 4.0 ELSE 0 END END AS z_pred
  FROM ref r JOIN buildings u ON u.building_id = r.building_id JOIN footprints b ON b.fid = u.home LEFT JOIN medians m ON m.cx = r.cx AND m.cy = r.cy)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    f = s.sql("footprints")
    c = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("ox").cast("double"), F.col("oy").cast("double"), F.col("ox") + F.col("w"), F.col("oy") + F.col("d")
    slope = F.when(F.col("fid") % 3 == 2, 0.25).otherwise(0.0)
    plane = F.struct((-slope).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), (36000 - slope * F.col("ox")).alias("d"))
    faces = f.select(F.col("fid").alias("home"), geo.ring_edges(F.array(c(x0, y0), c(x1, y0), c(x1, y1), c(x0, y1))).alias("edges"), plane.alias("plane"))
    faces = s.buildings.select("building_id", "home").join(faces, "home").select("building_id", "edges", "plane")
    every = faces.withColumn("is_ref", F.lit(False)).unionByName(s.roofs.select("building_id", "edges", "plane", F.lit(True).alias("is_ref")))
    cells = spatial.surfaces(_cells(spark, sf_dir), every, ["building_id"], BIN)
    lidar = spatial.cell_median(s.points.where("cls = 6"), [], CELL)
    return cells.join(lidar, ["cx", "cy"], "left")


@query(_PRED + " SELECT building_id, count(z_pred) AS n, round(sum(z_pred), 1) AS total FROM pred GROUP BY building_id", "points", "roofs")
def predicted_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).groupBy("building_id").agg(F.count("z_pred").alias("n"), F.round(F.sum("z_pred"), 1).alias("total"))


@query(_PRED + """ SELECT building_id, count(z_ref) AS n_ref_cells, count(*) FILTER (WHERE z_ref IS NOT NULL AND z_pred IS NOT NULL) AS n_valid_cells, round(coalesce(sum((z_pred - z_ref) ** 2), 0) / 1e6, 10) AS sum_sq_m2,
  round(sqrt(sum((z_pred - z_ref) ** 2) / 1e6 / count(*) FILTER (WHERE z_ref IS NOT NULL AND z_pred IS NOT NULL)), 9) AS rmse_m, round(count(*) FILTER (WHERE z_ref IS NOT NULL AND z_pred IS NOT NULL) / nullif(count(z_ref), 0), 6) AS coverage, round(median(z_lidar - z_ref) / 1000, 9) AS temporal_offset_m,
  CASE WHEN abs(median(z_lidar - z_ref) / 1000) > 1.5 THEN 'suspect-temporal' ELSE 'ok' END AS status FROM pred GROUP BY building_id""", "points", "roofs")
def building_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.operators import evaluation

    out = evaluation.score_cells(_predicted(spark, sf_dir), ["building_id"], unit=1000.0)
    r = lambda c, n: F.round(c, n).alias(c)
    status = evaluation.temporal_status(F.lit("ok"), F.col("temporal_offset_m")).alias("status")
    return out.select("building_id", "n_ref_cells", "n_valid_cells", r("sum_sq_m2", 10), r("rmse_m", 9), r("coverage", 6), r("temporal_offset_m", 9), status)


@query("""SELECT f.fid FROM footprints f WHERE (CAST(floor(ox / 200000.0) AS BIGINT) + CAST(floor(oy / 200000.0) AS BIGINT)) % 3 = 0 OR (CAST(floor((ox + w) / 200000.0) AS BIGINT) + CAST(floor(oy / 200000.0) AS BIGINT)) % 3 = 0
  OR (CAST(floor(ox / 200000.0) AS BIGINT) + CAST(floor((oy + d) / 200000.0) AS BIGINT)) % 3 = 0 OR (CAST(floor((ox + w) / 200000.0) AS BIGINT) + CAST(floor((oy + d) / 200000.0) AS BIGINT)) % 3 = 0""", "footprints")
def beyond_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines that touch a tile of 200 m which is not among those present."""
    touched = spatial.touched_cells(Scene(spark, sf_dir).footprints.select("fid", "edges"), 200_000)
    tiles = touched.select("bx", "by").distinct().where("(bx + by) % 3 <> 0")
    return touched.join(tiles, ["bx", "by"], "left_anti").select("fid").distinct()


@query("SELECT CAST(floor(x / 250000.0) AS BIGINT) AS bx, CAST(floor(y / 250000.0) AS BIGINT) AS by, count(*) AS n FROM points GROUP BY 1, 2", "points")
def spatial_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scene(spark, sf_dir).points.select(geo.block_id(F.col("x"), F.col("y"), 250_000).alias("b")).groupBy("b.bx", "b.by").agg(F.count("*").alias("n"))


@query("SELECT min(ox) - 25000 AS xmin, min(oy) - 25000 AS ymin, max(ox + w) + 25000 AS xmax, max(oy + d) + 25000 AS ymax FROM footprints", "footprints")
def covering_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spatial.with_bounds(Scene(spark, sf_dir).footprints)
    return b.agg((F.min("xmin") - 25000).alias("xmin"), (F.min("ymin") - 25000).alias("ymin"), (F.max("xmax") + 25000).cast("double").alias("xmax"), (F.max("ymax") + 25000).cast("double").alias("ymax"))


@query("""SELECT pid, cls FROM (SELECT pid, cls, row_number() OVER (PARTITION BY cls ORDER BY ('0x' || substr(md5(pid), 1, 8))::BIGINT, pid) AS rn FROM points) WHERE rn <= CASE cls WHEN 6 THEN 200 ELSE 50 END""", "points")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class the points of the smallest keys, up to its quota. The rank is limited by the largest quota first, which
    Spark applies in every task before the shuffle (a window group limit); each class's own quota comes after."""
    p = Scene(spark, sf_dir).points.select("pid", "cls", F.conv(F.substring(F.md5("pid"), 1, 8), 16, 10).cast("bigint").alias("key"))
    p = p.withColumn("rn", F.row_number().over(Window.partitionBy("cls").orderBy("key", "pid")))
    return p.where("rn <= 200").where("cls = 6 or rn <= 50").select("pid", "cls")


@query("""SELECT pid, CAST(round_even((x - lx) / 1000.0 / scale, 0) AS BIGINT) AS qx, CAST(round_even((y - ly) / 1000.0 / scale, 0) AS BIGINT) AS qy FROM points CROSS JOIN
  (SELECT min(x) AS lx, min(y) AS ly, greatest(greatest(max(x) - min(x), max(y) - min(y)) / 1000.0 / 65000, 0.001) AS scale FROM points)""", "points")
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip.quantise(Scene(spark, sf_dir).points)
