"""Queries of scores, aggregates and reports over the scene's results, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import geo, solids
from skyfold.operators import evaluation
from skyfold.plans.scene import Scene, with_clause

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_ROWS = """, r AS (SELECT *, sqrt(sum_sq_m2 / nullif(n_valid_cells, 0)) AS rmse_m, status NOT IN ('no-match', 'grouped-reference', 'no-reference') AS asg, status IN ('ok', 'suspect-temporal') AS rec,
  least(n_pred_faces, n_ref_faces) / CAST(greatest(n_pred_faces, n_ref_faces) AS DOUBLE) AS agree,
  CASE WHEN status IN ('no-reference', 'no-match') THEN NULL ELSE n_valid_cells / CAST(nullif(n_ref_cells, 0) AS DOUBLE) END AS cov FROM results)"""
_DENSITY = "CASE WHEN point_density < 5 THEN '<5' WHEN point_density < 10 THEN '5-10' WHEN point_density < 20 THEN '10-20' WHEN point_density >= 20 THEN '>=20' ELSE 'n/a' END"
_SIZE = "CASE WHEN outline_area_m2 < 100 THEN '<100' WHEN outline_area_m2 < 250 THEN '100-250' WHEN outline_area_m2 < 1000 THEN '250-1000' ELSE '>=1000' END"


def _sums(rows: str) -> str:
    return f"""count(*) FILTER (WHERE status <> 'no-reference') AS n_buildings, count(*) FILTER (WHERE asg) AS n_assigned, count(*) FILTER (WHERE rec) AS buildings_reconstructed,
  round(sqrt(sum(sum_sq_m2) FILTER (WHERE asg) / nullif(sum(n_valid_cells) FILTER (WHERE asg), 0)), 6) AS vertical_rmse_m, round(median(rmse_m) FILTER (WHERE asg), 6) AS median_building_rmse_m,
  round(sum(n_valid_cells) FILTER (WHERE asg) / nullif(sum(n_ref_cells) FILTER (WHERE asg), 0), 6) AS coverage, round(avg(agree) FILTER (WHERE rec), 6) AS face_count_agreement,
  round(count(*) FILTER (WHERE asg) / nullif(count(*) FILTER (WHERE status NOT IN ('no-reference', 'grouped-reference')), 0), 6) AS match_rate {rows}"""


def query(sql: str | None = None, *names: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (with_clause(*names) if names else "") + sql
        return f

    return register


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_FLOATS = ("vertical_rmse_m", "median_building_rmse_m", "coverage", "face_count_agreement", "match_rate", "orientation_error_median_deg", "orientation_error_p90_deg")


@query(_ROWS + ", a AS (SELECT unnest([a1, a2]) AS v FROM r WHERE rec) SELECT " + _sums(""", count(*) FILTER (WHERE status = 'grouped-reference') AS n_grouped, count(*) FILTER (WHERE status = 'no-reference') AS n_no_reference,
  CAST(sum(n_unmatched_pred) FILTER (WHERE rec) AS BIGINT) AS n_unmatched_pred_planes, CAST(sum(n_unmatched_ref) FILTER (WHERE rec) AS BIGINT) AS n_unmatched_ref_planes, CAST(sum(n_pred_faces) FILTER (WHERE rec) AS BIGINT) AS n_pred_faces, CAST(sum(n_ref_faces) FILTER (WHERE rec) AS BIGINT) AS n_ref_faces,
  min(share) FILTER (WHERE asg) AS share_p0, round(quantile_cont(share, 0.1) FILTER (WHERE asg), 6) AS share_p10, round(median(share) FILTER (WHERE asg), 6) AS share_p50""") + """,
  (SELECT round(median(v), 6) FROM a) AS orientation_error_median_deg, (SELECT round(quantile_cont(v, 0.9), 6) FROM a) AS orientation_error_p90_deg, (SELECT count(*) FROM a) AS n_plane_pairs FROM r""", "results")
def headline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summarise(Scene(spark, sf_dir).results), *_FLOATS, "share_p10", "share_p50")


@query(_ROWS + f""", m AS (SELECT r.*, v.variant, u.axis, u.bin FROM r CROSS JOIN (VALUES ('raw'), ('excluding suspect-temporal')) AS v(variant)
   CROSS JOIN LATERAL (VALUES ('overall', 'all buildings'), ('overall', CASE WHEN lidar_derived THEN 'LiDAR-derived footprints' WHEN NOT lidar_derived THEN 'independent footprints' END), ('roof type', coalesce(roof_type, 'n/a')),
     ('size (m²)', CASE WHEN status = 'no-reference' THEN 'n/a' ELSE {_SIZE} END), ('point density (pts/m²)', {_DENSITY})) AS u(axis, bin) WHERE v.variant = 'raw' OR status <> 'suspect-temporal'),
  bins(axis, bin) AS (VALUES ('overall', 'all buildings'), ('overall', 'independent footprints'), ('overall', 'LiDAR-derived footprints'), ('roof type', 'flat'), ('roof type', 'mixed'), ('roof type', 'pitched'),
    ('size (m²)', '<100'), ('size (m²)', '100-250'), ('size (m²)', '250-1000'), ('size (m²)', '>=1000'), ('point density (pts/m²)', '<5'), ('point density (pts/m²)', '5-10'), ('point density (pts/m²)', '10-20'), ('point density (pts/m²)', '>=20'), ('point density (pts/m²)', 'n/a')),
  g AS (SELECT variant, axis, bin, """ + _sums("FROM m GROUP BY variant, axis, bin") + """), a AS (SELECT variant, axis, bin, round(median(v), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM (SELECT variant, axis, bin, unnest([a1, a2]) AS v FROM m WHERE rec) GROUP BY 1, 2, 3)
  SELECT v.variant, b.axis, b.bin, coalesce(n_buildings, 0) AS n_buildings, coalesce(n_assigned, 0) AS n_assigned, coalesce(buildings_reconstructed, 0) AS buildings_reconstructed, vertical_rmse_m, median_building_rmse_m, coverage, p50 AS orientation_error_median_deg, p90 AS orientation_error_p90_deg, face_count_agreement, match_rate
  FROM (VALUES ('raw'), ('excluding suspect-temporal')) AS v(variant) CROSS JOIN bins b LEFT JOIN g ON g.variant = v.variant AND g.axis = b.axis AND g.bin = b.bin LEFT JOIN a ON a.variant = v.variant AND a.axis = b.axis AND a.bin = b.bin""", "results")
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.breakdown(Scene(spark, sf_dir).results), *_FLOATS)


@query("SELECT status, count(*) AS n FROM results GROUP BY status", "results")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.status_counts(Scene(spark, sf_dir).results)


@query("SELECT unnest(['saddle', 'sliver']) AS warning, count(*) AS n FROM results WHERE building_id % 7 = 0 GROUP BY 1", "results")
def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.warning_counts(Scene(spark, sf_dir).results)


@query(_ROWS + " SELECT n_buildings, count(*) AS n_footprints FROM (SELECT footprint_id, count(*) AS n_buildings FROM r WHERE asg GROUP BY footprint_id) GROUP BY n_buildings", "results")
def buildings_per_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.buildings_per_footprint(Scene(spark, sf_dir).results)


@query(_ROWS + " SELECT building_id, round(rmse_m, 6) AS rmse_m, status FROM r WHERE rmse_m IS NOT NULL ORDER BY r.rmse_m DESC, building_id LIMIT 20", "results")
def worst_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.worst(Scene(spark, sf_dir).results, 20).select("building_id", F.round("rmse_m", 6).alias("rmse_m"), "status")


@query(_ROWS + " SELECT building_id, status FROM r WHERE rmse_m IS NULL AND status <> 'no-reference' ORDER BY status, building_id", "results")
def unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unscored(Scene(spark, sf_dir).results).select("building_id", "status")


@query("""SELECT c_custkey AS footprint_id, coalesce(max_by(o_orderstatus, o_orderkey), 'not-run') AS status, coalesce(round(max_by(o_totalprice, o_orderkey), 2), 0) AS density FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of every outline; what has none is not-run."""
    s = Scene(spark, sf_dir)
    latest = s.table("orders").groupBy(F.col("o_custkey").alias("footprint_id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.round(F.max_by("o_totalprice", "o_orderkey"), 2).alias("density"))
    return s.table("customer").select(F.col("c_custkey").alias("footprint_id")).join(latest, "footprint_id", "left").fillna({"status": "not-run", "density": 0.0})


_DIAG = """, d AS (SELECT *, CASE WHEN building_id % 4 = 0 THEN NULL ELSE CAST((building_id % 33 - 16) AS DOUBLE) / 8 END AS bias_m, CASE WHEN building_id % 4 = 0 THEN NULL ELSE 64 END AS n_cells, building_id % 9 AS n_bad, CASE WHEN building_id % 2 = 0 THEN 1.5 ELSE -1.5 END AS bad_median_m,
  CAST(building_id % 8 AS DOUBLE) / 8 AS rest_rmse_m, CASE WHEN rec THEN (a1 + a2) / 2 END AS orientation_median_deg, CASE WHEN building_id % 5 = 0 THEN 'why' END AS reason FROM r)"""


@query(_ROWS + _DIAG + """ SELECT building_id, CASE WHEN status = 'suspect-temporal' THEN 'temporal' WHEN NOT rec THEN 'Not reconstructed (`' || status || '`)' || CASE WHEN reason IS NOT NULL THEN ': ' || reason ELSE '' END || '.'
  WHEN cov < 0.9 THEN 'covers' WHEN share < 0.9 THEN 'share' WHEN rmse_m > 0 AND abs(bias_m) > 0.5 AND abs(bias_m) > 0.7 * rmse_m THEN 'The whole roof sits ' || format('{:.1f}', abs(bias_m)) || ' m ' || CASE WHEN bias_m > 0 THEN 'above' ELSE 'below' END || ' the reference.'
  WHEN orientation_median_deg > 5 THEN 'tilted' WHEN n_cells IS NULL THEN 'No single pattern; see the difference panel.' WHEN n_bad = 0 THEN 'Spread error: no cell is off by more than 1 m.' WHEN n_bad / n_cells >= 0.05 THEN 'part' ELSE 'small' END AS diagnosis FROM d""", "results")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, b = Scene(spark, sf_dir).results, F.col("building_id")
    r = r.withColumns({"bias_m": F.when(b % 4 != 0, (b % 33 - 16).cast("double") / 8), "n_cells": F.when(b % 4 != 0, 64), "n_bad": b % 9, "bad_median_m": F.when(b % 2 == 0, 1.5).otherwise(-1.5), "rest_rmse_m": (b % 8).cast("double") / 8})
    r = r.withColumns({"orientation_median_deg": F.when(F.col("status").isin("ok", "suspect-temporal"), (F.col("a1") + F.col("a2")) / 2), "reason": F.when(b % 5 == 0, "why")})
    text = evaluation.diagnosis()
    short = F.when(F.startswith(text, F.lit("The LiDAR")), "temporal").when(F.startswith(text, F.lit("The reconstruction covers")), "covers").when(F.startswith(text, F.lit("Only ")), "share")
    short = short.when(F.startswith(text, F.lit("Planes tilted")), "tilted").when(F.startswith(text, F.lit("One part")), "part").when(F.startswith(text, F.lit("Small,")), "small").otherwise(text)
    return r.select("building_id", short.alias("diagnosis"))


_BASE = "(VALUES ('vertical_rmse_m', 2.0, 0.02), ('coverage', 0.9, -0.01), ('match_rate', 0.5, -0.01), ('orientation_error_median_deg', 3.0, 0.5), ('not_measured', 1.0, 0.0), ('_comment', 1.0, 0.0), ('unset', NULL, 0.1)) AS b(metric, baseline, tolerance)"


@query(_ROWS + ", s AS (SELECT " + _sums("FROM r") + "), a AS (SELECT median(v) AS v FROM (SELECT unnest([a1, a2]) AS v FROM r WHERE rec)), m AS (SELECT 'vertical_rmse_m' AS metric, vertical_rmse_m AS value FROM s UNION ALL SELECT 'coverage', coverage FROM s UNION ALL SELECT 'match_rate', match_rate FROM s UNION ALL SELECT 'orientation_error_median_deg', v FROM a) " + f"""
  SELECT b.metric, CAST(b.baseline AS DOUBLE) AS baseline, round(m.value, 6) AS value, CAST(b.tolerance AS DOUBLE) AS tolerance, CASE WHEN m.value IS NULL THEN true WHEN b.metric IN ('vertical_rmse_m', 'orientation_error_median_deg') THEN m.value - b.baseline > b.tolerance ELSE m.value - b.baseline < -abs(b.tolerance) END AS regressed
  FROM {_BASE} LEFT JOIN m ON m.metric = b.metric WHERE b.baseline IS NOT NULL AND b.metric NOT LIKE '\\_%' ESCAPE '\\'""", "results")
def regression_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.summarise(Scene(spark, sf_dir).results)
    names = ("vertical_rmse_m", "coverage", "match_rate", "orientation_error_median_deg")
    measured = s.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))))
    base = spark.createDataFrame([("vertical_rmse_m", 2.0, 0.02), ("coverage", 0.9, -0.01), ("match_rate", 0.5, -0.01), ("orientation_error_median_deg", 3.0, 0.5), ("not_measured", 1.0, 0.0), ("_comment", 1.0, 0.0), ("unset", None, 0.1)], "metric string, baseline double, tolerance double")
    return evaluation.regressions(base, measured).withColumn("value", F.round("value", 6))


@query(_ROWS + """, one AS (SELECT *, count(*) OVER (PARTITION BY footprint_id) AS c FROM r WHERE rmse_m IS NOT NULL), mid AS (SELECT roof_type, median(rmse_m) AS m FROM one WHERE c = 1 GROUP BY roof_type)
  SELECT roof_type, building_id FROM (SELECT o.roof_type, o.building_id, row_number() OVER (PARTITION BY o.roof_type ORDER BY abs(o.rmse_m - m), o.building_id) AS rn FROM one o JOIN mid ON mid.roof_type = o.roof_type WHERE c = 1) WHERE rn = 1""", "results")
def typical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.typical(Scene(spark, sf_dir).results)


@query("SELECT building_id, round(degrees(acos(least(1, abs(cos(radians(a1)) * cos(radians(a2)) + sin(radians(a1)) * sin(radians(a2)))))), 5) AS angle FROM results", "results")
def orientation_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Scene(spark, sf_dir).results
    normal = lambda a: F.struct(F.sin(F.radians(a)).alias("nx"), F.lit(0.0).alias("ny"), F.cos(F.radians(a)).alias("nz"))
    return r.withColumn("u", normal("a1")).withColumn("v", normal("a2")).select("building_id", F.round(geo.orientation_error(F.col("u"), F.col("v")), 5).alias("angle"))


# one more pair of each building a step, until none is free
@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS building_id, CAST(l_partkey % 4 AS INT) AS i, CAST(l_suppkey % 4 AS INT) AS j, CAST(l_quantity AS BIGINT) AS angle FROM lineitem),
  g(building_id, ui, uj, angles) AS (SELECT DISTINCT building_id, CAST([] AS INT[]), CAST([] AS INT[]), CAST([] AS BIGINT[]) FROM c
    UNION ALL SELECT building_id, list_append(ui, i), list_append(uj, j), list_append(angles, angle) FROM (SELECT g.*, c.i, c.j, c.angle, row_number() OVER (PARTITION BY g.building_id ORDER BY c.angle, c.i, c.j) AS rn
      FROM g JOIN c ON c.building_id = g.building_id AND NOT list_contains(g.ui, c.i) AND NOT list_contains(g.uj, c.j)) WHERE rn = 1)
  SELECT building_id, CAST(len(angles) AS INT) AS n_pairs, array_to_string(list_transform(angles, lambda x: CAST(x AS VARCHAR)), ',') AS angles FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY len(angles) DESC) AS rn FROM g) WHERE rn = 1""")
def orientation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching of planes, smallest angle first. (Pairs of overlaid planes are matched in evaluated_buildings.)"""
    l = Scene(spark, sf_dir).table("lineitem")
    c = l.select(F.col("l_orderkey").alias("building_id"), (F.col("l_partkey") % 4).cast("int").alias("i"), (F.col("l_suppkey") % 4).cast("int").alias("j"), F.col("l_quantity").cast("double").alias("angle"))
    angles = F.col("orientation_errors_deg")
    return evaluation.orientation_pairs(c).select("building_id", F.size(angles).alias("n_pairs"), F.array_join(angles.cast("array<bigint>").cast("array<string>"), ",").alias("angles"))


@query("SELECT building_id, round(least(n_pred_faces, n_ref_faces) / CAST(greatest(n_pred_faces, n_ref_faces) AS DOUBLE), 6) AS agreement FROM results", "results")
def face_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scene(spark, sf_dir).results.select("building_id", F.round(geo.face_count_agreement(F.col("n_pred_faces"), F.col("n_ref_faces")), 6).alias("agreement"))


@query(f"SELECT building_id, {_SIZE} AS size_bin, CASE WHEN point_density IS NULL THEN NULL ELSE {_DENSITY} END AS density_bin FROM results", "results")
def result_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scene(spark, sf_dir).results.select("building_id", geo.size_bin(F.col("outline_area_m2")).alias("size_bin"), geo.density_bin(F.col("point_density")).alias("density_bin"))


@query("SELECT building_id, building_id LIKE 'Groupe%' AS is_grouped, CASE WHEN building_id LIKE 'Groupe%' THEN 'T' || CAST(home % 4 AS VARCHAR) || ':' || building_id ELSE building_id END AS qualified FROM buildings", "buildings")
def grouped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Scene(spark, sf_dir).sql("buildings")
    return b.select("building_id", geo.is_grouped(F.col("building_id")).alias("is_grouped"), geo.qualify_grouped(F.col("building_id"), F.concat(F.lit("T"), (F.col("home") % 4).cast("string"))).alias("qualified"))


@query("SELECT doc_id, sha256(text) AS digest, length(text) AS size FROM documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scene(spark, sf_dir).table("documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("bigint").alias("size"))


_FACES = "faces AS (SELECT CAST(l_orderkey AS BIGINT) AS solid, l_linenumber % 3 AS face, l_linenumber + l_partkey % 3 AS a, l_linenumber + 1 + l_suppkey % 3 AS b FROM lineitem)"


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = Scene(spark, sf_dir).table("lineitem")
    return l.select(F.col("l_orderkey").cast("bigint").alias("solid"), (F.col("l_linenumber") + F.col("l_partkey") % 3).alias("a"), (F.col("l_linenumber") + 1 + F.col("l_suppkey") % 3).alias("b"))


@query("WITH " + _FACES + " SELECT solid, bool_and(n = 2) AS watertight FROM (SELECT solid, least(a, b) AS u, greatest(a, b) AS v, count(*) AS n FROM faces GROUP BY 1, 2, 3) GROUP BY solid")
def watertight_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solids.watertight(_faces(spark, sf_dir), "solid")


@query("WITH " + _FACES + ", d AS (SELECT solid, a, b, count(*) AS n FROM faces GROUP BY 1, 2, 3) SELECT x.solid, bool_and(x.n = 1 AND y.n IS NOT NULL) AS oriented FROM d x LEFT JOIN d y ON y.solid = x.solid AND y.a = x.b AND y.b = x.a GROUP BY x.solid")
def oriented_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solids.oriented(_faces(spark, sf_dir), "solid")


@query("SELECT sqrt(avg((l_discount - l_tax) ** 2)) AS rmse, CAST(1.0 AS DOUBLE) AS coverage FROM lineitem")
def rmse_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = Scene(spark, sf_dir).table("lineitem")
    return l.agg(F.round(evaluation.vertical_rmse(F.col("l_discount"), F.col("l_tax")), 9).alias("rmse"), evaluation.coverage(F.col("l_discount"), F.col("l_tax")).alias("coverage"))


ORACLE_SQL["rmse_and_coverage"] = ORACLE_SQL["rmse_and_coverage"].replace("sqrt(avg((l_discount - l_tax) ** 2))", "round(sqrt(avg((l_discount - l_tax) ** 2)), 9)")
