"""Scores of reference buildings, their aggregates and their reports' tables.

Rows of results have the columns of ``skyfold.schemas.BUILDING_RESULTS``. What is not
defined is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions import geo

# Statuses, thresholds and the bins of the breakdown.
UNASSIGNED = ("no-match", "grouped-reference", "no-reference")
RECONSTRUCTED = ("ok", "suspect-temporal")
TEMPORAL_M, BAD_CELL_M, NO_BIN = 1.5, 1.0, "n/a"
GROUPS = ("all buildings", "independent footprints", "LiDAR-derived footprints")
AXES = {
    "roof type": ("flat", "mixed", "pitched"),
    "size (m²)": ("<100", "100-250", "250-1000", ">=1000"),
    "point density (pts/m²)": ("<5", "5-10", "10-20", ">=20", NO_BIN),
}
VARIANTS = ("raw", "excluding suspect-temporal")
COLUMNS = (
    "n_buildings", "n_assigned", "buildings_reconstructed", "vertical_rmse_m", "median_building_rmse_m", "coverage",
    "orientation_error_median_deg", "orientation_error_p90_deg", "face_count_agreement", "match_rate",
)
LOWER_IS_BETTER = ("vertical_rmse_m", "median_building_rmse_m", "orientation_error_median_deg", "orientation_error_p90_deg")


def temporal_status(status: Column, offset: Column) -> Column:
    """ok becomes suspect-temporal where the points are far from the reference; nothing else changes."""
    return F.when((status == "ok") & (F.abs(offset) > TEMPORAL_M), F.lit("suspect-temporal")).otherwise(status)


def score_cells(cells: DataFrame, key: list[str], unit: float = 1.0) -> DataFrame:
    """Scores of cells with z_ref, z_pred and z_lidar (each null where undefined), given in so many parts of a
    metre: sums are taken in that unit and divided once."""
    both = F.col("z_ref").isNotNull() & F.col("z_pred").isNotNull()
    error = F.when(both, F.col("z_pred") - F.col("z_ref"))
    bad = F.abs(error) > BAD_CELL_M * unit
    out = cells.groupBy(*key).agg(
        F.count("z_ref").alias("n_ref_cells"),
        F.count_if(both).alias("n_valid_cells"),
        (F.coalesce(F.sum(error * error), F.lit(0.0)) / (unit * unit)).alias("sum_sq_m2"),
        (F.median(F.col("z_lidar") - F.col("z_ref")) / unit).alias("temporal_offset_m"),
        (F.median(error) / unit).alias("bias_m"),
        F.nullif(F.count_if(both), F.lit(0)).alias("n_cells"),
        F.when(F.count_if(both) > 0, F.count_if(bad)).alias("n_bad"),
        (F.median(F.when(bad, error)) / unit).alias("bad_median_m"),
        (F.sqrt(F.avg(F.when(~bad, error * error))) / unit).alias("rest_rmse_m"),
    )
    return out.withColumn("rmse_m", F.sqrt(F.try_divide("sum_sq_m2", "n_valid_cells"))).withColumn("coverage", F.try_divide("n_valid_cells", "n_ref_cells"))


def vertical_rmse(predicted: Column, reference: Column) -> Column:
    """Aggregate: RMSE where both are defined; an error if nowhere."""
    value = F.sqrt(F.avg(F.pow(predicted - reference, F.lit(2))))
    return F.coalesce(value, F.raise_error(F.lit("no common cell")).cast("double"))


def coverage(predicted: Column, reference: Column) -> Column:
    """Aggregate: the share of reference cells that have a prediction; 0 without any."""
    return F.coalesce(F.try_divide(F.count_if(predicted.isNotNull() & reference.isNotNull()), F.count(reference)), F.lit(0.0))


def best_share(pairs: DataFrame, building: str = "building_id", footprint: str = "footprint_id", least: float = 0.5) -> DataFrame:
    """The footprint with the largest share of each building; of shares within 1e-9 the lower id; under ``least`` none."""
    by_share = Window.partitionBy(building)
    near = pairs.withColumn("_top", F.max("share").over(by_share)).where(F.col("share") >= F.col("_top") - 1e-9)
    best = near.groupBy(building).agg(F.min_by(F.struct(F.col(footprint).alias("f"), F.col("share").alias("s")), F.col(footprint)).alias("b"))
    return best.where(F.col("b.s") >= least).select(building, F.col("b.f").alias(footprint), F.least(F.lit(1.0), "b.s").alias("share"))


def orientation_pairs(candidates: DataFrame, building: str = "building_id") -> DataFrame:
    """Greedy one-to-one matching of (i, j, angle) within a building: the smallest angle first, then i, then j.

    Each building's candidates are folded in that order in one expression, which holds what is used so far.
    """
    listed = candidates.groupBy(building).agg(F.array_sort(F.collect_list(F.struct("angle", "i", "j"))).alias("c"))
    start = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("j"), F.array().cast("array<double>").alias("angles"))
    free = lambda a, x: ~F.array_contains(a.i, x.i) & ~F.array_contains(a.j, x.j)

    def step(a: Column, x: Column) -> Column:
        grow = lambda old, new: F.when(free(a, x), F.concat(old, F.array(new))).otherwise(old)
        return F.struct(grow(a.i, x.i).alias("i"), grow(a.j, x.j).alias("j"), grow(a.angles, x.angle).alias("angles"))

    return listed.select(building, F.aggregate("c", start, step).alias("m")).select(building, F.col("m.angles").alias("orientation_errors_deg"))


def _flags(rows: DataFrame) -> DataFrame:
    status = F.col("status")
    assigned = ~status.isin(*UNASSIGNED)
    return rows.withColumns({"_ref": status != "no-reference", "_cand": ~status.isin("no-reference", "grouped-reference"), "_asg": assigned, "_rec": status.isin(*RECONSTRUCTED)})


def _measures() -> list[Column]:
    only = lambda flag, name: F.when(F.col(flag), F.col(name))
    valid = F.sum(only("_asg", "n_valid_cells"))
    return [
        F.count_if("_ref").alias("n_buildings"),
        F.count_if("_asg").alias("n_assigned"),
        F.count_if("_rec").alias("buildings_reconstructed"),
        F.sqrt(F.try_divide(F.sum(only("_asg", "sum_sq_m2")), valid)).alias("vertical_rmse_m"),
        F.median(only("_asg", "rmse_m")).alias("median_building_rmse_m"),
        F.try_divide(valid, F.sum(only("_asg", "n_ref_cells"))).alias("coverage"),
        F.avg(only("_rec", "face_count_agreement")).alias("face_count_agreement"),
        F.try_divide(F.count_if("_asg"), F.count_if("_cand")).alias("match_rate"),
        (F.count_if("_ref") - F.count_if("_cand")).alias("n_grouped"),
        F.count_if(~F.col("_ref")).alias("n_no_reference"),
        *(F.coalesce(F.sum(only("_rec", c)), F.lit(0)).alias(n) for c, n in (("n_unmatched_pred", "n_unmatched_pred_planes"), ("n_unmatched_ref", "n_unmatched_ref_planes"), ("n_pred_faces", "n_pred_faces"), ("n_ref_faces", "n_ref_faces"))),
        *(F.percentile(only("_asg", "share"), q).alias(n) for q, n in ((0.0, "share_p0"), (0.1, "share_p10"), (0.5, "share_p50"))),
    ]


def summarise(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Headline metrics of all rows, or of each group of ``by``. Angles are pooled over the
    buildings by a second aggregate, so no list of them is ever gathered."""
    by = by or []
    rows = _flags(rows)
    main = rows.groupBy(*by).agg(*_measures())
    angles = rows.where("_rec").select(*by, F.explode("orientation_errors_deg").alias("_a")).groupBy(*by).agg(
        F.percentile("_a", 0.5).alias("orientation_error_median_deg"), F.percentile("_a", 0.9).alias("orientation_error_p90_deg"), F.count("*").alias("n_plane_pairs")
    )
    out = main.join(angles, by, "left") if by else main.crossJoin(angles)
    return out.withColumn("n_plane_pairs", F.coalesce("n_plane_pairs", F.lit(0)))


def memberships(rows: DataFrame) -> DataFrame:
    """A row for each (variant, axis, bin) to which a result belongs; groups overlap, so this is no rollup."""
    m = lambda axis, value: F.struct(F.lit(axis).alias("axis"), value.alias("bin"))
    axes = list(AXES)
    size = F.when(F.col("status") == "no-reference", NO_BIN).otherwise(geo.size_bin(F.col("outline_area_m2")))
    listed = F.array(
        m("overall", F.lit(GROUPS[0])),
        m("overall", F.when(~F.col("lidar_derived"), GROUPS[1]).when(F.col("lidar_derived"), GROUPS[2])),
        m(axes[0], F.coalesce("roof_type", F.lit(NO_BIN))),
        m(axes[1], size),
        m(axes[2], F.coalesce(geo.density_bin(F.col("point_density")), F.lit(NO_BIN))),
    )
    variants = F.when(F.col("status") == "suspect-temporal", F.array(F.lit(VARIANTS[0]))).otherwise(F.array(*map(F.lit, VARIANTS)))
    return rows.withColumn("variant", F.explode(variants)).select("*", F.inline(listed)).where("bin is not null")


def breakdown(rows: DataFrame) -> DataFrame:
    """The metrics of every variant, axis and bin, the empty ones too."""
    spark = rows.sparkSession
    table = [(v, a, b) for v in VARIANTS for a, bins in {"overall": GROUPS, **AXES}.items() for b in bins]
    cells = spark.createDataFrame(table, "variant string, axis string, bin string")
    found = summarise(memberships(rows), ["variant", "axis", "bin"]).select("variant", "axis", "bin", *COLUMNS)
    out = cells.join(found, ["variant", "axis", "bin"], "left")
    return out.fillna(0, ["n_buildings", "n_assigned", "buildings_reconstructed"])


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def warning_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def buildings_per_footprint(rows: DataFrame) -> DataFrame:
    each = rows.where(~F.col("status").isin(*UNASSIGNED)).groupBy("footprint_id").agg(F.count("*").alias("n_buildings"))
    return each.groupBy("n_buildings").agg(F.count("*").alias("n_footprints"))


def worst(rows: DataFrame, n: int) -> DataFrame:
    """The n results of the largest RMSE; ties by id."""
    return rows.where("rmse_m is not null").orderBy(F.desc("rmse_m"), "building_id").limit(n)


def unscored(rows: DataFrame) -> DataFrame:
    return rows.where("rmse_m is null and status <> 'no-reference'").orderBy("status", "building_id")


def no_reference(footprints: DataFrame, rows: DataFrame) -> DataFrame:
    """Footprints that no result uses."""
    return footprints.join(rows.where("footprint_id is not null").select("footprint_id").distinct(), "footprint_id", "left_anti")


# The sentences of the report, by the rules' order; {} is a number or a name.
SENTENCES = {
    "changed": "The LiDAR is {} m from the reference: probably changed between 2015 and 2016.",
    "failed": "Not reconstructed (`{}`){}.",
    "coverage": "The reconstruction covers only {}% of the reference roof.",
    "share": "Only {}% of the reference roof lies in the footprint; the rest is scored against nothing.",
    "bias": "The whole roof sits {} m {} the reference.",
    "tilt": "Planes tilted: median orientation error {}°.",
    "none": "No single pattern; see the difference panel.",
    "spread": "Spread error: no cell is off by more than 1 m.",
    "part": "{}: {}% of cells by more than 1 m, mostly {}; the rest within {} m RMSE.",
}


def _say(rule: str, *values) -> Column:
    """A sentence with its gaps filled."""
    pieces = SENTENCES[rule].split("{}")
    told = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        told += [value, F.lit(piece)]
    return F.concat(*told)


def diagnosis() -> Column:
    """One line on each result, by the first rule that holds. Needs bias_m, and of the cells off by
    more than BAD_CELL_M n_cells, n_bad, bad_median_m, and the RMSE of the rest rest_rmse_m; null without cells."""
    c = F.col
    percent = lambda x: F.bround(x * 100, 0).cast("int").cast("string")
    number = lambda x, digits, form="%": F.format_string(f"{form}.{digits}f", F.bround(x, digits))
    choose = lambda test, yes, no: F.when(test, yes).otherwise(no)
    why = choose(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(": "), c("reason")), "")
    spread = c("n_bad") / c("n_cells")
    rules = [
        ((c("status") == "suspect-temporal") & c("temporal_offset_m").isNotNull(), _say("changed", number(c("temporal_offset_m"), 1, "%+"))),
        (~c("status").isin(*RECONSTRUCTED), _say("failed", c("status"), why)),
        (c("coverage") < 0.9, _say("coverage", percent(c("coverage")))),
        (c("share") < 0.9, _say("share", percent(c("share")))),
        ((c("rmse_m") > 0) & (F.abs("bias_m") > 0.5) & (F.abs("bias_m") > 0.7 * c("rmse_m")), _say("bias", number(F.abs("bias_m"), 1), choose(c("bias_m") > 0, "above", "below"))),
        (c("orientation_median_deg") > 5.0, _say("tilt", number(c("orientation_median_deg"), 1))),
        (c("n_cells").isNull(), _say("none")),
        (c("n_bad") == 0, _say("spread")),
    ]
    last = _say("part", choose(spread >= 0.05, "One part of the roof is off", "Small, isolated errors"), percent(spread), choose(c("bad_median_m") > 0, "too high", "too low"), number(F.coalesce("rest_rmse_m", F.lit(0.0)), 2))
    return F.coalesce(*(F.when(test, text) for test, text in rules), last)


def regressions(baseline: DataFrame, measured: DataFrame) -> DataFrame:
    """(metric, baseline, value, tolerance, regressed) of gated metrics: worse than the tolerance in the
    metric's own direction, or not produced. Names that begin with _ are comments."""
    met = baseline.where("baseline is not null and tolerance is not null and not startswith(metric, '_')").join(measured, "metric", "left")
    change = F.col("value") - F.col("baseline")
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), change > F.col("tolerance") + 1e-12).otherwise(change < -F.abs("tolerance") - 1e-12)
    return met.select("metric", "baseline", "value", "tolerance", F.coalesce(worse, F.lit(True)).alias("regressed"))


def baseline_is_set(baseline: DataFrame) -> DataFrame:
    return baseline.agg(F.coalesce(F.bool_or(F.col("baseline").isNotNull()), F.lit(False)).alias("gating"))


def typical(rows: DataFrame) -> DataFrame:
    """The building nearest to the median RMSE of its roof type, among footprints with one building."""
    alone = rows.where("rmse_m is not null").withColumn("_n", F.count("*").over(Window.partitionBy("footprint_id"))).where("_n = 1")
    mid = alone.groupBy("roof_type").agg(F.median("rmse_m").alias("_m"))
    near = alone.join(mid, "roof_type").withColumn("_d", F.abs(F.col("rmse_m") - F.col("_m")))
    return near.groupBy("roof_type").agg(F.min_by("building_id", F.struct("_d", "building_id")).alias("building_id"))
