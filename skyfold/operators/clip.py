"""Roof points of outlines, their aggregates, and the assignment of buildings to outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import geo, overlay, shapes
from skyfold.operators import evaluation, spatial

# What becomes of a point of each class.
POLICY = {1: "keep_if_elevated", 2: "drop", 3: "drop", 4: "drop", 5: "drop", 6: "keep", 7: "drop", 8: "drop", 28: "keep_if_elevated"}
GROUND, NEIGHBOURS = 2, 8
#: Classes that any step uses: what is not dropped, and ground.
USED = tuple(sorted({c for c, p in POLICY.items() if p != "drop"} | {GROUND}))


def policy(cls: Column) -> Column:
    """What becomes of a point; an unknown class is an error."""
    out = F.when(F.lit(False), "")
    for c, p in POLICY.items():
        out = out.when(cls == c, p)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown class "), cls.cast("string"))))


def clip(points: DataFrame, footprints: DataFrame, bin_size: float, margin: float, height: float, k: int = NEIGHBOURS) -> DataFrame:
    """Roof points (fid, pid, x, y, z, cls) of each outline (fid, edges): those kept by class, and those
    that may be if they stand more than ``height`` over the median of the k nearest ground points
    within ``margin`` of the outline. Without ground near by, these are dropped. A point of an
    unknown class is an error.

    Points meet outlines once, by bins and bounds. They are dealt by outline without its edges,
    which the kernel gets once; an outline's points are bounded by what lies on its ground.
    """
    used = points.withColumn("policy", policy(F.col("cls"))).where((F.col("policy") != "drop") | (F.col("cls") == GROUND)).drop("policy")
    near = spatial.near_bounds(used.select("pid", "x", "y", "z", "cls"), footprints.select("fid", "edges"), bin_size, margin).drop("edges")
    columns = ["fid", "pid", "x", "y", "z", "cls"]
    kept = [c for c, p in POLICY.items() if p == "keep"]

    def run(shape: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(shape) or not len(rows):
            return rows[columns].iloc[:0]
        edges = overlay.edge_array(shape["edges"].iloc[0])
        edges, origin = edges - np.tile(edges[0, :2], 2), edges[0, :2]
        rows = rows.sort_values("pid", kind="stable")
        xy = rows[["x", "y"]].to_numpy(float) - origin
        held, cls, z = shapes.inside(edges, *xy.T), rows["cls"].to_numpy(), rows["z"].to_numpy()
        take = held & np.isin(cls, kept)
        raised = np.flatnonzero(held & ~take & (cls != GROUND))
        ground = np.flatnonzero(cls == GROUND)
        ground = ground[held[ground] | (shapes.boundary_distance(edges, *xy[ground].T) < margin)]
        if len(raised) and len(ground):
            take[raised] = z[raised] - shapes.nearest_median(xy[raised], xy[ground], z[ground], k) > height
        return rows.loc[take, columns]

    types = {f.name: f.dataType.simpleString() for f in near.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in columns)
    fresh = footprints.select(*(F.col(c).alias(c) for c in ("fid", "edges")))  # columns of its own, so that both sides can come of one table
    return fresh.groupBy("fid").cogroup(near.select(*columns).groupBy("fid")).applyInPandas(run, schema)


def floor_height(z: str, cls: str) -> Column:
    """Aggregate: the 5th percentile of ground, else the lowest point."""
    return F.coalesce(F.percentile(F.when(F.col(cls) == GROUND, F.col(z)), 0.05), F.min(z))


def dedup_footprints(rows: DataFrame) -> DataFrame:
    """The first row of each footprint_id by ordinal; lidar_derived if any row is."""
    kept = [c for c in rows.columns if c not in ("footprint_id", "lidar_derived")]
    out = rows.groupBy("footprint_id").agg(F.bool_or("lidar_derived").alias("lidar_derived"), F.min_by(F.struct(*kept), "ordinal").alias("r"))
    return out.select("footprint_id", "lidar_derived", "r.*")


def roof_summary(faces: DataFrame, key: str, steep: float = 15.0) -> DataFrame:
    """Roof area, mean slope, steep fraction and type from faces with area_m2 and slope_deg."""
    area = F.sum("area_m2")
    fraction = F.coalesce(F.try_divide(F.sum(F.when(F.col("slope_deg") >= steep, F.col("area_m2")).otherwise(0.0)), area), F.lit(0.0))
    out = faces.groupBy(key).agg(area.alias("roof_area_m2"), F.coalesce(F.try_divide(F.sum(F.col("slope_deg") * F.col("area_m2")), area), F.lit(0.0)).alias("mean_slope_deg"), fraction.alias("steep_fraction"))
    return out.withColumn("roof_type", geo.roof_type(F.col("steep_fraction")))


def overlaps(a: DataFrame, b: DataFrame, bin_size: float) -> DataFrame:
    """(a.*, b.*, common, area_a, area_b) of shapes (edges_a, edges_b) whose bounds meet; areas by exact overlay."""
    left = spatial.bin_explode(spatial.with_bounds(a, "edges_a"), bin_size).withColumnsRenamed({c: f"{c}_a" for c in ("xmin", "ymin", "xmax", "ymax")})
    right = spatial.bin_explode(spatial.with_bounds(b, "edges_b"), bin_size)
    met = left.join(right, ["bx", "by"]).where("xmin <= xmax_a and xmax >= xmin_a and ymin <= ymax_a and ymax >= ymin_a")
    # shapes that share several bins meet in the first of these
    first = (F.col("bx") == F.floor(F.greatest("xmin", "xmin_a") / bin_size)) & (F.col("by") == F.floor(F.greatest("ymin", "ymin_a") / bin_size))
    met = met.where(first).drop("bx", "by", "xmin", "ymin", "xmax", "ymax", "xmin_a", "ymin_a", "xmax_a", "ymax_a")

    @F.pandas_udf("struct<common:double,area_a:double,area_b:double>")
    def areas(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in pairs:
            yield pd.DataFrame([overlay.areas(overlay.edge_array(p), overlay.edge_array(q)) for p, q in zip(x, y, strict=True)], columns=["common", "area_a", "area_b"])

    return met.withColumn("_o", areas("edges_a", "edges_b")).select("*", "_o.*").drop("_o", "edges_a", "edges_b")


def assign(footprints: DataFrame, buildings: DataFrame, bin_size: float, least: float = 0.5, name: str = "fid") -> DataFrame:
    """(building_id, name, share): the outline that holds most of each building; none under ``least``, none of no area."""
    met = overlaps(footprints.withColumnRenamed("edges", "edges_a"), buildings.withColumnRenamed("edges", "edges_b"), bin_size)
    met = met.where("area_b > 0").withColumn("share", F.col("common") / F.col("area_b"))
    return evaluation.best_share(met, "building_id", name, least)


def quantise(points: DataFrame) -> DataFrame:
    """pid and 16-bit places qx, qy of points in millimetres, on the coarsest scale needed, of at least a millimetre."""
    box = points.agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy"))
    scale = F.greatest(F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly")) / 1000.0 / 65000, F.lit(0.001))
    box = box.select("lx", "ly", scale.alias("scale"))
    q = lambda c, o: F.rint((F.col(c) - F.col(o)) / 1000.0 / F.col("scale")).cast("bigint")
    ok = lambda c: F.when(c.between(0, 65535), c).otherwise(F.raise_error(F.lit("outside the scale")).cast("bigint"))
    return points.crossJoin(F.broadcast(box)).select("pid", ok(q("x", "lx")).alias("qx"), ok(q("y", "ly")).alias("qy"))
