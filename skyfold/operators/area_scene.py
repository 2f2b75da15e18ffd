"""What a viewer shows of an area: sampled points, triangles of both models, and the outlines' results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import extrude

# Points shown of a class at most, and how far beneath and above the roofs points are shown.
QUOTAS, BELOW_M, ABOVE_M = {6: 200_000, 2: 50_000, 1: 50_000}, 20.0, 40.0


def sample(points: DataFrame, quotas: dict[int, int], key: Column | None = None) -> DataFrame:
    """Of each class the points of the least keys, up to its quota. The largest quota limits the rank in every task
    before the shuffle; this is a report's sample."""
    key = F.xxhash64(*points.columns) if key is None else key
    quota = F.coalesce(*(F.when(F.col("cls") == c, n) for c, n in quotas.items()), F.lit(0))
    ranked = points.withColumn("_n", F.row_number().over(Window.partitionBy("cls").orderBy(key)))
    return ranked.where(F.col("_n") <= max(quotas.values())).where(F.col("_n") <= quota).drop("_n")


def without_outliers(points: DataFrame, roofs: DataFrame) -> DataFrame:
    """Points from BELOW_M under the lowest to ABOVE_M over the highest roof corner (ring of x, y, z)."""
    z = roofs.select(F.explode("ring").alias("p")).agg(F.min("p.z").alias("low"), F.max("p.z").alias("high"))
    return points.crossJoin(F.broadcast(z)).where((F.col("z") >= F.col("low") - BELOW_M) & (F.col("z") <= F.col("high") + ABOVE_M)).drop("low", "high")


def triangles(shapes: DataFrame, key: str) -> DataFrame:
    """(key, x, y, z), three rows a triangle in order, of polygons (key, rings of x, y, z)."""
    kind = shapes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rings in zip(batch[key], batch["rings"], strict=True):
                rings = [np.array([(p["x"], p["y"], p["z"]) for p in r["p"]], float) for r in rings]
                rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
                if len(rings[0]) >= 3:
                    corners = np.vstack(rings)[extrude.triangulate(rings).ravel()]
                    yield pd.DataFrame({key: [name] * len(corners), "x": corners[:, 0], "y": corners[:, 1], "z": corners[:, 2]})

    return shapes.select(key, geo.wrapped(F.col("rings")).alias("rings")).mapInPandas(run, f"{key} {kind}, x double, y double, z double")


def raised(faces: DataFrame) -> DataFrame:
    """Faces (footprint_id, nx, ny, nz, d, rings of x, y) with the heights of their corners."""
    z = lambda p: (F.col("d") - F.col("nx") * p.x - F.col("ny") * p.y) / F.col("nz")
    return faces.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), z(p).alias("z")))))


def listed(footprints: DataFrame, reconstructions: DataFrame, results: DataFrame) -> DataFrame:
    """The reconstructed outlines in order, each with its pooled RMSE and its reference buildings' results."""
    scored = results.where("status <> 'no-reference' and footprint_id is not null").groupBy("footprint_id").agg(
        F.sqrt(F.try_divide(F.sum("sum_sq_m2"), F.sum("n_valid_cells"))).alias("rmse_m"),
        F.array_sort(F.collect_list(F.struct("building_id", "status", "rmse_m", "coverage", "share"))).alias("buildings"),
    )
    rows = footprints.select("footprint_id", "lidar_derived").join(reconstructions.select("footprint_id", "status", "n_points", "n_planes", "n_faces", "volume_m3", "reason", "warnings"), "footprint_id").join(scored, "footprint_id", "left")
    return rows.withColumn("buildings", F.coalesce("buildings", F.array().cast(scored.schema["buildings"].dataType))).orderBy("footprint_id")
