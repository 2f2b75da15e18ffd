"""Planes and label grids as relations: what of plane detection needs no kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions import geo


def moments(points: DataFrame, key: str) -> DataFrame:
    """Count, mean and scatter of each group's points: what a total least squares plane needs, by one partial aggregate."""
    c = F.covar_pop
    return points.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"),
        c("x", "x").alias("xx"), c("x", "y").alias("xy"), c("y", "y").alias("yy"), c("x", "z").alias("xz"), c("y", "z").alias("yz"), c("z", "z").alias("zz"),
    )


def fit(points: DataFrame, key: str) -> DataFrame:
    """(key, nx, ny, nz, d, n): the total least squares plane of each group of three points or more, normal up."""
    kind = points.schema[key].dataType.simpleString()

    def solve(batches):
        for m in batches:
            m = m[m.n >= 3]
            scatter = np.stack([m.xx, m.xy, m.xz, m.xy, m.yy, m.yz, m.xz, m.yz, m.zz], axis=1).reshape(-1, 3, 3)
            normal = np.linalg.eigh(scatter)[1][:, :, 0] if len(m) else np.empty((0, 3))
            normal = np.where(normal[:, 2:] < 0, -normal, normal)
            d = (normal * m[["mx", "my", "mz"]].to_numpy(float)).sum(axis=1)
            yield pd.DataFrame({key: m[key], "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "d": d, "n": m.n})

    return moments(points, key).mapInPandas(solve, f"{key} {kind}, nx double, ny double, nz double, d double, n bigint")


def nearest_plane(distances: DataFrame, key: list[str], most: float) -> DataFrame:
    """The plane k nearest to each point, of those up to ``most`` away; ties to the lower k."""
    near = distances.where(F.col("dist") <= most)
    return near.groupBy(*key).agg(F.min_by("k", F.struct(F.round("dist", 9), "k")).alias("k"))


def adjacency(owned: DataFrame, key: str, reach: float, least: int) -> DataFrame:
    """Planes a < b of which at least ``least`` points of b lie within ``reach`` of one of a in plan; points meet in bins of that size."""
    at = owned.withColumn("bx", F.floor(F.col("x") / reach)).withColumn("by", F.floor(F.col("y") / reach))
    around = at.select(key, F.col("k").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(F.col("bx") - 1, F.col("bx") + 1)).alias("bx"), "by")
    around = around.withColumn("by", F.explode(F.sequence(F.col("by") - 1, F.col("by") + 1)))
    met = around.join(at, [key, "bx", "by"]).where("a < k").where((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= reach * reach)
    return met.groupBy(key, "a", F.col("k").alias("b")).agg(F.countDistinct("pid").alias("n")).where(F.col("n") >= least)


def label_cells(cells: DataFrame, planes: DataFrame, key: list[str]) -> DataFrame:
    """The plane whose height at each cell is nearest to the cell's; ties to the lower. planes: a fixed, small table."""
    misfit = F.abs(F.col("z") - geo.plane_height(F.col("plane"), F.col("x"), F.col("y")))
    return cells.crossJoin(planes).groupBy(*key).agg(F.min_by("k", F.struct(F.round(misfit, 9), "k")).alias("label"))


def majority(labels: DataFrame, key: str) -> DataFrame:
    """The commonest label among a cell and its neighbours; where its own is one of these, the cell keeps it."""
    votes = labels.select(key, F.col("label"), F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    votes = votes.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).groupBy(key, "cx", "cy", "label").agg(F.count("*").alias("n"))
    best = votes.join(labels.withColumnRenamed("label", "own"), [key, "cx", "cy"])
    order = Window.partitionBy(key, "cx", "cy").orderBy(F.desc("n"), F.desc(F.col("label") == F.col("own")), "label")
    return best.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(key, "cx", "cy", "label")
