"""Spatial joins as equi-joins on grid bins, with an exact test after.

Catalyst plans a range condition as a nested-loop join. Shapes are therefore spread over
the bins that their bounds touch, points get the bin that they are in, and the two meet
by equality, which a shuffle, a broadcast or a skew split can all serve. A bin holds at
most what lies on its ground, so a hot shape is spread over many keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import geo, shapes


def with_bounds(shapes: DataFrame, edges: str = "edges") -> DataFrame:
    """Adds xmin, ymin, xmax, ymax of the edges."""
    xs = F.concat(F.transform(edges, lambda e: e.x1), F.transform(edges, lambda e: e.x2))
    ys = F.concat(F.transform(edges, lambda e: e.y1), F.transform(edges, lambda e: e.y2))
    return shapes.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def bins(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def bin_explode(shapes: DataFrame, size: float, margin: float = 0) -> DataFrame:
    """A row for each bin (bx, by) that a shape's bounds and margin touch."""
    out = shapes.withColumn("bx", F.explode(bins(F.col("xmin") - margin, F.col("xmax") + margin, size)))
    return out.withColumn("by", F.explode(bins(F.col("ymin") - margin, F.col("ymax") + margin, size)))


def bin_points(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))


def near_bounds(points: DataFrame, shapes: DataFrame, size: float, margin: float = 0) -> DataFrame:
    """Every point with every shape whose bounds and margin hold it."""
    spread = bin_explode(with_bounds(shapes), size, margin)
    met = bin_points(points, size).join(spread, ["bx", "by"])
    x, y = F.col("x"), F.col("y")
    met = met.where(x.between(F.col("xmin") - margin, F.col("xmax") + margin) & y.between(F.col("ymin") - margin, F.col("ymax") + margin))
    return met.drop("bx", "by", "xmin", "ymin", "xmax", "ymax")


def points_in_shapes(points: DataFrame, shapes: DataFrame, size: float, margin: float = 0, closed: bool = True) -> DataFrame:
    """Every point with every shape that holds it, or lies nearer to it than margin."""
    x, y = F.col("x"), F.col("y")
    test = geo.within(F.col("edges"), x, y, margin) if margin else (geo.intersects if closed else geo.contains)(F.col("edges"), x, y)
    return near_bounds(points, shapes, size, margin).where(test)


def window_query(points: DataFrame, windows: DataFrame, size: float) -> DataFrame:
    """Points within each window (xmin, ymin, xmax, ymax), bounds included."""
    met = bin_points(points, size).join(bin_explode(windows, size), ["bx", "by"])
    return met.where(F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))).drop("bx", "by")


def nearest_median(queries: DataFrame, targets: DataFrame, group: str, k: int, query_id: str = "pid", target_id: str = "pid", value: str = "z") -> DataFrame:
    """(group, query id, ground): the median value of the k targets of the group nearest in plan; ties by id.

    Groups are footprints, bounded by what lies on their ground. Within one, targets are filed in
    cells and each query looks at those around it, so the work grows with the points, not their pairs.
    """
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    names = [group, query_id, "ground"]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({c: q[c].iloc[:0] if c != "ground" else np.empty(0) for c in names})
        t = t.sort_values(target_id, kind="stable")
        a, b = (f[["x", "y"]].to_numpy(float) for f in (q, t))
        got = shapes.nearest_median(a - b[0], b - b[0], t[value].to_numpy(float), k)
        return pd.DataFrame({group: q[group], query_id: q[query_id], "ground": got})

    met = queries.select(group, query_id, "x", "y").groupBy(group).cogroup(targets.select(*(F.col(c).alias(c) for c in (group, target_id, "x", "y", value))).groupBy(group))
    return met.applyInPandas(run, f"{group} {kinds[group]}, {query_id} {kinds[query_id]}, ground double")


def cells_of(shapes: DataFrame, cell: float, erode: float) -> DataFrame:
    """Cells (cx, cy) of a global grid whose centre lies in the shape and further than ``erode`` from its edge."""
    spread = bin_explode(with_bounds(shapes), cell).withColumnsRenamed({"bx": "cx", "by": "cy"})
    half = cell / 2 if cell % 2 else int(cell // 2)
    step = int(cell) if float(cell).is_integer() else cell
    spread = spread.withColumn("x", F.col("cx") * step + half).withColumn("y", F.col("cy") * step + half)
    keep = geo.contains(F.col("edges"), F.col("x"), F.col("y"))
    if erode:
        keep &= geo.boundary_distance(F.col("edges"), F.col("x"), F.col("y")) > erode
    return spread.where(keep).drop("xmin", "ymin", "xmax", "ymax", "edges")


def surface(cells: DataFrame, faces: DataFrame, key: list[str], size: float, name: str) -> DataFrame:
    """The height of the highest face (edges, plane) of the same key over each cell; null where there is none."""
    spread = bin_explode(with_bounds(faces), size).select(*key, "bx", "by", "edges", "plane")
    at = cells.select(*key, "cx", "cy", "x", "y").withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))
    met = at.join(spread, [*key, "bx", "by"]).where(geo.intersects(F.col("edges"), F.col("x"), F.col("y")))
    top = met.groupBy(*key, "cx", "cy").agg(F.max(geo.plane_height(F.col("plane"), F.col("x"), F.col("y"))).alias(name))
    return cells.join(top, [*key, "cx", "cy"], "left")


def surfaces(cells: DataFrame, faces: DataFrame, key: list[str], size: float) -> DataFrame:
    """Every cell (key, cx, cy and others) with z_ref and z_pred, the heights of the highest faces (key, edges, plane, is_ref) over
    it of either kind, null where there is none: one join and one aggregation for both."""
    spread = bin_explode(with_bounds(faces.select(*key, "edges", "plane", "is_ref")), size)
    at = cells.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))
    x, y = F.col("x"), F.col("y")
    met = at.join(spread, [*key, "bx", "by"], "left")
    near = x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax"))
    z = F.when(near & geo.intersects(F.col("edges"), x, y), geo.plane_height(F.col("plane"), x, y))
    return met.withColumn("_z", z).groupBy(*cells.columns).agg(F.max(F.when(F.col("is_ref"), F.col("_z"))).alias("z_ref"), F.max(F.when(~F.col("is_ref"), F.col("_z"))).alias("z_pred"))


def cell_median(points: DataFrame, key: list[str], cell: float, name: str = "z_lidar") -> DataFrame:
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return at.groupBy(*key, "cx", "cy").agg(F.median("z").alias(name))


def touched_cells(shapes: DataFrame, size: float) -> DataFrame:
    return bin_explode(with_bounds(shapes), size)
