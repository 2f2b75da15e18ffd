"""Validity of solids as relations over their directed edges, one row (key, a, b) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watertight(edges: DataFrame, key: str) -> DataFrame:
    """Whether every undirected edge comes exactly twice."""
    each = edges.groupBy(key, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.bool_and(F.col("n") == 2).alias("watertight"))


def oriented(edges: DataFrame, key: str) -> DataFrame:
    """Whether every directed edge comes once, and so does its reverse."""
    pair = edges.groupBy(key, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(
        F.count_if(F.col("a") <= F.col("b")).alias("forth"), F.count_if(F.col("a") >= F.col("b")).alias("back")
    )
    return pair.groupBy(key).agg(F.bool_and((F.col("forth") == 1) & (F.col("back") == 1)).alias("oriented"))


def polyhedral_wkt(surfaces: Column, vertices: Column) -> Column:
    """POLYHEDRALSURFACE Z of surfaces (rings of vertex numbers from 0) with four decimals, rings closed."""
    place = lambda i: F.concat_ws(" ", *(F.format_string("%.4f", F.element_at(vertices, i + 1)[c]) for c in "xyz"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), place), ", "), F.lit(")"))
    body = lambda s: F.concat(F.lit("("), F.array_join(F.transform(s.rings, ring), ", "), F.lit(")"))
    return F.concat(F.lit("POLYHEDRALSURFACE Z ("), F.array_join(F.transform(surfaces, body), ", "), F.lit(")"))
