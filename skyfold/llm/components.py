"""Connected components of an edge table, in DataFrame steps.

Alternating large-star and small-star steps hang every node on the least node of its
neighbourhood until all hang on the least of their component. Each round is written
to the shared folder and deletes the one before. No group is ever gathered: a step takes the least neighbour
by a partial aggregate and joins it back, and a join's hot side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut, discard


def _attach(arcs: DataFrame) -> DataFrame:
    """arcs (u, v) with the least of u and its neighbours as m."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the least node reachable.

    Nulls and loops are no edges. Direction and repetition mean nothing. Rounds grow
    with the logarithm of the longest path; they end when a round changes nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _attach(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        small = _attach(large)  # v < u in all of them
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = cut(small.where("u > v").distinct(), "edges")
        same = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first() == new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        discard(e)
        e = new
        if same:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
