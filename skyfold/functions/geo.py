"""Geometry as Column expressions: all of it stays in the JVM.

A polygon is an array of its edges, structs (x1, y1, x2, y2), of all rings together;
inside is even-odd, so holes and self-crossing rings need no care. Products are of
differences only, so integers stay exact and large eastings cost no precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of structs with x and y; it is closed if it is not."""
    n = F.size(ring)
    edge = lambda i: F.struct(
        F.element_at(ring, i).x.alias("x1"), F.element_at(ring, i).y.alias("y1"), F.element_at(ring, i % n + 1).x.alias("x2"), F.element_at(ring, i % n + 1).y.alias("y2")
    )
    return F.filter(F.transform(F.sequence(F.lit(1), n), edge), lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))


def _cross(e: Column, x: Column, y: Column) -> Column:
    return (e.x2 - e.x1) * (y - e.y1) - (x - e.x1) * (e.y2 - e.y1)


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda e: (_cross(e, x, y) == 0) & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)))


def _odd(edges: Column, x: Column, y: Column) -> Column:
    crosses = lambda e: ((e.y1 > y) != (e.y2 > y)) & (F.when(e.y2 > e.y1, _cross(e, x, y)).otherwise(-_cross(e, x, y)) > 0)
    return F.size(F.filter(edges, crosses)) % 2 == 1


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside and not on the boundary."""
    return _odd(edges, x, y) & ~on_boundary(edges, x, y)


def intersects(edges: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside or on the boundary."""
    return _odd(edges, x, y) | on_boundary(edges, x, y)


def boundary_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance of the point from the nearest edge."""

    def one(e: Column) -> Column:
        dx, dy = (e.x2 - e.x1).cast("double"), (e.y2 - e.y1).cast("double")
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e.x1) * dx + (y - e.y1) * dy) / (dx * dx + dy * dy)))
        return F.sqrt(F.pow((x - e.x1) - t * dx, F.lit(2)) + F.pow((y - e.y1) - t * dy, F.lit(2)))

    return F.array_min(F.transform(edges, one))


def within(edges: Column, x: Column, y: Column, reach: float) -> Column:
    """Inside, or nearer to the boundary than ``reach``: a buffer without building one."""
    return _odd(edges, x, y) | (boundary_distance(edges, x, y) < reach)


def wrapped(rings: Column) -> Column:
    """Rings as structs with one field p: an array of arrays of several lengths does not pass into pandas."""
    return F.transform(rings, lambda r: F.struct(r.alias("p")))


def newell(ring: Column) -> Column:
    """Newell's normal (nx, ny, nz) of a ring of structs (x, y, z), twice the area long. Taken about
    the first vertex, so that large coordinates cost nothing."""
    n = F.size(ring)
    o = F.element_at(ring, 1)

    def term(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        ax, ay, az, bx, by, bz = a.x - o.x, a.y - o.y, a.z - o.z, b.x - o.x, b.y - o.y, b.z - o.z
        return F.struct(((ay - by) * (az + bz)).cast("double").alias("nx"), ((az - bz) * (ax + bx)).cast("double").alias("ny"), ((ax - bx) * (ay + by)).cast("double").alias("nz"))

    zero = F.struct(F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), zero, lambda a, t: F.struct((a.nx + t.nx).alias("nx"), (a.ny + t.ny).alias("ny"), (a.nz + t.nz).alias("nz")))


def norm(v: Column) -> Column:
    return F.sqrt(v.nx * v.nx + v.ny * v.ny + v.nz * v.nz)


def ring_area(ring: Column) -> Column:
    return norm(newell(ring)) / 2


def slope_degrees(v: Column) -> Column:
    """Slope of a plane with this normal, of any length; 0 if it has none."""
    return F.when(norm(v) == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.abs(v.nz) / norm(v)))))


def orientation_error(a: Column, b: Column) -> Column:
    """Unsigned angle between two normals in degrees; null if either has no length."""
    dot = F.abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.try_divide(dot, norm(a) * norm(b)))))


def plane_height(plane: Column, x: Column, y: Column) -> Column:
    return (plane.d - plane.nx * x - plane.ny * y) / plane.nz


def plane_distance(plane: Column, x: Column, y: Column, z: Column) -> Column:
    return F.abs(plane.nx * x + plane.ny * y + plane.nz * z - plane.d)


def shoelace(ring: Column) -> Column:
    """Signed plan area of a ring of structs (x, y)."""
    o = F.element_at(ring, 1)
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda a, e: a + (e.x1 - o.x) * (e.y2 - o.y) - (e.x2 - o.x) * (e.y1 - o.y)) / 2


def iou(a: Column, b: Column, common: Column) -> Column:
    """Intersection over union of areas; impossible areas are an error, no area at all null."""
    bad = (a < 0) | (b < 0) | (common < 0) | (common > F.least(a, b) * (1 + 1e-9))
    return F.when(bad, F.raise_error(F.lit("impossible areas"))).otherwise(F.try_divide(common, a + b - common))


def face_count_agreement(p: Column, r: Column) -> Column:
    return F.when((p == 0) & (r == 0), F.lit(1.0)).otherwise(F.least(p, r) / F.greatest(p, r))


def density_bin(density: Column) -> Column:
    return F.when(density < 5, "<5").when(density < 10, "5-10").when(density < 20, "10-20").when(density >= 20, ">=20")


def size_bin(area: Column) -> Column:
    return F.when(area < 100, "<100").when(area < 250, "100-250").when(area < 1000, "250-1000").when(area >= 1000, ">=1000")


def roof_type(steep_fraction: Column) -> Column:
    """flat under a tenth of steep roof, mixed under three fifths, else pitched."""
    return F.when(steep_fraction < 0.10, "flat").when(steep_fraction < 0.60, "mixed").otherwise("pitched")


def tile_name(x: Column, y: Column, metre: float = 1.0) -> Column:
    """Name of the 1 km tile of a place; metre: units a metre."""
    km = 1000 * metre
    return F.concat(F.floor(x / km).cast("string"), F.lit("-"), F.floor(y / km).cast("string"))


def footprint_id(cx: Column, cy: Column) -> Column:
    """Stable id from a centroid in metres, to the decimetre, halves up."""
    return F.concat(F.lit("fp-"), F.floor(cx * 10 + 0.5).cast("string"), F.lit("-"), F.floor(cy * 10 + 0.5).cast("string"))


def is_grouped(gml_id: Column) -> Column:
    return F.startswith(F.substring_index(gml_id, ":", -1), F.lit("Groupe"))


def qualify_grouped(gml_id: Column, tile: Column) -> Column:
    """Ids of grouped blocks are unique only within a tile: the tile goes before them."""
    return F.when(is_grouped(gml_id) & ~F.contains(gml_id, F.lit(":")), F.concat(tile, F.lit(":"), gml_id)).otherwise(gml_id)


def block_id(x: Column, y: Column, size: float) -> Column:
    if size <= 0:
        raise ValueError("block size must be positive")
    return F.struct(F.floor(x / size).alias("bx"), F.floor(y / size).alias("by"))
