"""Roof outlines from GeoJSON and from shapefiles in a zip."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import geo
from skyfold.operators import clip

# Fixed value: the attribute of outlines drawn from the points themselves.
LIDAR_DERIVED_SOURCE = "LiDAR aérien 2015"
_RINGS = "array<array<struct<x:double,y:double>>>"
_GEOJSON = (
    "features array<struct<properties: struct<footprint_id: string, lidar_derived: boolean, methode: string, source: string, MAJ: string>, "
    "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
)


def is_lidar_derived(source: Column) -> Column:
    return F.coalesce(F.contains(source, F.lit(LIDAR_DERIVED_SOURCE)), F.lit(False))


def _edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, geo.ring_edges))


def centroid(rings: Column) -> Column:
    """Struct (x, y): the area's centroid, about the first vertex; holes are wound the other way."""
    o = F.element_at(F.element_at(rings, 1), 1)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        w = (e.x1 - o.x) * (e.y2 - o.y) - (e.x2 - o.x) * (e.y1 - o.y)
        return F.struct((s.a + w).alias("a"), (s.x + w * (e.x1 + e.x2 - 2 * o.x)).alias("x"), (s.y + w * (e.y1 + e.y2 - 2 * o.y)).alias("y"))

    return F.aggregate(_edges(rings), zero, add, lambda s: F.struct((o.x + s.x / (3 * s.a)).alias("x"), (o.y + s.y / (3 * s.a)).alias("y")))


def _finish(rows: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """Ids from centroids, one row an id, the flag of any; only outlines that touch the bbox."""
    rows = rows.withColumn("edges", _edges(F.col("rings")))
    if bbox:
        from skyfold.operators import spatial

        xmin, ymin, xmax, ymax = bbox
        rows = spatial.with_bounds(rows).where((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax)).drop("xmin", "ymin", "xmax", "ymax")
    c = centroid(F.col("rings"))
    rows = rows.withColumn("footprint_id", geo.footprint_id(c.x, c.y)).withColumn("lidar_derived", is_lidar_derived(F.col("source")))
    return clip.dedup_footprints(rows).drop("ordinal")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(footprint_id, lidar_derived, methode, source, maj, rings, edges) as the files give them."""
    f = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rings = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    out = f.select("f.properties.footprint_id", "f.properties.lidar_derived", "f.properties.methode", "f.properties.source", F.col("f.properties.MAJ").alias("maj"), rings.alias("rings"))
    return out.withColumn("edges", _edges(F.col("rings")))


def parse_shp(data: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """Rings of each polygon record of a .shp; a null shape has none."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        kind, body = struct.unpack_from("<i", data, at + 8)[0], at + 8
        rings = []
        if kind % 10 == 5:
            parts, points = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        elif kind:
            raise ValueError(f"shape type {kind} is no polygon")
        yield rings
        at += 8 + 2 * words


def parse_dbf(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Records of a .dbf as text."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16]))
        at += 32
    for i in range(count):
        pos = head + i * size + 1
        row = {}
        for name, width in fields:
            row[name] = data[pos : pos + width].decode(encoding, "replace").strip()
            pos += width
        yield row


def read_shapefile(spark: SparkSession, path: str, layer: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Outlines of a polygon layer in zips. A zip is one task: such layers are city-sized files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next(n for n in z.namelist() if n.endswith(f"{layer}.shp"))
                    shapes, rows = parse_shp(z.read(name)), parse_dbf(z.read(name[:-4] + ".dbf"))
                    out = [
                        {"ordinal": i, "methode": r.get("methode"), "source": r.get("source"), "maj": r.get("MAJ"), "rings": [[{"x": x, "y": y} for x, y in ring] for ring in s]}
                        for i, (s, r) in enumerate(zip(shapes, rows, strict=True))
                        if s
                    ]
                yield pd.DataFrame(out, columns=["ordinal", "methode", "source", "maj", "rings"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"ordinal bigint, methode string, source string, maj string, rings {_RINGS}")
    return _finish(rows, bbox)
