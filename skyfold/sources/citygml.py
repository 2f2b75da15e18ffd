"""Reference buildings from CityGML: the built-in XML reader with a schema of its own, so that
columns are pruned and one child or several read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import geo

_SCHEMA = (
    "`_gml:id` string, `bldg:boundedBy` array<struct<`bldg:RoofSurface`: struct<`_gml:id`: string, `bldg:lod2MultiSurface`: string>>>, "
    "`gen:stringAttribute` array<struct<`_name`: string, `gen:value`: string>>"
)


def parse_poslist(text: Column) -> Column:
    """Array of structs (x, y, z); an error if the numbers are no triples."""
    n = F.transform(F.array_remove(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), ""), lambda v: v.cast("double"))
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 3).cast("int") - 1), lambda i: F.struct(*(F.element_at(n, (3 * i + k + 1).cast("int")).alias(c) for k, c in enumerate("xyz"))))
    bad = F.raise_error(F.concat(F.lit("posList length "), F.size(n).cast("string"), F.lit(" is not a multiple of 3")))
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")
    return F.when(F.size(n) % 3 != 0, bad.cast("array<struct<x:double,y:double,z:double>>")).when(F.size(n) == 0, none).otherwise(triples)


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """(tile, gml_id, attributes, is_grouped, roofs) of every building, those without roofs too. Ids of
    grouped blocks get their tile; every posList of a roof surface, holes too, is a polygon of its own."""
    raw = spark.read.format("xml").option("rowTag", "bldg:Building").schema(_SCHEMA).load(path)
    stem = F.element_at(F.split(F.col("_metadata.file_name"), r"\.", -1), 1)
    tile = F.substring_index(stem, "_", 1)
    surfaces = F.filter(F.coalesce("`bldg:boundedBy`", F.array()), lambda s: s["bldg:RoofSurface"].isNotNull())
    rings = lambda s: F.transform(
        F.regexp_extract_all(F.coalesce(s["bldg:RoofSurface"]["bldg:lod2MultiSurface"], F.lit("")), F.lit(r"<gml:posList[^>]*>([^<]+)</gml:posList>"), F.lit(1)),
        lambda p: F.struct(F.coalesce(s["bldg:RoofSurface"]["_gml:id"], F.lit("")).alias("surface_id"), parse_poslist(p).alias("ring")),
    )
    attributes = F.map_from_entries(F.transform(F.coalesce("`gen:stringAttribute`", F.array()), lambda a: F.struct(F.coalesce(a["_name"], F.lit("")).alias("k"), F.coalesce(a["gen:value"], F.lit("")).alias("v"))))
    out = raw.select(tile.alias("tile"), F.coalesce("`_gml:id`", F.lit("")).alias("gml_id"), attributes.alias("attributes"), F.flatten(F.transform(surfaces, rings)).alias("roofs"))
    return out.withColumn("is_grouped", geo.is_grouped(F.col("gml_id"))).withColumn("gml_id", geo.qualify_grouped(F.col("gml_id"), F.col("tile")))


def roof_surfaces(buildings: DataFrame) -> DataFrame:
    """(gml_id, ordinal, surface_id, ring, area_m2, slope_deg); rings of fewer than four vertices are left out and leave a gap."""
    each = buildings.select("gml_id", F.posexplode("roofs").alias("ordinal", "r")).select("gml_id", "ordinal", "r.surface_id", "r.ring").where(F.size("ring") >= 4)
    return each.withColumn("area_m2", geo.ring_area(F.col("ring"))).withColumn("slope_deg", geo.slope_degrees(geo.newell(F.col("ring"))))
