"""Geometries as hexadecimal EWKB: well-known bytes, little-endian, with the projection's number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyfold.functions import geo

# The format's codes, and the projection of all tables.
POLYGON, MULTI, Z, SRID = 3, 6, 0x80000000, 0x20000000
EPSG = 2950


def _u32(*values: int) -> bytes:
    return np.array(values, "<u4").tobytes()


def _closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.vstack((ring, ring[:1]))


def polygon(rings: list[np.ndarray], srid: int | None = EPSG) -> bytes:
    """A polygon of rings (n, 2) or (n, 3), the outer first; open rings are closed."""
    rings = [_closed(np.asarray(r, "<f8")) for r in rings]
    kind = POLYGON | (Z if rings and rings[0].shape[1] == 3 else 0) | (SRID if srid else 0)
    return b"".join([b"\x01", _u32(kind), _u32(srid) if srid else b"", _u32(len(rings)), *(_u32(len(r)) + r.tobytes() for r in rings)])


def multipolygon(polygons: list[list[np.ndarray]], srid: int = EPSG) -> bytes:
    """Polygons as one geometry; a single one too, so that a column has one type."""
    flat = not polygons or not polygons[0] or np.asarray(polygons[0][0]).shape[1] == 2
    return b"".join([b"\x01", _u32(MULTI | SRID | (0 if flat else Z), srid, len(polygons)), *(polygon(p, None) for p in polygons)])


def ewkb(rings: Column, z: bool = False, multi: bool = False) -> Column:
    """Hexadecimal EWKB of an array of rings of structs (x, y) or (x, y, z); null of null."""
    names = ("x", "y", "z") if z else ("x", "y")

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(value) -> str | None:
            if value is None:
                return None
            shape = [np.array([[p[n] for n in names] for p in ring["p"]], float).reshape(-1, len(names)) for ring in value]
            return (multipolygon([shape] if shape else []) if multi else polygon(shape)).hex().upper()

        return column.map(one)

    return run(geo.wrapped(rings))
