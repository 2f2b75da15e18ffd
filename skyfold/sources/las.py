"""The ``las`` data source: classified points of LAS files, split by record ranges.

``spark.read.format("las").load(path)``: path names a file or a folder (``spark.dataSource
.register(LasSource)`` first). Options: ``records`` a partition, ``classes`` (comma-separated)
and ``bbox`` (xmin,ymin,xmax,ymax, bounds included), by which records are dropped before they
leave the reader and files by their headers. These are options, not pushed filters: Spark 4.1
keeps what was pushed with the source, so two branches of one frame would share their filters.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tile string, point_id bigint, x double, y double, z double, classification tinyint"

# The public header block's fields by offset (LAS 1.2).
_VERSION, _HEADER_SIZE, _DATA, _FORMAT, _RECORD, _COUNT, _SCALE, _OFFSET, _BOUNDS, _LEAST = 24, 94, 96, 104, 105, 107, 131, 155, 179, 227
# Bytes before the classification: formats 0-5 hold it at 15, 6-10 at 16.
_CLASS_AT = {**dict.fromkeys(range(6), 15), **dict.fromkeys(range(6, 11), 16)}


@dataclass(frozen=True)
class LasHeader:
    version: str
    point_format: int
    record_bytes: int
    data_offset: int
    point_count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    xmin: float
    xmax: float
    ymin: float
    ymax: float
    zmin: float
    zmax: float

    @property
    def area_m2(self) -> float:
        return (self.xmax - self.xmin) * (self.ymax - self.ymin)

    @property
    def density(self) -> float:
        """Points a square metre of the bounds; 0 without area."""
        return self.point_count / self.area_m2 if self.area_m2 > 0 else 0.0


def parse_header(raw: bytes) -> LasHeader:
    if len(raw) < _LEAST:
        raise ValueError(f"a LAS header has {_LEAST} bytes at least, not {len(raw)}")
    if raw[:4] != b"LASF":
        raise ValueError("no LAS file: the signature is not LASF")
    at = lambda kind, pos, n=1: np.frombuffer(raw, kind, n, pos)
    xmax, xmin, ymax, ymin, zmax, zmin = map(float, at("<f8", _BOUNDS, 6))
    count = int(at("<u4", _COUNT)[0])
    if count == 0 and raw[_VERSION + 1] >= 4 and len(raw) >= 255:
        count = int(at("<u8", 247)[0])
    return LasHeader(
        f"{raw[_VERSION]}.{raw[_VERSION + 1]}", raw[_FORMAT] & 0x3F, int(at("<u2", _RECORD)[0]), int(at("<u4", _DATA)[0]), count,
        tuple(map(float, at("<f8", _SCALE, 3))), tuple(map(float, at("<f8", _OFFSET, 3))), xmin, xmax, ymin, ymax, zmin, zmax,
    )


def read_header(path: str) -> LasHeader:
    with open(path, "rb") as f:
        head = f.read(375)
    if raw_compressed(head):
        raise ValueError(f"{path}: compressed points (LAZ) need a codec that is not there")
    return parse_header(head)


def raw_compressed(head: bytes) -> bool:
    return len(head) > _FORMAT and head[:4] == b"LASF" and bool(head[_FORMAT] & 0xC0)


def decode(raw: bytes, header: LasHeader) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) coordinates and classes of whole records."""
    n = len(raw) // header.record_bytes
    records = np.frombuffer(raw, np.uint8, n * header.record_bytes).reshape(n, header.record_bytes)
    xyz = records[:, :12].copy().view("<i4").astype(float) * header.scale + header.offset
    cls = records[:, _CLASS_AT[header.point_format]]
    return xyz, cls & (0x1F if header.point_format < 6 else 0xFF)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = options["path"].removeprefix("file://")
        self.paths = sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith(".las")) if os.path.isdir(path) else [path]
        self.records = int(options.get("records", 2_000_000))
        self.classes = [int(c) for c in options["classes"].split(",")] if options.get("classes") else None
        self.bbox = [float(v) for v in options["bbox"].split(",")] if options.get("bbox") else None

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            header = read_header(path)
            if not self._outside(header):
                out += [Range(path, i, min(self.records, header.point_count - i)) for i in range(0, header.point_count, self.records)]
        return out

    def _outside(self, h: LasHeader) -> bool:
        """Whether the bounds in the header rule the whole file out."""
        return self.bbox is not None and (h.xmax < self.bbox[0] or h.ymax < self.bbox[1] or h.xmin > self.bbox[2] or h.ymin > self.bbox[3])

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        header = read_header(part.path)
        tile = os.path.basename(part.path).split("_")[0].removesuffix(".las")
        with open(part.path, "rb") as f:
            f.seek(header.data_offset + part.first * header.record_bytes)
            raw = f.read(part.count * header.record_bytes)
        if len(raw) < part.count * header.record_bytes:
            raise ValueError(f"{part.path}: the file ends before its last record")
        xyz, cls = decode(raw, header)
        keep = np.isin(cls, self.classes) if self.classes is not None else np.ones(len(cls), bool)
        if self.bbox is not None:
            keep &= ((xyz[:, :2] >= self.bbox[:2]) & (xyz[:, :2] <= self.bbox[2:])).all(1)
        at = np.flatnonzero(keep)
        for i in range(0, len(at), 100_000):
            k = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([tile] * len(k), pa.string()), pa.array(k + part.first), *(pa.array(xyz[k, c]) for c in range(3)), pa.array(cls[k].astype(np.int8))], names=["tile", "point_id", "x", "y", "z", "classification"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(dict(self.options))


def read_points(spark: SparkSession, path: str, records: int = 2_000_000, classes: tuple[int, ...] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    spark.dataSource.register(LasSource)
    reader = spark.read.format("las").option("records", records)
    if classes is not None:
        reader = reader.option("classes", ",".join(map(str, classes)))
    if bbox is not None:
        reader = reader.option("bbox", ",".join(map(str, bbox)))
    return reader.load(path)


def write_las(path: str, xyz: np.ndarray, cls: np.ndarray, scale: float = 0.001) -> None:
    """A LAS 1.2 file of point format 1, for tests and exports."""
    xyz = np.asarray(xyz, float).reshape(-1, 3)
    offset = np.floor(xyz.min(axis=0)) if len(xyz) else np.zeros(3)
    head = bytearray(_LEAST)
    head[:4], head[_VERSION], head[_VERSION + 1], head[_FORMAT] = b"LASF", 1, 2, 1
    put = lambda kind, pos, v: head.__setitem__(slice(pos, pos + len(np.array(v, kind).tobytes())), np.array(v, kind).tobytes())
    put("<u2", _HEADER_SIZE, _LEAST), put("<u4", _DATA, _LEAST), put("<u2", _RECORD, 28), put("<u4", _COUNT, len(xyz))
    put("<f8", _SCALE, [scale] * 3), put("<f8", _OFFSET, offset)
    if len(xyz):
        put("<f8", _BOUNDS, np.stack((xyz.max(axis=0), xyz.min(axis=0)), axis=1).ravel())
    records = np.zeros((len(xyz), 28), np.uint8)
    records[:, :12] = np.rint((xyz - offset) / scale).astype("<i4").view(np.uint8).reshape(-1, 12)
    records[:, 15] = cls
    with open(path, "wb") as f:
        f.write(bytes(head) + records.tobytes())
