"""GeoPackage layers as a Spark data source: a task reads a range of row numbers with sqlite3."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "fid long, properties map<string,string>, polygons array<array<array<struct<x:double,y:double>>>>"


def polygons_of(blob: bytes) -> list | None:
    """The polygons of a GeoPackage geometry; None for other kinds."""
    flags = blob[3]
    envelope = (0, 32, 48, 48, 64)[flags >> 1 & 7]
    return _wkb(blob, 8 + envelope)[0]


def _wkb(data: bytes, at: int):
    end = "<" if data[at] else ">"
    kind = struct.unpack_from(end + "I", data, at + 1)[0]
    at += 5
    extra = 8 * ((kind // 1000 in (1, 2, 3)) + (kind // 1000 == 3))
    count = struct.unpack_from(end + "I", data, at)[0] if kind % 1000 in (3, 6) else 0
    if kind % 1000 == 3:
        at, rings = at + 4, []
        for _ in range(count):
            n = struct.unpack_from(end + "I", data, at)[0]
            at += 4
            step = 16 + extra
            rings.append([struct.unpack_from(end + "dd", data, at + k * step) for k in range(n)])
            at += n * step
        return [rings], at
    if kind % 1000 == 6:
        at, shapes = at + 4, []
        for _ in range(count):
            found, at = _wkb(data, at)
            shapes += found
        return shapes, at
    return None, at


class GeoPackageSource(DataSource):
    """spark.read.format("geopackage").option("layer", ...).option("rows", 10000).load(path): rows with polygons. The file
    must be where every executor can open it."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["layer"], int(self.options.get("rows", 10_000)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: str, rows: int):
        if not layer.replace("_", "").isalnum():
            raise ValueError(f"not a layer name: {layer!r}")
        self.path, self.layer, self.rows = path, layer, rows

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as con:
            most = con.execute(f'SELECT coalesce(max(rowid), 0) FROM "{self.layer}"').fetchone()[0]
        return [InputPartition((a, a + self.rows)) for a in range(0, most + 1, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        with self._connect() as con:
            shape = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.layer,)).fetchone()[0]
            cursor = con.execute(f'SELECT rowid AS _fid, * FROM "{self.layer}" WHERE rowid >= ? AND rowid < ?', (low, high))
            names = [c[0] for c in cursor.description]
            for row in cursor:
                cells = dict(zip(names, row))
                blob, fid = cells.pop(shape), cells.pop("_fid")
                polygons = polygons_of(blob) if blob else None
                if polygons:
                    yield fid, {k: str(v) for k, v in cells.items() if v is not None}, polygons


def geopackage_layer(spark: SparkSession, path: str, layer: str, rows: int = 10_000):
    spark.dataSource.register(GeoPackageSource)
    return spark.read.format("geopackage").option("layer", layer).option("rows", rows).load(path)
