"""OpenStreetMap extracts (.osm.pbf) as a Spark data source.

The driver reads only the headers of a file's blobs and deals runs of blobs out as partitions. A task unpacks its blobs and
yields Arrow batches: packed numbers are decoded for a whole block at once, with numpy, never node by node. Groups of kinds
that aren't asked for are skipped without decoding them.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MEMBER = "struct<type:string,ref:long,role:string>"
_SCHEMA = f"osm_type string, osm_id long, tags map<string,string>, lon double, lat double, refs array<long>, members array<{_MEMBER}>"
_TYPES = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
_ARROW = pa.schema([("osm_type", pa.string()), ("osm_id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lon", pa.float64()), ("lat", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(_TYPES))])
KINDS = ("n", "w", "r")
#: What the format can ask of a reader, and its limit of a blob.
FEATURES, MOST = {"OsmSchema-V0.6", "DenseNodes"}, 32 << 20


def number(data: memoryview, at: int) -> tuple[int, int]:
    """The varint at a place, and the place after it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field, value) of a message; bytes stay a view."""
    at = 0
    while at < len(data):
        key, at = number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = number(data, at)
        elif kind == 2:
            size, at = number(data, at)
            if at + size > len(data):
                raise ValueError("a field ends beyond its message")
            value, at = data[at : at + size], at + size
        else:
            width = {1: 8, 5: 4}[kind]
            value, at = data[at : at + width], at + width
        yield key >> 3, value


def packed(data: bytes | memoryview) -> np.ndarray:
    """All varints of a buffer."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size, value = ends - starts + 1, np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        long = size > k
        value[long] |= (raw[starts[long] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return value


def zigzag(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)


def lists(parts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """The varints of many buffers in one array, and where each one's begin."""
    whole = b"".join(parts)
    done = np.concatenate([[0], np.cumsum(np.frombuffer(whole, np.uint8) < 0x80)])
    return packed(whole), done[np.cumsum([0, *map(len, parts)])]


def summed(deltas: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Delta-coded lists as values."""
    total = np.concatenate([[0], np.cumsum(deltas)])
    return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))


def unpacked(blob: memoryview) -> bytes:
    for field, value in fields(blob):
        if field == 1:
            return bytes(value)
        if field in (3, 4, 5):
            return {3: zlib, 4: lzma, 5: bz2}[field].decompress(value)
        if field == 7:
            return pa.input_stream(pa.py_buffer(value), compression="zstd").read()
        if field == 6:
            return pa.decompress(pa.py_buffer(value), dict((f, v) for f, v in fields(blob) if f == 2)[2], codec="lz4_raw", asbytes=True)
    raise ValueError("a blob without data")


def headers(stream, size: int) -> Iterator[tuple[str, int, int]]:
    """(type, place, size) of the blobs; only headers are read."""
    at = 0
    while at < size:
        stream.seek(at)
        length = int.from_bytes(stream.read(4), "big")
        if not 0 < length <= 64 << 10:
            raise ValueError(f"no blob header at {at}")
        kind, blob = "", 0
        for field, value in fields(memoryview(stream.read(length))):
            kind, blob = (bytes(value).decode(), blob) if field == 1 else (kind, value if field == 3 else blob)
        if blob > MOST or at + 4 + length + blob > size:
            raise ValueError(f"the blob at {at} is cut off or too large")
        yield kind, at + 4 + length, blob
        at += 4 + length + blob


def tag_maps(strings: np.ndarray, offsets: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.Array:
    text = lambda k: pa.array(strings[k.astype(np.int64)], pa.string())
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), text(keys), text(values))


class Block:
    """A block's string table and scale."""

    def __init__(self, data: bytes):
        strings, self.groups, self.scale, self.origin = [], [], 100, [0, 0]
        for field, value in fields(memoryview(data)):
            if field == 1:
                strings = [bytes(v).decode("utf-8", "replace") for f, v in fields(value) if f == 1]
            elif field == 2:
                self.groups.append(value)
            elif field == 17:
                self.scale = value
            elif field in (19, 20):
                self.origin[field - 19] = value - (1 << 64) if value >> 63 else value
        self.strings = np.array(strings or [""], object)

    def degrees(self, values: np.ndarray, axis: int) -> np.ndarray:
        """Coordinates in steps of a ten millionth of a degree."""
        nano = self.origin[axis] + self.scale * values
        return np.sign(nano) * (np.abs(nano) // 100) / 1e7

    def batches(self, kinds: frozenset[str]) -> Iterator[pa.RecordBatch]:
        for group in self.groups:
            found: dict[int, list[memoryview]] = {}
            for field, value in fields(group):
                found.setdefault(field, []).append(value)
            if "n" in kinds:
                yield from (self.dense(d) for d in found.get(2, []))
                if 1 in found:
                    yield self.nodes(found[1])
            if "w" in kinds and 3 in found:
                yield self.ways(found[3])
            if "r" in kinds and 4 in found:
                yield self.relations(found[4])

    def batch(self, kind: str, ids: np.ndarray, tags: pa.Array, **more: pa.Array) -> pa.RecordBatch:
        columns = {"osm_type": pa.array([kind] * len(ids)), "osm_id": pa.array(ids, pa.int64()), "tags": tags} | more
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(ids), f.type)) for f in _ARROW], schema=_ARROW)

    def dense(self, group: memoryview) -> pa.RecordBatch:
        part = dict(fields(group))
        ids, lat, lon = (np.cumsum(zigzag(packed(part.get(f, b"")))) for f in (1, 8, 9))
        tagged = packed(part.get(10, b""))
        ends = np.flatnonzero(tagged == 0)
        offsets = np.zeros(len(ids) + 1, np.int64)
        if len(ends):
            offsets[1:] = (ends - np.arange(len(ends))) // 2
        pairs = tagged[tagged != 0].reshape(-1, 2)
        tags = tag_maps(self.strings, offsets, pairs[:, 0], pairs[:, 1])
        return self.batch("n", ids, tags, lon=pa.array(self.degrees(lon, 1)), lat=pa.array(self.degrees(lat, 0)))

    def parts(self, objects: list[memoryview], signed_id: bool) -> tuple[list[dict], np.ndarray, pa.Array]:
        """The objects' fields, ids and tags."""
        each = [dict(fields(o)) for o in objects]
        ids = np.array([e[1] for e in each], np.uint64)
        keys, offsets = lists([e.get(2, b"") for e in each])
        values, _ = lists([e.get(3, b"") for e in each])
        return each, zigzag(ids) if signed_id else ids.astype(np.int64), tag_maps(self.strings, offsets, keys, values)

    def nodes(self, objects: list[memoryview]) -> pa.RecordBatch:
        each, ids, tags = self.parts(objects, True)
        lat, lon = (zigzag(np.array([e[f] for e in each], np.uint64)) for f in (8, 9))
        return self.batch("n", ids, tags, lon=pa.array(self.degrees(lon, 1)), lat=pa.array(self.degrees(lat, 0)))

    def ways(self, objects: list[memoryview]) -> pa.RecordBatch:
        each, ids, tags = self.parts(objects, False)
        deltas, offsets = lists([e.get(8, b"") for e in each])
        refs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(summed(zigzag(deltas), offsets), pa.int64()))
        return self.batch("w", ids, tags, refs=refs)

    def relations(self, objects: list[memoryview]) -> pa.RecordBatch:
        each, ids, tags = self.parts(objects, False)
        deltas, offsets = lists([e.get(9, b"") for e in each])
        roles, kinds = (lists([e.get(f, b"") for e in each])[0].astype(np.int64) for f in (8, 10))
        members = [pa.array(np.array(KINDS, object)[kinds], pa.string()), pa.array(summed(zigzag(deltas), offsets), pa.int64()), pa.array(self.strings[roles], pa.string())]
        return self.batch("r", ids, tags, members=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(members, fields=list(_TYPES))))


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class OsmPbfSource(DataSource):
    """spark.read.format("osm_pbf").option("bytes", 8000000).option("kinds", "nwr").load(path): the objects of a file, or of
    the .pbf files of a folder, in a partition per `bytes` of blobs. The path may be a URI of any store that Arrow reads;
    without a scheme it must be where every executor can open it."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("bytes", 8_000_000)), frozenset(self.options.get("kinds", "".join(KINDS))))


class _Reader(DataSourceReader):
    def __init__(self, path: str, share: int, kinds: frozenset[str]):
        self.path, self.share, self.kinds = path, share, kinds

    def partitions(self) -> list[InputPartition]:
        system, path = place(self.path)
        info = system.get_file_info(path)
        files = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(".pbf")]
        out: list[InputPartition] = []
        for file in sorted(files, key=lambda i: i.path):
            blobs, total = [], 0
            with system.open_input_file(file.path) as stream:
                for kind, at, size in headers(stream, file.size):
                    if kind == "OSMHeader":
                        stream.seek(at)
                        asked = {bytes(v).decode() for f, v in fields(memoryview(unpacked(memoryview(stream.read(size))))) if f == 4}
                        if asked - FEATURES:
                            raise ValueError(f"{file.path} needs {', '.join(sorted(asked - FEATURES))}")
                    if kind == "OSMData":
                        if blobs and total + size > self.share:
                            out.append(InputPartition((file.path, blobs)))
                            blobs, total = [], 0
                        blobs.append((at, size))
                        total += size
            if blobs:
                out.append(InputPartition((file.path, blobs)))
        return out or [InputPartition((None, []))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, blobs = partition.value
        if not blobs or not self.kinds:
            return
        with place(self.path)[0].open_input_file(path) as stream:
            for at, size in blobs:
                stream.seek(at)
                yield from Block(unpacked(memoryview(stream.read(size)))).batches(self.kinds)


def osm_objects(spark: SparkSession, path: str, share: int = 8_000_000) -> DataFrame:
    """Nodes (lon, lat), ways (refs) and relations (members) with their tags.

    Each kind is a scan of its own under a constant osm_type, so that a filter on it drops the other scans from the plan.
    (Filters pushed into a Python source reach every scan of one plan alike, even if they differ.)
    """
    spark.dataSource.register(OsmPbfSource)
    scan = lambda kind: spark.read.format("osm_pbf").option("bytes", share).option("kinds", kind).load(path)
    return reduce(DataFrame.union, [scan(k).withColumn("osm_type", F.lit(k)) for k in KINDS])
