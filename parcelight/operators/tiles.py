"""Vector tiles: polygons simplified, projected, clipped and encoded, a group per tile."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import tile_tolerance
from ..functions.nested_lists import unnested
from .ranking import top_per_group

EXTENT, BUFFER, LAYER = 4096, 256, "buildings"


def tile_of(lng, lat, zoom: int):
    """A struct (x, y) of the tile that holds a place."""
    n = float(1 << zoom)
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2
    return F.struct(F.floor((lng + 180) / 360 * n).cast("int").alias("x"), F.floor(y * n).cast("int").alias("y"))


def project(ring: np.ndarray, zoom: int, x: int | np.ndarray, y: int | np.ndarray) -> np.ndarray:
    """Degrees to units of the tile."""
    n, lat = 1 << zoom, np.radians(np.clip(ring[:, 1], -85.05, 85.05))
    across = (ring[:, 0] + 180) / 360 * n - x
    down = (1 - np.log(np.tan(lat) + 1 / np.cos(lat)) / math.pi) / 2 * n - y
    return np.column_stack([across, down]) * EXTENT


def clip(ring: np.ndarray, low: float, high: float) -> np.ndarray:
    """The part of a ring within low and high on both axes."""
    points = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    for axis, bound, sign in ((0, low, 1), (0, high, -1), (1, low, 1), (1, high, -1)):
        out = []
        for p, q in zip(points, np.roll(points, 1, axis=0)):
            dp, dq = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if (dp >= 0) != (dq >= 0):
                out.append(q + (p - q) * (dq / (dq - dp)))
            if dp >= 0:
                out.append(p)
        points = np.array(out).reshape(-1, 2)
        if len(points) < 3:
            return np.zeros((0, 2))
    return points


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def geometry(rings: list[np.ndarray]) -> bytes:
    """Move, line and close commands of rings in whole units; rings without area are left out."""
    out, at = [], np.zeros(2, int)
    for ring in rings:
        points = np.rint(ring).astype(int)
        points = points[np.any(points != np.roll(points, 1, axis=0), axis=1)]
        if len(points) < 3:
            continue
        moves = np.diff(np.vstack([at, points]), axis=0)
        zigzag = [[int(v) << 1 ^ int(v) >> 63 for v in m] for m in moves]
        out += [9, *zigzag[0], (len(points) - 1) << 3 | 2, *[v for m in zigzag[1:] for v in m], 15]
        at = points[-1]
    return b"".join(map(varint, out))


def encode(ids: list[str], shapes: list[bytes]) -> bytes:
    """One layer; each feature has its id as a property. A feature whose shape is empty only leaves its id."""
    values, body = [], []
    for k, (identity, shape) in enumerate(zip(ids, shapes)):
        if shape:
            body.append(field(2, field(2, b"\0" + varint(k)) + b"\x18\x03" + field(4, shape)))
        values.append(field(4, field(1, identity.encode())))
    layer = varint(15 << 3) + varint(2) + field(1, LAYER.encode()) + b"".join(body) + field(3, b"id") + b"".join(values) + varint(5 << 3) + varint(EXTENT)
    return field(3, layer)


def rings_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(points, where each ring's begin): all rings of a column in one array."""
    ((offsets, _),), points = unnested(column)
    return points[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def chosen(points: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def opened(points: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen rings without the point that closes them, and which of them had one."""
    closed = some & (np.diff(first) > 1)
    closed[closed] = (points[first[:-1][closed]] == points[first[1:][closed] - 1]).all(axis=1)
    keep = np.ones(len(points), bool)
    keep[first[1:][closed] - 1] = False
    return *chosen(points, first, keep), closed


def simplified(points: np.ndarray, first: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """`geo.simplify_ring` for opened rings: the parts of all rings are halved at the same time."""
    if tolerance <= 0:
        return points, first
    keep = np.zeros(len(points), bool)
    i, j = first[:-1], first[1:] - 1
    keep[i[j >= i]] = keep[j[j >= i]] = True
    i, j = i[j - i >= 2], j[j - i >= 2]
    while len(i):
        n = j - i - 1
        start = np.cumsum(n) - n
        part = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(part)) - start[part] + i[part] + 1
        d = (points[j] - points[i])[part]
        p = points[at] - points[i][part]
        length = (d**2).sum(axis=1)
        t = np.where(length > 0, np.clip((p * d).sum(axis=1) / np.where(length > 0, length, 1), 0, 1), 0)
        gap = ((p - t[:, None] * d) ** 2).sum(axis=1)
        most = np.maximum.reduceat(gap, start)
        far = np.flatnonzero((gap == most[part]) & (most > tolerance * tolerance)[part])
        far = far[np.diff(part[far], prepend=-1) > 0]  # the first of each part
        keep[at[far]] = True
        i, j = np.concatenate([i[part[far]], at[far]]), np.concatenate([at[far], j[part[far]]])
        i, j = i[j - i >= 2], j[j - i >= 2]
    left = np.diff(np.concatenate([[0], np.cumsum(keep)])[first])
    return chosen(points, first, keep | np.repeat(left < 3, np.diff(first)))


def clipped(points: np.ndarray, first: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """`clip` for opened rings, one bound of all rings at a time."""
    for axis, bound, sign in ((0, low, 1), (0, high, -1), (1, low, 1), (1, high, -1)):
        size = np.diff(first)
        before = np.arange(-1, len(points) - 1)
        before[first[:-1][size > 0]] = first[1:][size > 0] - 1
        d = sign * (points[:, axis] - bound)
        inside = d >= 0
        crosses = inside != inside[before]
        count = crosses.astype(np.int64) + inside
        place = np.cumsum(count) - count
        out = np.empty((int(count.sum()), 2))
        p, q, dp, dq = points[crosses], points[before[crosses]], d[crosses], d[before[crosses]]
        out[place[crosses]] = q + (p - q) * (dq / (dq - dp))[:, None]
        out[(place + crosses)[inside]] = points[inside]
        first = np.concatenate([[0], np.cumsum(count)])[first]
        points, first = chosen(out, first, np.repeat(np.diff(first) >= 3, np.diff(first)))
    return points, first


def varints(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers that aren't negative, and where those of each piece (as first gives them) begin."""
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 63, 7):
        size += numbers >> bits > 0
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(numbers)), size)
    k = np.arange(len(owner)) - begin[owner]
    more = k + 1 < size[owner]
    return (numbers[owner] >> 7 * k & 127 | more * 128).astype(np.uint8), begin[first]


def geometries(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`geometry` of each ring alone: bytes, and where each ring's begin."""
    points = np.rint(points).astype(np.int64)
    size = np.diff(first)
    before = np.arange(-1, len(points) - 1)
    before[first[:-1][size > 0]] = first[1:][size > 0] - 1
    points, first = chosen(points, first, (points != points[before]).any(axis=1))
    points, first = chosen(points, first, np.repeat(np.diff(first) >= 3, np.diff(first)))
    size = np.diff(first)
    moves = np.diff(points, axis=0, prepend=np.zeros((1, 2), np.int64))
    begin = first[:-1][size > 0]
    moves[begin] = points[begin]
    # A ring of n points: move, one point, line, n - 1 points, close.
    length = np.where(size > 0, 2 * size + 3, 0)
    start = np.concatenate([[0], np.cumsum(length)])
    numbers = np.empty(start[-1], np.int64)
    some = start[:-1][size > 0]
    numbers[some], numbers[some + 3], numbers[some + length[size > 0] - 1] = 9, (size[size > 0] - 1) << 3 | 2, 15
    ring = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(points)) - first[ring]
    at = start[ring] + 1 + 2 * k + (k > 0)
    for axis in (0, 1):
        numbers[at + axis] = moves[:, axis] << 1 ^ moves[:, axis] >> 63
    return varints(numbers, start)


def drawing(zoom: int):
    """A kernel from (ring, x, y) to the drawing commands of a ring in a tile; null where no part of it is in the tile or its
    buffer."""

    @F.arrow_udf(T.BinaryType())
    def draw(ring: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        points, first, closed = opened(*rings_of(ring), np.ones(len(ring), bool))
        points, first = simplified(points, first, tile_tolerance(zoom))
        owner = np.repeat(np.arange(len(ring)), np.diff(first))
        points = project(points, zoom, x.to_numpy()[owner], y.to_numpy()[owner])
        points, first, _ = opened(points, first, ~closed)
        points, first = clipped(points, first, -BUFFER, EXTENT + BUFFER)
        data, begin = geometries(points, first)
        seen = np.packbits(np.diff(first) > 0, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), len(ring), [pa.py_buffer(b.tobytes()) for b in (seen, begin.astype(np.int32), data)])

    return draw


def build_tiles(buildings: DataFrame, zoom: int, most: int | None = None) -> DataFrame:
    """(x, y, n, tile) from buildings (id, ring of degrees, box xmin, ymin, xmax, ymax): every tile that a box touches. A
    tile draws all its boxes, the largest first, or the `most` largest. Rings are drawn in batches where they are read; as a
    tile is one value, its drawn rings meet in one task."""
    corners = tile_of(F.col("xmin"), F.col("ymax"), zoom), tile_of(F.col("xmax"), F.col("ymin"), zoom)
    placed = buildings.withColumn("_a", corners[0]).withColumn("_b", corners[1])
    wide = placed.withColumn("x", F.explode(F.sequence("_a.x", "_b.x"))).withColumn("y", F.explode(F.sequence("_a.y", "_b.y")))
    size = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    drawn = wide.select("x", "y", "id", size.alias("_size"), drawing(zoom)("ring", "x", "y").alias("_shape"))

    def together(keys: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_rank").filter(pc.is_valid(pc.field("_shape")))
        tile = encode(rows["id"].to_pylist(), rows["_shape"].to_pylist())
        return pa.table({"x": pa.array([keys[0].as_py()], pa.int32()), "y": pa.array([keys[1].as_py()], pa.int32()), "n": [rows.num_rows], "tile": pa.array([tile], pa.binary())})

    rows = top_per_group(drawn, ["x", "y"], [F.desc("_size"), F.asc("id")], most or (1 << 31) - 1, "_rank").drop("_size")
    return rows.groupBy("x", "y").applyInArrow(lambda k, t: together(k, t), "x int, y int, n long, tile binary")
