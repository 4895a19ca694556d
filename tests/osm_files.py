"""Writes small .osm.pbf files by the public format description."""

from __future__ import annotations

import bz2
import lzma
import zlib


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zig(n: int) -> int:
    return n << 1 ^ n >> 63


def message(*pairs) -> bytes:
    out = b""
    for field, value in pairs:
        out += varint(field << 3) + varint(value) if isinstance(value, int) else varint(field << 3 | 2) + varint(len(value)) + value
    return out


def numbers(values, signed=False, delta=False) -> bytes:
    values = list(values)
    if delta:
        values = [b - a for a, b in zip([0, *values], values)]
    return b"".join(varint(zig(v) if signed else v) for v in values)


class Strings:
    def __init__(self):
        self.all = [""]

    def __call__(self, text: str) -> int:
        if text not in self.all:
            self.all.append(text)
        return self.all.index(text)

    def table(self) -> bytes:
        return message(*[(1, s.encode()) for s in self.all])


def dense_group(s: Strings, nodes) -> bytes:
    """nodes: (id, lon, lat, tags)."""
    fixed = lambda v: round(v * 1e7)
    tags = [x for *_, t in nodes for x in [*[i for kv in t.items() for i in map(s, kv)], 0]]
    return message((2, message((1, numbers([n[0] for n in nodes], True, True)), (8, numbers([fixed(n[2]) for n in nodes], True, True)), (9, numbers([fixed(n[1]) for n in nodes], True, True)), (10, numbers(tags)))))


def plain_group(s: Strings, nodes) -> bytes:
    one = lambda i, lon, lat, t: message((1, zig(i)), (2, numbers(map(s, t))), (3, numbers(map(s, t.values()))), (8, zig(round(lat * 1e7))), (9, zig(round(lon * 1e7))))
    return message(*[(1, one(*n)) for n in nodes])


def way_group(s: Strings, ways) -> bytes:
    """ways: (id, refs, tags)."""
    return message(*[(3, message((1, i), (2, numbers(map(s, t))), (3, numbers(map(s, t.values()))), (8, numbers(refs, True, True)))) for i, refs, t in ways])


def relation_group(s: Strings, relations) -> bytes:
    """relations: (id, [(type, ref, role)], tags)."""
    one = lambda i, m, t: message((1, i), (2, numbers(map(s, t))), (3, numbers(map(s, t.values()))), (8, numbers(s(r) for *_, r in m)), (9, numbers([r for _, r, _ in m], True, True)), (10, numbers("nwr".index(k) for k, *_ in m)))
    return message(*[(4, one(*r)) for r in relations])


def blob(kind: str, data: bytes, packing: str = "zlib") -> bytes:
    body = {"raw": lambda: message((1, data)), "zlib": lambda: message((2, len(data)), (3, zlib.compress(data))), "lzma": lambda: message((2, len(data)), (4, lzma.compress(data))), "bz2": lambda: message((2, len(data)), (5, bz2.compress(data)))}[packing]()
    head = message((1, kind.encode()), (3, len(body)))
    return len(head).to_bytes(4, "big") + head + body


def block(group, objects, packing="zlib", **scale) -> bytes:
    s = Strings()
    made = group(s, objects)
    return blob("OSMData", message((1, s.table()), (2, made), *[({"granularity": 17, "lat_offset": 19, "lon_offset": 20}[k], v) for k, v in scale.items()]), packing)


def header(*features: str) -> bytes:
    return blob("OSMHeader", message(*[(4, f.encode()) for f in ("OsmSchema-V0.6", "DenseNodes", *features)]))
