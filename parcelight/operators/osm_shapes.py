"""Geometry of OpenStreetMap objects: points of ways by a join with the nodes, rings of relations from their ways.

Objects are rows as the PBF source gives them (or its Parquet form): osm_type, osm_id, tags, lon, lat, refs, members. Only
the ways that are asked for meet the nodes, as an equi-join on the node's number. An object's own points are one value. All
joins merge: what is exploded from packed rows is far larger than Spark's estimate, and would be broadcast through the driver.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar, planar_batch
from ..functions.shapes import POINT, POLYGONS, XY, column_of, unnested, values_of
from ..functions.text import blank
from .ranking import best_per_key

#: Steps of a degree in which the format stores places.
STEPS = 10_000_000


def kind(objects: DataFrame, osm_type: str) -> DataFrame:
    return objects.filter(F.col("osm_type") == osm_type)


def tag_text(key: str) -> Column:
    return F.trim(blank(F.try_element_at("tags", F.lit(key))))


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways (one row an osm_id) with `line`, their points in order; null where a node is missing. Repeated nodes (of files
    that overlap) count once."""
    refs = ways.select("osm_id", F.posexplode("refs").alias("pos", "ref"))
    at = nodes.filter("lon is not null and lat is not null").select(F.col("osm_id").alias("ref"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"))
    found = refs.join(at.hint("merge"), "ref").groupBy("osm_id", "pos").agg(F.min("p").alias("p"))
    lines = found.groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("_points"))
    whole = F.when(F.size("_points") == F.size("refs"), F.transform("_points", lambda q: q["p"]))
    return ways.join(lines.hint("merge"), "osm_id", "left").withColumn("line", whole).drop("_points")


def _steps(line: np.ndarray) -> np.ndarray:
    return np.rint(line * STEPS).astype(np.int64)


def _degrees(polygons: list[list[np.ndarray]] | None) -> list | None:
    return [[planar.closed(ring) / STEPS for ring in polygon] for polygon in polygons] if polygons else None


@F.arrow_udf(POLYGONS)
def assembled(lines: pa.Array) -> pa.Array:
    """Polygons from lines in any order and direction; null where a line is, or where they don't close or cross."""
    (rows, null), (offsets, missing) = (levels := unnested(lines))[0]
    used = np.arange(rows[0], rows[-1])
    owner, size = np.repeat(np.arange(len(lines)), np.diff(rows)), np.diff(offsets)[used].astype(np.int64)
    null = null | (np.bincount(owner, missing[used], len(lines)) > 0)
    line, at = planar_batch.places(size)
    rings, fine = planar_batch.joined_ways(_steps(levels[1][offsets[used][line] + at]), size, owner, len(lines))
    rings = rings.where((fine & ~null)[rings.owner])
    return planar_batch.column_of(replace(rings, points=rings.points / STEPS), null | ~fine)


@F.arrow_udf(POLYGONS)
def simple_ring(lines: pa.Array) -> pa.Array:
    """A closed line of four points or more that meets itself nowhere, as a polygon; else null."""
    return column_of([_degrees([[ring]]) if (ring := planar.simple_ring(_steps(line)) if line is not None else None) is not None else None for line in values_of(lines)])


@F.arrow_udf(POINT)
def line_centre(lines: pa.Array) -> pa.Array:
    """The mean of a line's sides by their lengths; of a line without length, its first point."""
    out = []
    for p in values_of(lines):
        sides = np.hypot(*np.diff(p, axis=0).T) if p is not None and len(p) > 1 else np.zeros(0)
        if sides.sum():
            p = ((p[1:] + p[:-1]) / 2 * sides[:, None]).sum(axis=0, keepdims=True) / sides.sum()
        out.append({"x": p[0, 0], "y": p[0, 1]} if p is not None and len(p) else None)
    return pa.array(out, XY)


def closed_ways(objects: DataFrame, wanted: Column) -> DataFrame:
    """The wanted ways whose first and last node are one, with `line`."""
    ways = kind(objects, "w").filter(wanted & (F.get("refs", F.lit(0)) == F.element_at("refs", -1))).select("osm_id", "tags", "refs").dropDuplicates(["osm_id"])
    return way_lines(ways, kind(objects, "n"))


def way_areas(objects: DataFrame, wanted: Column) -> DataFrame:
    """osm_id, tags and polygons of closed ways that are areas: of four nodes or more, not tagged area=no."""
    found = closed_ways(objects, wanted & (F.size("refs") > 3) & (F.coalesce(F.try_element_at("tags", F.lit("area")), F.lit("")) != "no"))
    return found.select("osm_id", "tags", assembled(F.array("line")).alias("polygons")).filter("polygons is not null")


def relation_areas(objects: DataFrame, wanted: Column) -> DataFrame:
    """osm_id, tags and polygons of the wanted multipolygons and boundaries. Relations with a way that isn't there, or whose
    rings don't close, have no row."""
    areas = F.try_element_at("tags", F.lit("type")).isin("multipolygon", "boundary")
    relations = kind(objects, "r").filter(wanted & areas).select("osm_id", "tags", "members").dropDuplicates(["osm_id"])
    member = relations.select(F.col("osm_id").alias("relation"), F.explode("members").alias("m")).filter("m.type = 'w'").select("relation", F.col("m.ref").alias("osm_id")).distinct()
    ways = kind(objects, "w").select("osm_id", "refs").join(member.select("osm_id").distinct().hint("merge"), "osm_id", "left_semi").dropDuplicates(["osm_id"])
    lines = member.join(way_lines(ways, kind(objects, "n")).select("osm_id", "line").hint("merge"), "osm_id", "left")
    together = lines.groupBy(F.col("relation").alias("osm_id")).agg(F.collect_list("line").alias("_lines"), F.count("*").alias("_n"))
    whole = relations.join(together.filter(F.size("_lines") == F.col("_n")).hint("merge"), "osm_id")
    return whole.select("osm_id", "tags", assembled("_lines").alias("polygons")).filter("polygons is not null")


def areas(objects: DataFrame, wanted: Column) -> DataFrame:
    """from_way, area_id (twice the way's number, twice the relation's and one), osm_id, tags and polygons."""
    ways, relations = (f(objects, wanted) for f in (way_areas, relation_areas))
    row = lambda df, way: df.select(F.lit(way).alias("from_way"), (2 * F.col("osm_id") + (0 if way else 1)).alias("area_id"), "osm_id", "tags", "polygons")
    return row(ways, True).union(row(relations, False))


def polygons_of_objects(objects: DataFrame, wanted: Column) -> DataFrame:
    """osm_type, osm_id, tags and polygons as an import of both ways and areas gives them: a closed way by its own number
    and, as every area, once more by its area number under `r`."""
    ways = closed_ways(objects, wanted).select(F.lit("w").alias("osm_type"), "osm_id", "tags", simple_ring("line").alias("polygons")).filter("polygons is not null")
    return ways.union(areas(objects, wanted).select(F.lit("r").alias("osm_type"), F.col("area_id").alias("osm_id"), "tags", "polygons"))


def area_objects(objects: DataFrame, wanted: Column) -> DataFrame:
    """osm_type, osm_id, tags and polygons as an import of areas alone gives them, under the area's number."""
    return areas(objects, wanted).select(F.when(F.col("from_way"), "w").otherwise("r").alias("osm_type"), F.col("area_id").alias("osm_id"), "tags", "polygons")


def points_of_objects(objects: DataFrame, wanted: Column) -> DataFrame:
    """osm_type, osm_id, tags, lon and lat: nodes, and closed ways by the centre of their line."""
    nodes = kind(objects, "n").filter(wanted & F.col("lon").isNotNull()).select("osm_type", "osm_id", "tags", "lon", "lat")
    ways = closed_ways(objects, wanted).filter("line is not null").select(F.lit("w").alias("osm_type"), "osm_id", "tags", line_centre("line").alias("_c"))
    both = nodes.union(ways.select("osm_type", "osm_id", "tags", F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat")))
    return best_per_key(both, ["osm_type", "osm_id"], [F.asc("lon"), F.asc("lat")])
