"""Extracts written here: the PBF source, lines of ways, rings of relations and the four imports."""

import pytest
from pyspark.sql import functions as F

from parcelight.functions import planar
from parcelight.operators import osm_shapes as S
from parcelight.sources import osm_pbf, readers
from tests import osm_files as W


def square(first, x, y, size):
    """Four nodes from number `first` on, around a square in thousandths of a degree."""
    corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [(first + k, 2 + cx / 1000, 48 + cy / 1000, {}) for k, (cx, cy) in enumerate(corners)]


def ring(first):
    return [first, first + 1, first + 2, first + 3, first]


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    nodes = square(10, 0, 0, 10) + square(20, 2, 2, 4) + square(30, 20, 0, 5) + square(40, 40, 0, 4) + square(50, 60, 0, 6)
    nodes += [(60, 2.1, 48.1, {"shop": "bakery", "name": "Ô pain"}), (61, -1.5, -0.25, {"disused:shop": "x"}), (62, 2.2, 48.2, {"amenity": "bench"})]
    single = [(70, 2.3, 48.3, {"tourism": "museum"}), (71, -2.3, 48.3, {})]
    ways = [
        (100, [10, 11, 12], {}),
        (101, [10, 13, 12], {}),  # with 100: the ring of four corners
        (102, [20, 21, 22, 23, 20], {}),
        (103, ring(30), {"building": "yes", "addr:street": "Rue A", "addr:housenumber": "3"}),
        (104, [40, 42, 41, 43, 40], {"building": "yes"}),  # crosses itself
        (105, [30, 31, 999, 30], {"building": "yes"}),  # a node is missing
        (106, ring(40), {"leisure": "Pitch", "amenity": "parking"}),
        (107, [50, 51, 52, 53], {"landuse": "retail"}),  # open
        (108, ring(50), {"landuse": "Retail", "shop": "mall"}),
        (109, ring(50), {"building": "no", "amenity": "school", "area": "no"}),
    ]
    outer = [("w", 100, "outer"), ("w", 101, "outer")]
    relations = [
        (200, [*outer, ("w", 102, "inner"), ("n", 60, "label")], {"type": "multipolygon", "building": "retail"}),
        (201, [("w", 100, "outer")], {"type": "multipolygon", "building": "yes"}),  # stays open
        (202, [*outer, ("w", 777, "inner")], {"type": "multipolygon", "building": "yes"}),  # a way is missing
        (203, [*outer, ("w", 103, "")], {"type": "multipolygon", "landuse": "farmland"}),  # two parts
        (204, outer, {"type": "route", "building": "yes"}),
    ]
    parts = [W.header(), W.block(W.dense_group, nodes[:9], granularity=100), W.block(W.dense_group, nodes[9:], "raw"), W.block(W.plain_group, single, "bz2"), W.block(W.way_group, ways[:4], "lzma"), W.block(W.way_group, ways[4:]), W.block(W.relation_group, relations)]
    path = tmp_path_factory.mktemp("osm") / "a.osm.pbf"
    path.write_bytes(b"".join(parts))
    return path, nodes + single, ways, relations


def test_all_objects(spark, extract):
    path, nodes, ways, relations = extract
    df = osm_pbf.osm_objects(spark, str(path), 1)
    assert df.rdd.getNumPartitions() == 18
    got = {(r["osm_type"], r["osm_id"]): r for r in df.collect()}
    assert len(got) == len(nodes) + len(ways) + len(relations)
    for i, lon, lat, tags in nodes:
        assert (got["n", i]["lon"], got["n", i]["lat"], got["n", i]["tags"]) == (round(lon * 1e7) / 1e7, round(lat * 1e7) / 1e7, tags)
    assert all(got["w", i]["refs"] == refs and got["w", i]["tags"] == tags for i, refs, tags in ways)
    assert all([tuple(m) for m in got["r", i]["members"]] == m for i, m, _ in relations for m in [m])
    assert osm_pbf.osm_objects(spark, str(path.parent)).count() == len(got)
    assert osm_pbf.osm_objects(spark, f"file://{path}").count() == len(got)


def test_a_filter_leaves_one_scan(spark, extract):
    df = osm_pbf.osm_objects(spark, str(extract[0]))
    ways, nodes = df.filter("osm_type = 'w'"), df.filter("osm_type = 'n'")
    assert ways.count() == 10 and ways._jdf.queryExecution().optimizedPlan().toString().count("osm_pbf") == 1
    assert ways.select("osm_type").union(nodes.select("osm_type")).distinct().count() == 2
    reader = osm_pbf._Reader(str(extract[0]), 1, frozenset("w"))
    assert {b["osm_type"][0].as_py() for p in reader.partitions() for b in reader.read(p)} == {"w"}


def test_scale_and_bad_files(tmp_path, spark):
    path = tmp_path / "b.pbf"
    path.write_bytes(W.header() + W.block(W.dense_group, [(1, 0.0000005, 0.0000004, {})], granularity=1000, lat_offset=2_000_000_000, lon_offset=-1_000_000_000))
    (row,) = osm_pbf.osm_objects(spark, str(path)).collect()
    assert (row["lon"], row["lat"]) == ((-1_000_000_000 + 5000) // 100 / 1e7, (2_000_000_000 + 4000) // 100 / 1e7)
    path.write_bytes(W.header("HistoricalInformation"))
    with pytest.raises(Exception, match="HistoricalInformation"):
        osm_pbf.osm_objects(spark, str(path)).collect()
    path.write_bytes((W.header() + W.block(W.way_group, [(1, [1, 2], {})]))[:-3])
    with pytest.raises(Exception, match="cut off"):
        osm_pbf.osm_objects(spark, str(path)).collect()
    path.write_bytes(W.header())
    assert osm_pbf.osm_objects(spark, str(path)).collect() == []


@pytest.fixture(scope="module")
def objects(spark, extract):
    return osm_pbf.osm_objects(spark, str(extract[0]))


def areas_of(rows):
    shape = lambda ps: [[[(p["x"] * 1000, p["y"] * 1000) for p in r] for r in polygon] for polygon in ps]
    return {(r["osm_type"], r["osm_id"]): round(planar.area(shape(r["polygons"])), 6) for r in rows}


def test_buildings(objects):
    rows = readers.pbf_buildings(objects).collect()
    # A way by its own number and by its area's; the school's ground is no area.
    assert areas_of(rows) == {("w", 103): 25, ("r", 206): 25, ("r", 401): 84, ("w", 109): 36}
    assert {r["osm_id"]: r["kind"] for r in rows}[109] == "zone" and {r["address_text"] for r in rows if r["osm_id"] == 103} == {"3 Rue A"}
    holed = next(r for r in rows if r["osm_id"] == 401)["polygons"]
    assert [len(p) for p in holed] == [2]


def test_landuse_parking_and_points(objects):
    rows = readers.pbf_landuse(objects).collect()
    assert areas_of(rows) == {("w", 106): 16, ("r", 212): 16, ("w", 108): 36, ("r", 216): 36, ("r", 407): 125}
    assert {r["landuse"] for r in rows} == {"Pitch", "Retail", "farmland"}
    assert len(next(r for r in rows if r["osm_id"] == 407)["polygons"]) == 2
    assert areas_of(readers.pbf_parking(objects).collect()) == {("w", 212): 16}
    assert readers.pbf_parking(objects, ("landuse",)).count() == 0
    points = {(r["osm_type"], r["osm_id"]): (round(r["lon"], 6), round(r["lat"], 6)) for r in readers.pbf_pois(objects).collect()}
    assert points == {("n", 60): (2.1, 48.1), ("n", 70): (2.3, 48.3), ("w", 106): (2.042, 48.002), ("w", 108): (2.063, 48.003), ("w", 109): (2.063, 48.003)}
    assert readers.in_box(readers.pbf_pois(objects), (2.05, 48.0, 2.2, 48.2)).count() == 3


def test_files_that_overlap(objects):
    twice = objects.union(objects)
    assert areas_of(readers.pbf_buildings(twice).collect()) == areas_of(readers.pbf_buildings(objects).collect())


def test_parquet_form(objects, tmp_path, spark):
    objects.write.partitionBy("osm_type").parquet(f"{tmp_path}/o")
    stored = spark.read.parquet(f"{tmp_path}/o")
    assert areas_of(S.relation_areas(stored, F.lit(True)).withColumn("osm_type", F.lit("r")).collect()) == {("r", 200): 84, ("r", 203): 125}


def lines(*rings):
    import numpy as np

    return [np.array(r) for r in rings]


@pytest.mark.parametrize(
    "ways,shape",
    [
        (lines([(0, 0), (4, 0), (4, 4)], [(0, 0), (0, 4), (4, 4)]), [(16, 0)]),
        (lines([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]), [(15, 1)]),
        # An island in a hole, and a hole that touches the outer ring.
        (lines([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)], [(3, 3), (5, 3), (5, 5), (3, 5), (3, 3)]), [(4, 0), (32, 1)]),
        (lines([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (2, 1), (1, 2), (0, 0)]), [(14.5, 1)]),
        # Two that touch in a corner; two with a common side, which is no border.
        (lines([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]), [(4, 0), (4, 0)]),
        (lines([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(2, 0), (4, 0), (4, 2), (2, 2), (2, 0)]), [(8, 0)]),
        (lines([(0, 0), (4, 0), (4, 4)]), None),
        (lines([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]), None),
        (lines([(0, 0), (4, 0), (0, 0)]), None),
        (lines(), None),
    ],
)
def test_rings(ways, shape):
    got = planar.joined_ways(ways)
    assert (None if got is None else sorted((planar.area([p]), len(p) - 1) for p in got)) == shape
