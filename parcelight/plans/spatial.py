"""Spatial joins over boxes made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial as S
from ..functions.text import round_half_up
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()

_SQL_BOXES = """b AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 9000)::DOUBLE AS bxmin, (o_custkey * 53 % 9000)::DOUBLE AS bymin,
      (o_orderkey * 37 % 9000 + 10 + o_orderkey % 41)::DOUBLE AS bxmax, (o_custkey * 53 % 9000 + 8 + o_orderkey % 37)::DOUBLE AS bymax FROM orders),
    p AS (SELECT p_partkey AS pid, (p_partkey % 90 * 100)::DOUBLE AS pxmin, (p_partkey // 90 % 90 * 100)::DOUBLE AS pymin,
      (p_partkey % 90 * 100 + 60 + p_size)::DOUBLE AS pxmax, (p_partkey // 90 % 90 * 100 + 50 + p_size)::DOUBLE AS pymax FROM part)"""
_SQL_AREA = "greatest(0, least(bxmax, pxmax) - greatest(bxmin, pxmin)) * greatest(0, least(bymax, pymax) - greatest(bymin, pymin))"


def boxes(spark, sf_dir):
    """Orders as buildings and parts as parcels."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    x, y, k = F.col("o_orderkey") * 37 % 9000, F.col("o_custkey") * 53 % 9000, F.col("o_orderkey")
    b = o.select(k.alias("id"), *[v.cast("double").alias(n) for n, v in (("bxmin", x), ("bymin", y), ("bxmax", x + 10 + k % 41), ("bymax", y + 8 + k % 37))])
    x, y, s = F.col("p_partkey") % 90 * 100, F.floor(F.col("p_partkey") / 90) % 90 * 100, F.col("p_size")
    return b, p.select(F.col("p_partkey").alias("pid"), *[v.cast("double").alias(n) for n, v in (("pxmin", x), ("pymin", y), ("pxmax", x + 60 + s), ("pymax", y + 50 + s))])


@query(f"WITH {_SQL_BOXES} SELECT id, pid, {_SQL_AREA} AS overlap_m2 FROM b JOIN p ON bxmin <= pxmax AND pxmin <= bxmax AND bymin <= pymax AND pymin <= bymax WHERE {_SQL_AREA} >= 50")
def box_overlap_join(spark, sf_dir):
    b, p = boxes(spark, sf_dir)
    return S.overlap_join(b, p, "b", "p", 128.0, 50.0).select("id", "pid", "overlap_m2")


@query(f"""
    WITH {_SQL_BOXES}, j AS (SELECT id, pid, {_SQL_AREA} AS a, row_number() OVER (PARTITION BY id ORDER BY {_SQL_AREA} DESC, pid) AS rn
      FROM b JOIN p ON bxmin <= pxmax AND pxmin <= bxmax AND bymin <= pymax AND pymin <= bymax WHERE {_SQL_AREA} > 0)
    SELECT b.id, pid, a AS overlap_m2, CASE WHEN coalesce(a, 0) <= 0 THEN 'unmatched' WHEN a < 200 THEN 'low_overlap' ELSE 'matched' END AS status
    FROM b LEFT JOIN (SELECT * FROM j WHERE rn = 1) j ON j.id = b.id
""")
def box_best_overlap(spark, sf_dir):
    from ..operators.filters import overlap_status

    b, p = boxes(spark, sf_dir)
    found = S.best_overlap(b, p, "b", "p", 128.0, ["id"], ["pid"])
    return found.select("id", "pid", "overlap_m2", overlap_status(F.col("overlap_m2"), 200.0).alias("status"))


@query(f"""
    WITH {_SQL_BOXES} SELECT id FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE bxmin <= pxmax AND pxmin <= bxmax AND bymin <= pymax AND pymin <= bymax
      AND {_SQL_AREA} >= 0.5 * least((bxmax - bxmin) * (bymax - bymin), (pxmax - pxmin) * (pymax - pymin)))
""")
def box_antijoin_ratio(spark, sf_dir):
    b, p = boxes(spark, sf_dir)
    return S.without_covered(b, p, "b", "p", 128.0, ["id"]).select("id")


@query(f"WITH {_SQL_BOXES} SELECT id, pid FROM b JOIN p ON (bxmin + bxmax) / 2 > pxmin AND (bxmin + bxmax) / 2 < pxmax AND (bymin + bymax) / 2 > pymin AND (bymin + bymax) / 2 < pymax")
def points_in_parcels(spark, sf_dir):
    b, p = boxes(spark, sf_dir)
    points = b.select("id", ((F.col("bxmin") + F.col("bxmax")) / 2).alias("x"), ((F.col("bymin") + F.col("bymax")) / 2).alias("y"))
    return S.points_in_boxes(points, p, "x", "y", "p", 128.0).select("id", "pid")


@query(f"""
    WITH {_SQL_BOXES} SELECT id, pid, round(d, 6) AS distance_m FROM (
      SELECT b.id, pid, d, row_number() OVER (PARTITION BY b.id ORDER BY d NULLS LAST, pid) AS rn FROM b LEFT JOIN (
        SELECT b.id, pid, sqrt((bxmin - pxmin) * (bxmin - pxmin) + (bymin - pymin) * (bymin - pymin)) AS d FROM b JOIN p ON abs(bxmin - pxmin) <= 64 AND abs(bymin - pymin) <= 64) n
      ON n.id = b.id AND d <= 64) WHERE rn = 1
""")
def knn_nearest(spark, sf_dir):
    b, p = boxes(spark, sf_dir)
    found = S.nearest_within(b.select("id", "bxmin", "bymin"), p.select("pid", "pxmin", "pymin"), "bxmin", "bymin", "pxmin", "pymin", 64.0, ["id"], [F.asc("pid")])
    return found.select("id", "pid", round_half_up("distance_m", 6).alias("distance_m"))


@query(f"""
    WITH {_SQL_BOXES}, a AS (SELECT * FROM p WHERE pid % 7 = 0),
    g AS (SELECT p.pid FROM p JOIN a ON sqrt(pow(greatest(0, p.pxmin - a.pxmax, a.pxmin - p.pxmax), 2) + pow(greatest(0, p.pymin - a.pymax, a.pymin - p.pymax), 2)) <= 5)
    SELECT DISTINCT pid FROM g WHERE pid NOT IN (SELECT pid FROM a)
""")
def adjacent_parcels(spark, sf_dir):
    _, p = boxes(spark, sf_dir)
    return S.adjacent(p, p.filter("pid % 7 = 0"), "p", 5.0, ["pid"], 128.0).select("pid")


@query("""
    WITH c AS (SELECT c_custkey, 43 + c_acctbal / 4000 AS lat, c_nationkey / 3.0 - 2 AS lng FROM customer)
    SELECT c_custkey, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(46.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(46.5)) * pow(sin(radians(3 - lng) / 2), 2))), 3) AS metres,
      round(greatest(0, least(0.99, 0.99 - 0.005 * (c_acctbal / 100))), 6) AS score
    FROM c JOIN customer USING (c_custkey)
""")
def distances(spark, sf_dir):
    lat, lng = 43 + F.col("c_acctbal") / 4000, F.col("c_nationkey") / 3.0 - 2
    return table(spark, sf_dir, "customer").select("c_custkey", round_half_up(geo.haversine_m(lat, lng, F.lit(46.5), F.lit(3.0)), 3).alias("metres"), round_half_up(geo.distance_score(F.col("c_acctbal") / 100), 6).alias("score"))


@query(f"""
    WITH {_SQL_BOXES} SELECT id, (bxmax - bxmin) * (bymax - bymin) AS area_m2, (bxmin + bxmax) / 2 AS cx, (bymin + bymax) / 2 AS cy, true AS holds_centre,
      round(2.0 * ((bxmax - bxmin) * (bymax - bymin)) / 2, 6) AS shoelace_m2 FROM b
""")
def ring_measures(spark, sf_dir):
    b, _ = boxes(spark, sf_dir)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("bxmin", "bymin"), corner("bxmax", "bymin"), corner("bxmax", "bymax"), corner("bxmin", "bymax"))
    rows = b.select("id", geo.box_area("b").alias("area_m2"), ring.alias("ring")).withColumn("centre", geo.area_centroid(F.col("ring")))
    return rows.select(
        "id",
        "area_m2",
        round_half_up("centre.x", 6).alias("cx"),
        round_half_up("centre.y", 6).alias("cy"),
        geo.point_in_ring(F.col("centre.x"), F.col("centre.y"), F.col("ring")).alias("holds_centre"),
        round_half_up(geo.ring_area(F.col("ring")), 6).alias("shoelace_m2"),
    )


@query()
def lambert93_round_trip(spark, sf_dir):
    lat, lng = 43 + F.col("c_acctbal") / 4000, F.col("c_nationkey") / 3.0 - 2
    rows = table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lng.alias("lng"), geo.to_lambert93(lat, lng).alias("m"))
    back = geo.from_lambert93(F.col("m.x"), F.col("m.y"))
    return rows.select("c_custkey", round_half_up("m.x", 3).alias("x"), round_half_up("m.y", 3).alias("y"), F.abs(back["lat"] - F.col("lat")).alias("lat_error"), F.abs(back["lng"] - F.col("lng")).alias("lng_error"))


def _meet(a: str, b: str) -> str:
    return f"{a}xmin <= {b}xmax AND {b}xmin <= {a}xmax AND {a}ymin <= {b}ymax AND {b}ymin <= {a}ymax"


def _area(a: str, b: str) -> str:
    return f"(greatest(0, least({a}xmax, {b}xmax) - greatest({a}xmin, {b}xmin)) * greatest(0, least({a}ymax, {b}ymax) - greatest({a}ymin, {b}ymin)))"


def commune(spark, sf_dir):
    """Orders as buildings, parts as parcels, customers as registry entries, suppliers as land use."""
    b, p = boxes(spark, sf_dir)
    k = F.col("id")
    pick = lambda key, *v: F.get(F.array(*map(F.lit, v)), (key % len(v)).cast("int"))
    tags = F.create_map(F.lit("building"), pick(k, "yes", "shed", "school", ""), F.lit("amenity"), pick(k, "", "bank", "hospital", "", ""))
    b = b.withColumns(
        {"osm_type": pick(k, "w", "w", "r"), "osm_id": k, "tags": tags, "address_text": F.lit(None).cast("string"), "footprint_m2": geo.box_area("b"), "shape": F.concat_ws(",", "bxmin", "bymin", "bxmax", "bymax")}
    ).drop("id")
    p = p.select(F.lit("33318").alias("code_insee"), F.lit("AB").alias("section"), F.lpad(F.col("pid").cast("string"), 8, "0").alias("numero_norm"), "pxmin", "pymin", "pxmax", "pymax")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    x, y, n = F.col("c_custkey") * 71 % 9000, F.col("c_custkey") * 29 % 9000, F.col("c_custkey")
    r = c.select(F.concat(F.lit("c"), F.lpad(n.cast("string"), 9, "0")).alias("batiment_construction_id"), F.lit("g").alias("batiment_groupe_id"), (n % 200 + 1800).cast("int").alias("annee_construction"), pick(n, "Résidentiel collectif", None, "Tertiaire", "residentiel Individuel", "x").alias("usage"), *[v.cast("double").alias(w) for w, v in (("rxmin", x), ("rymin", y), ("rxmax", x + 40 + n % 60), ("rymax", y + 40 + n % 50))])
    x, y, n = F.col("s_suppkey") * 613 % 9000, F.col("s_suppkey") * 419 % 9000, F.col("s_suppkey")
    lu = s.select(pick(n, "retail", "residential", "Industrial", "forest").alias("landuse"), *[v.cast("double").alias(w) for w, v in (("lxmin", x), ("lymin", y), ("lxmax", x + 300 + n % 90), ("lymax", y + 300))])
    return b, p, r, lu


_PAIRS = f"""
    WITH {_SQL_BOXES},
    u AS (SELECT * FROM (SELECT b.*, CASE WHEN id % 3 = 2 THEN 'r' ELSE 'w' END AS t, (bxmax - bxmin) * (bymax - bymin) AS fp, row_number() OVER (PARTITION BY bxmin, bymin, bxmax, bymax ORDER BY CASE WHEN id % 3 = 2 THEN 0 ELSE 1 END, id) AS one FROM b) WHERE one = 1),
    r AS (SELECT 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS cid, 1800 + c_custkey % 200 AS yr, c_custkey % 5 AS k, (c_custkey * 71 % 9000)::DOUBLE AS rxmin, (c_custkey * 29 % 9000)::DOUBLE AS rymin, (c_custkey * 71 % 9000 + 40 + c_custkey % 60)::DOUBLE AS rxmax, (c_custkey * 29 % 9000 + 40 + c_custkey % 50)::DOUBLE AS rymax FROM customer),
    l AS (SELECT ['retail', 'residential', 'Industrial', 'forest'][1 + s_suppkey % 4] AS lu, (s_suppkey * 613 % 9000)::DOUBLE AS lxmin, (s_suppkey * 419 % 9000)::DOUBLE AS lymin, (s_suppkey * 613 % 9000 + 300 + s_suppkey % 90)::DOUBLE AS lxmax, (s_suppkey * 419 % 9000 + 300)::DOUBLE AS lymax FROM supplier),
    f AS (SELECT * FROM u WHERE fp >= 400 OR EXISTS (SELECT 1 FROM l WHERE lower(lu) IN ('retail', 'industrial', 'commercial') AND {_meet("b", "l")})),
    br AS (SELECT * FROM (SELECT id, cid, yr, {_area("b", "r")} AS ra, row_number() OVER (PARTITION BY id ORDER BY {_area("b", "r")} DESC, cid) AS o FROM f JOIN r ON {_meet("b", "r")} WHERE k NOT IN (0, 3) AND {_area("b", "r")} > 0) WHERE o = 1),
    bl AS (SELECT * FROM (SELECT id, lu, {_area("b", "l")} AS la, row_number() OVER (PARTITION BY id ORDER BY {_area("b", "l")} DESC, lu) AS o FROM f JOIN l ON {_meet("b", "l")} WHERE {_area("b", "l")} > 0) WHERE o = 1)
    SELECT t || ':' || f.id AS osm_building_id, lpad(pid::VARCHAR, 8, '0') AS numero_norm, fp AS footprint_m2, {_area("b", "p")} AS intersection_area_m2,
      CASE WHEN coalesce(ra, 0) <= 0 THEN 'unmatched' WHEN ra < 20 THEN 'low_overlap' ELSE 'matched' END AS osm_match_status, CASE WHEN ra >= 20 THEN cid END AS construction, CASE WHEN ra >= 20 THEN yr::INT END AS year, la AS landuse_m2,
      CASE WHEN lower(lu) IN ('retail', 'industrial') THEN lower(lu) WHEN f.id % 5 = 2 THEN 'hospital' WHEN lu IS NOT NULL THEN lu WHEN f.id % 4 = 1 THEN 'shed' WHEN f.id % 4 = 2 THEN 'education' ELSE '' END AS zone_tag
    FROM f JOIN p ON {_meet("b", "p")} LEFT JOIN br ON br.id = f.id LEFT JOIN bl ON bl.id = f.id WHERE {_area("b", "p")} >= 50
"""


def _pairs(found):
    return found.select("osm_building_id", "numero_norm", "footprint_m2", "intersection_area_m2", "osm_match_status", F.col("batiment_construction_id").alias("construction"), F.col("annee_construction").alias("year"), F.col("landuse_intersection_area_m2").alias("landuse_m2"), "zone_tag")


@query(_PAIRS)
def building_parcel_pairs(spark, sf_dir):
    from ..operators.features import building_parcel_pairs as pairs

    return _pairs(pairs(*commune(spark, sf_dir)))


def slanted(df, p: str):
    """Boxes pushed sideways by half their height: parallelograms of the same areas and common areas, in wider boxes."""
    corner = lambda x, y: F.struct((F.col(p + x) + F.col(p + y) / 2).alias("x"), F.col(p + y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    rings = df.withColumn(p + "polygon", F.array(ring))
    return rings.withColumns({p + "xmin": F.col(p + "xmin") + F.col(p + "ymin") / 2, p + "xmax": F.col(p + "xmax") + F.col(p + "ymax") / 2})


@query(_PAIRS)
def polygon_parcel_pairs(spark, sf_dir):
    from ..operators.features import building_parcel_pairs as pairs

    return _pairs(pairs(*[slanted(df, p) for df, p in zip(commune(spark, sf_dir), "bprl")]))


@query(f"""
    WITH {_SQL_BOXES} SELECT id FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE bxmin <= pxmax AND pxmin <= bxmax AND bymin <= pymax AND pymin <= bymax
      AND {_SQL_AREA} >= 0.5 * least((bxmax - bxmin) * (bymax - bymin), (pxmax - pxmin) * (pymax - pymin)))
""")
def polygon_antijoin_ratio(spark, sf_dir):
    b, p = boxes(spark, sf_dir)
    return S.without_covered(slanted(b, "b"), slanted(p, "p"), "b", "p", 128.0, ["id"], exact=True).select("id")


@query()
def vector_tiles(spark, sf_dir):
    from ..operators.tiles import build_tiles

    b, _ = boxes(spark, sf_dir)
    corner = lambda x, y: F.struct((F.col(x) / 90_000).alias("x"), (44 + F.col(y) / 90_000).alias("y"))
    ring = F.array(corner("bxmin", "bymin"), corner("bxmax", "bymin"), corner("bxmax", "bymax"), corner("bxmin", "bymax"))
    shapes = b.select(F.concat(F.lit("w:"), F.col("id").cast("string")).alias("id"), ring.alias("ring"), *[(F.col("b" + c) / 90_000 + d).alias(c) for c, d in (("xmin", 0), ("ymin", 44), ("xmax", 0), ("ymax", 44))])
    return build_tiles(shapes, 15).select("x", "y", "n", F.sha2("tile", 256).alias("tile_sha256"))
