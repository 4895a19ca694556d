"""The matcher's pipeline over a synthetic commune of boxes, and labels and candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelight.functions import energy as E
from parcelight.functions import geo, labels, planar
from parcelight.operators import combos, features, resolution

BOX = "{0}xmin double, {0}ymin double, {0}xmax double, {0}ymax double"


@pytest.fixture(scope="module")
def commune(spark):
    """Cells of 100 m; buildings inside one cell, over two, over four, touching only, doubled, and too small."""
    parcels = [("33318", "AB", f"{10 * j + i:04d}", 100.0 * i, 100.0 * j, 100.0 * i + 100, 100.0 * j + 100) for j in range(4) for i in range(4)] + [("33318", "AB", " ", 0.0, 0.0, 100.0, 100.0)]
    buildings = [
        ("w", 1, {"building": "yes"}, "1 rue A", 10, 10, 40, 40),
        ("w", 2, {"building": "warehouse"}, None, 150, 110, 250, 130),
        ("w", 3, {"building": "yes"}, None, 80, 280, 120, 320),
        ("w", 4, {"building": "yes"}, None, 310, 10, 330, 30),
        ("w", 5, {"building": "yes"}, None, 350, 350, 360, 360),
        ("w", 6, {"building": "shop"}, None, 310, 210, 320, 220),
        ("r", 9, {"building": "yes"}, "2 rue A", 10, 10, 40, 40),
    ]
    rows = [(t, n, tags, a, float((x2 - x1) * (y2 - y1)), f"{x1},{y1},{x2},{y2}", *map(float, (x1, y1, x2, y2))) for t, n, tags, a, x1, y1, x2, y2 in buildings]
    registry = [("c1", "g1", 1987, None, 10.0, 10.0, 30.0, 40.0), ("c2", "g2", 2001, "Résidentiel individuel", 10.0, 10.0, 40.0, 40.0), ("c3", "g3", 1999, "Tertiaire", 150.0, 110.0, 150.5, 130.0)]
    landuse = [("retail", 300.0, 200.0, 400.0, 300.0), ("Industrial", 100.0, 100.0, 300.0, 140.0), ("residential", 100.0, 100.0, 300.0, 120.0)]
    owners = [("33318", "AB", "0011", "432758597", "d", "a")] * 2 + [("33318", "AB", "0012", "432758597", "d", "a"), ("33318", "AB", "0000", "111111111", "d", "b")]
    return (
        spark.createDataFrame(rows, "osm_type string, osm_id long, tags map<string,string>, address_text string, footprint_m2 double, shape string, " + BOX.format("b")),
        spark.createDataFrame(parcels, "code_insee string, section string, numero_norm string, " + BOX.format("p")),
        spark.createDataFrame(registry, "batiment_construction_id string, batiment_groupe_id string, annee_construction int, usage string, " + BOX.format("r")),
        spark.createDataFrame(landuse, "landuse string, " + BOX.format("l")),
        spark.createDataFrame(owners, "code_insee string, section string, numero_norm string, siren string, denomination string, address string"),
    )


def test_pairs(commune):
    buildings, parcels, registry, landuse, _ = commune
    rows = features.building_parcel_pairs(buildings, parcels, registry, landuse).collect()
    got = {(r["osm_building_id"], r["numero_norm"]): r for r in rows}
    assert set(got) == {("r:9", "0000"), ("w:2", "0011"), ("w:2", "0012"), ("w:3", "0020"), ("w:3", "0021"), ("w:3", "0030"), ("w:3", "0031"), ("w:4", "0003"), ("w:6", "0023")}
    first = got["r:9", "0000"]
    assert (first["intersection_area_m2"], first["batiment_construction_id"], first["annee_construction"], first["osm_match_status"]) == (900.0, "c1", 1987, "matched")
    assert (got["w:2", "0011"]["osm_match_status"], got["w:2", "0011"]["batiment_construction_id"], got["w:2", "0011"]["zone_tag"]) == ("low_overlap", None, "industrial")
    assert got["w:2", "0012"]["intersection_area_m2"] == 1000.0 and got["w:6", "0023"]["zone_source"] == "landuse"


def test_features(commune):
    buildings, parcels, registry, landuse, owners = commune
    pairs = features.building_parcel_pairs(buildings, parcels, registry, landuse).cache()
    rows = {r["numero_norm"]: r for r in features.parcel_features(pairs, owners).collect()}
    assert rows["0011"]["footprint_sum_m2"] == 2000.0 and rows["0011"]["zone_tag"] == "industrial" and rows["0011"]["sirens"] == ["432758597"]
    assert rows["0000"]["scout_v5_id"] == "parcelle:33318:AB:0000" and rows["0000"]["owner_status"] == "single"
    assert rows["0020"]["shared_candidate"] and rows["0020"]["owner_status"] == "none"
    assert set(rows) == {"0000", "0011", "0012", "0020", "0021", "0030", "0031", "0023"}  # 0003 has just 400, 0023 a waiver
    shared = {r["building_id"]: r["n_parcels"] for r in features.building_features(pairs).collect()}
    assert shared == {"w:2": 2, "w:3": 4}
    decided = resolution.resolve_shared_buildings(pairs, resolution.owners_by_parcel(owners)).collect()
    assert {r["building_id"]: (r["matching_decision"], r["numero_norm"]) for r in decided} == {"w:2": ("shared_siren", "0012"), "w:3": ("unique_by_intersection", "0031")}


def test_addresses_shown(spark):
    df = spark.createDataFrame([("a", "b", "c", True, "d", True), (None, "b", "c", True, "d", True), ("", "", "c", True, "d", True), ("", None, "c", False, " d ", True), (None, None, None, True, "d", False)], "o string, e string, p string, ps boolean, r string, ra boolean")
    got = [tuple(r[0]) for r in df.select(features.display_address(*map(F.col, df.columns))).collect()]
    assert got == [("a", "osm"), ("b", "sirene"), ("c", "ppm"), ("d", "ban_reverse"), ("", "none")]
    hits = spark.createDataFrame([(["12"], ["12", "14"], 500.0, True), (["12"], [], 80.0, True), (["12"], [], 81.0, True), ([], ["12"], 1.0, True), (["12"], ["12"], 1.0, False)], "n array<string>, h array<string>, m double, a boolean")
    assert [r[0] for r in hits.select(features.corroborated(*map(F.col, hits.columns))).collect()] == [True, True, False, False, False]


def test_labels(spark):
    tags = [{"addr:housenumber": "12", "addr:street": "rue A", "addr:postcode": "33600", "addr:city": "Pessac", "addr:country": "FR"}, {"addr:full": "x"}, {"addr:place": "P", "addr:unit": "3", "addr:country": "ES"}, {"contact:address": "c"}, {}]
    df = spark.createDataFrame([(t,) for t in tags], "t map<string,string>")
    assert [r[0] for r in df.select(labels.osm_address("t")).collect()] == ["12 rue A, 33600 Pessac", "x", "P, 3, ES", "c", ""]
    names = spark.createDataFrame([("Boulangerie Dupont SARL", "SARL DUPONT ET FILS", "Pessac"), ("Le Service France SAS", "SERVICE FRANCE", ""), ("Pessac Auto S.A.", "PESSAC", "Pessac")], "a string, b string, c string")
    got = names.select(labels.without_legal_form("a"), labels.name_tokens("a", "c"), labels.shares_token("a", "b", "c")).collect()
    assert [tuple(r) for r in got] == [("boulangerie dupont", ["boulangerie", "dupont"], True), ("le service france", [], False), ("pessac auto", ["auto"], False)]
    assert [r[0] for r in spark.createDataFrame([("12 av. Foch",), ("bd de l'Imp. X",)], "s string").select(labels.street_line("s")).collect()] == ["12 avenue foch", "boulevard de l'impasse x"]


def test_candidate_scores(spark):
    df = spark.createDataFrame([(0.5, "Dupont", "DUPONT SA", "", "10 av. Foch", "10 AVENUE FOCH 33600 PESSAC", "33600", "33600", 44.8, -0.6, 44.8, -0.6), (0.4, "Dupont", "X", "", None, "y", "1", "2", 44.8, -0.6, 45.8, -0.6)], "l double, n string, o string, c string, s string, a string, p string, q string, lat double, lng double, lat2 double, lng2 double")
    assert [r[0] for r in df.select(labels.candidate_score(*map(F.col, df.columns))).collect()] == [230 + 380 + 270 + 100, 100]
    types = spark.createDataFrame([(["store", "route"], 0.0, True), (None, 30.0, False), (["political"], 0.0, False)], "t array<string>, m double, i boolean")
    assert [round(r[0], 4) for r in types.select(labels.relevance(F.col("m"), F.col("t"), F.col("i"))).collect()] == [round(0.62 + 0.38 * 1.2 + 0.2, 4), round(0.31 + 0.38 * 0.55, 4), round(0.62 + 0.19, 4)]


def test_people_and_companies(spark):
    raw = spark.createDataFrame([(("Ann", None, "x", "a@b", "VALID", [(None, " "), (None, "12")]),), ((None, " ", None, None, None, None),)], "r struct<first_name:string,last_name:string,name:string,email:string,email_status:string,phone_numbers:array<struct<sanitized_number:string,raw_number:string>>>")
    got = [r[0] for r in raw.select(labels.person(F.col("r"))).collect()]
    assert (got[0]["full_name"], got[0]["email_status"], got[0]["phone"]) == ("Ann", "verified", "12") and got[1] is None
    kind = "struct<siret:string,adresse:string,code_postal:string>"
    rows = [("q", 0, ("A", "1", "N", ("s1", "a", "1"), [("s2", "b", None), ("s1", "again", "1")])), ("q", 1, ("C", "2", "M", ("s3", "c", "1"), None)), ("q", 2, (None, "3", None, ("s2", "late", "1"), None))]
    df = spark.createDataFrame(rows, f"query_id string, pos int, company struct<etat_administratif:string,siren:string,nom_complet:string,siege:{kind},matching_etablissements:array<{kind}>>")
    assert sorted((r["siret"], r["address"]) for r in features.flatten_companies(df).collect()) == [("s1", "a"), ("s2", "b")]


def test_profiles_and_sizing(spark):
    row = spark.range(1).select(E.monthly_breakdown(F.lit(120.0)).alias("m"), E.hourly_breakdown(F.lit(365.0)).alias("h"), E.per_kwp(F.lit(None).cast("double"), F.lit(12000.0), F.lit(10.0)).alias("p"), E.per_kwp(F.lit(0.0), F.lit(50000.0), F.lit(10.0)).alias("q"), E.production_day(F.lit(310.0), 0, F.lit(2.0)).alias("d")).head()
    assert sum(row["m"]) == pytest.approx(120, abs=0.3) and sum(row["h"]) == pytest.approx(1, abs=0.01)
    assert row["p"] == 1200.0 and row["q"] is None and sum(row["d"]) == pytest.approx(20, abs=0.05)
    targets = spark.createDataFrame([(1, 7.0, 100.0), (2, 26.0, 0.0), (3, -1.0, 5000.0), (4, 10.0, 12.0)], "i int, t double, kw double")
    batteries = spark.createDataFrame([("small", 3.5, 4), ("large", 10.0, None)], "model string, capacity_kwh double, most int")
    inverters = spark.createDataFrame([("a", 10_000, False, 0), ("b", 50_000, False, 1), ("c", 20_000, True, 2)], "model string, power_w int, recommended boolean, ord int")
    got = E.pick_inverter(E.pick_battery(targets, batteries, "t"), inverters, "kw").orderBy("i").collect()
    assert [(r["battery_model"], r["battery_count"]) for r in got] == [("small", 2), ("large", 3), (None, None), ("large", 1)]
    assert [r["inverter_model"] for r in got] == ["c", "c", "a", "c"]


def test_simplification_and_samples():
    ring = np.array([(0, 0), (5, 0.001), (10, 0), (10, 10), (0, 10), (0, 0)], float)
    out = geo.simplify_ring(ring, 0.01)
    assert len(out) == 5 and (out[0] == out[-1]).all()
    assert (geo.simplify_ring(ring[:3], 100.0) == ring[:3]).all()
    assert [geo.tile_tolerance(z) for z in (18, 15, 12, 3)] == [0.0, 1e-7, 1e-6, 1e-5]
    for shape in (ring, ring[::-1]):
        points = planar.contour_points([[shape]])
        assert 4 <= len(points) <= 64 and (points > 0.4).all() and (points < 9.6).all()


def test_lookups(spark):
    parcels = spark.createDataFrame([("p1", ["b1"]), ("p2", ["b1", "b2"]), ("p3", ["b3"])], "p string, bs array<string>")
    anchors = spark.createDataFrame([("p1",)], "p string")
    assert sorted(r[0] for r in features.neighbours_by_building(parcels, anchors, "p", "bs").collect()) == ["p1", "p2"]
    c = spark.createDataFrame([("combo:b", ["p1"]), ("combo:a", ["p1", "p2"])], "combo_id string, parcelle_scout_v5_ids array<string>")
    assert {r["p"]: r["combo_id"] for r in features.combo_of_parcel(c, "p").collect()} == {"p1": "combo:a", "p2": "combo:a"}
    b = spark.createDataFrame([("x", 0.0, 0.0, 10.0, 10.0), ("y", 20.0, 0.0, 22.0, 2.0)], "bid string, bxmin double, bymin double, bxmax double, bymax double")
    pts = spark.createDataFrame([(1, 9.0, 9.0), (2, 18.0, 1.0), (3, 500.0, 500.0)], "id int, x double, y double")
    assert {r["id"]: r["bid"] for r in features.nearest_building(pts, b, 16.0, 25.0).collect()} == {1: "x", 2: "y", 3: None}
    scored = spark.createDataFrame([("g", "s1", 500), ("g", "s2", 400)], "g string, siren string, score int")
    own = spark.createDataFrame([("g", "s2")], "g string, siren string")
    assert [(r["siren"], r["rank"]) for r in features.owner_bonus(scored, own, "g", labels.OWNER_BONUS).orderBy("rank").collect()] == [("s2", 1), ("s1", 2)]
    marks = spark.createDataFrame([("c", 0.0, 0.0, 1.0, "a"), ("c", 4.0, 0.0, 3.0, "b")], "c string, x double, y double, area double, i string")
    assert features.weighted_centroid(marks, "c", "area").head()["x"] == 3.0 and features.component_markers(marks, "c", "i").head()["ids"] == ["a", "b"]
    means = spark.createDataFrame([("k", 10.0), ("k", 13.0), ("e", None)], "k string, v double")
    assert {r["k"]: r["mean"] for r in features.mean_by_category(means, "k", "v").collect()} == {"k": 12, "e": 170}
    assert combos.OSM_BUILDING


def test_address_context(spark):
    rows = [(" Dupont ", "ZAC de Bersol, 12 av. Foch, 33600 Pessac, France"), (None, "Pessac"), ("X", "33600 Pessac"), ("", None)]
    df = spark.createDataFrame(rows, "n string, a string").withColumn("c", labels.address_context("n", "a"))
    got = [(tuple(r["c"]), r["q"]) for r in df.select("c", labels.search_queries(F.col("c")).alias("q")).collect()]
    assert got[0] == (("Dupont", "Pessac", "33600", "12 av. Foch", "ZAC  Bersol"), ['"12 av. Foch" Pessac 33600', '"Dupont" Pessac 33600', '"Dupont" Pessac', '"ZAC  Bersol" Pessac'])
    assert got[1] == ((None, None, None, None, None), []) and got[2] == (("X", "Pessac", "33600", None, None), ['"X" Pessac 33600', '"X" Pessac']) and got[3][1] == []


def test_sectors(spark):
    df = spark.createDataFrame([("Retail", "bank"), ("forest", " Bank"), (None, None), ("residential", "factory")], "z string, p string")
    assert [r[0] for r in df.select(labels.activity_sector("z", "p")).collect()] == ["retail", "tertiary", "other", "other"]


def test_a_combo_reads_its_buildings_once(spark):
    """The buildings' rows are joined with their parcels once; footprints, sets and tags all come from that."""
    parcels = spark.createDataFrame([("p1", "c", "A", "1", 5.0, 1.0, "retail"), ("p2", "c", "A", "2", 5.0, 1.0, None), ("p3", "c", "A", "3", 7.0, 1.0, None)], "scout_v5_id string, code_insee string, section string, numero_norm string, footprint_sum_m2 double, contour_m2 double, zone_tag string")
    rows = [("p2", "b", "w:1", 3.0, "1990", "school", "landuse", "yes", "partage", 0), ("p1", "b", "w:1", 9.0, "1980", "retail", "landuse", "yes", "partage", 1), ("p1", " ", "w:2", 4.0, None, "x", "x", "yes", "mono", 0), ("p2", "i", "w:3", 8.0, "1991", "x", "amenity", "no", "mono", 0), ("zz", "b", "w:9", 1.0, "1900", "x", "x", "x", "mono", 0)]
    buildings = spark.createDataFrame(rows, "scout_v5_id string, batiment_construction_id string, osm_building_id string, footprint_m2 double, annee_construction string, zone_tag string, zone_source string, building_tag string, matching_status string, ord int")
    parkings = spark.createDataFrame([("p2", "w", 5, 1.0, 0), ("p1", "r", -5, 2.0, 0)], "scout_v5_id string, osm_parking_type string, osm_parking_id long, parking_area_m2 double, ord int")
    sirens = spark.createDataFrame([], "scout_v5_id string, role string, siren string, ape string")
    found = combos.build_combos(parcels, buildings, parkings, sirens)
    got = {r["combo_id"]: r for r in found.collect()}
    assert set(got) == {"combo:p1|p2", "combo:p3"}
    c = got["combo:p1|p2"]
    assert (c["footprint_sum_m2"], c["parking_sum_m2"], c["construction_years"], c["osm_building_ids"], c["zone_tags"]) == (9.0, 2.0, [1980, 1990, 1991], ["w:1", "w:2", "w:3"], ["education", "retail"])
    assert c["has_landuse_waiver"] and (got["combo:p3"]["footprint_sum_m2"], got["combo:p3"]["zone_tags"]) == (7.0, [])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("osm_building_id#") <= 6
