"""Single operators on hand-made rows with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelight.functions import energy as E
from parcelight.functions import fuzzy, geo, overlaps
from parcelight.functions import text as X
from parcelight.operators import combos, company_match, filters, merging, resolution, spatial
from parcelight.operators.overview import OverviewFilters


def one(spark, expression, **columns):
    """The value of an expression over one row of typed literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, tuple) else F.lit(v[0]).cast(v[1]).alias(k) for k, v in columns.items()] or ["id"])
    return df.select(expression.alias("v")).head()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Rue de l'Église", "RUE DE L EGLISE"), (None, ""), ("  Ça—va?  ", "CA VA"), ("straße 12-14", "STRASSE 12 14"), ("Ñandú", "NANDU")],
)
def test_normalize_text(spark, text, want):
    assert one(spark, X.normalize_text("t"), t=(text, "string")) == want


def test_address_scalars(spark):
    t = lambda f, v: one(spark, f("t"), t=(v, "string"))
    assert t(X.street_numbers, "12-14") == ["12", "14"]
    assert t(X.street_numbers, "1234567") == ["12345", "67"]
    assert [t(X.repetition_index_for_match, v) for v in ("B", "bis", "T", "A", None)] == ["BIS", "BIS", "TER", "", ""]
    assert [t(X.parcel_number, v) for v in ("35", "000123", "x", None)] == ["0035", "0123", None, None]
    assert t(X.parcel_number_for_import, "x") == "x"
    assert [t(X.department, v) for v in ("33318", "97411", "2A004", None, "9")] == ["33", "974", "2A", None, None]
    assert [t(X.loose_int, v) for v in ("1 234", "12,9", "x", None, "1 000")] == [1234, 12, None, None, 1000]
    assert [t(X.year_month, v) for v in ("2026-03-04", "2026-03", "04/03/2026", "")] == ["2026-03", "2026-03", None, None]
    assert t(X.domain, "https://www.Example.org:80/x?y") == "example.org"
    assert [t(X.siren, v) for v in ("432758597", "43275859700011", "4327")] == ["432758597", "432758597", None]
    assert [t(X.activity_division, v) for v in ("47.11F", "4", None)] == ["47", None, None]
    assert one(spark, X.round_half_up(F.lit(-2.5))) == -2.0 and one(spark, X.round_half_up(F.lit(2.5))) == 3.0


def test_fuzzy_scores():
    assert fuzzy.ratio("abcd", "abcd") == 100 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("ab", "cd") == 0
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    assert fuzzy.partial_ratio("REPUBLIQUE", "DE LA REPUBLIQUE") == 100
    assert fuzzy.weighted_ratio("DE LA REPUBLIQUE", "REPUBLIQUE") == pytest.approx(90.0)
    assert fuzzy.weighted_ratio("FOCH MARECHAL", "MARECHAL FOCH") == pytest.approx(95.0)


def score(spark, **x):
    base = {"numbers": ["10"], "voie_q": "FOCH", "voie_db": "FOCH", "indice_q": "", "indice_db": "", "commune_q": "PESSAC", "commune_db": "PESSAC", "cp_q": "", "cp_db": "", "numero": "10", "street": 100.0, "best": 0.0} | x
    df = spark.createDataFrame([base])
    tier = company_match.number_tier(F.col("numbers"), F.col("numero"), F.col("best"))
    s = company_match.address_score(tier, *map(F.col, ("voie_q", "voie_db", "street", "indice_q", "indice_db", "commune_q", "commune_db", "cp_q", "cp_db")))
    return df.select(s.alias("s")).head()["s"]


def test_address_score(spark):
    wrong = score(spark, numero="99", best=fuzzy.ratio("99", "10"))
    assert wrong["score"] < 52 and "numero_mismatch" in wrong["reason"]
    assert score(spark, cp_q="33600", cp_db="33600")["score"] == 90
    assert score(spark, indice_q="BIS", indice_db="BIS")["score"] >= 55
    zeros = score(spark, numero="008", numbers=["8"])
    assert zeros["reason"] == "voie_exacte, numero_leading_zeros, commune_exacte" and zeros["score"] == 82
    assert score(spark, voie_q="DE LA REPUBLIQUE", voie_db="REPUBLIQUE")["score"] == 28 + 32 + 14


def test_company_match(spark):
    q = spark.createDataFrame(
        [("q1", "33318", ["10"], "", "FOCH", "PESSAC", ""), ("q2", "33318", ["3"], "", "", "PESSAC", ""), ("q3", "33318", ["77"], "", "FOCH", "", ""), ("q4", "1", ["1"], "", "FOCH", "", "")],
        "query_id string, code_insee string, numbers array<string>, indice_q string, voie string, commune_q string, cp_q string",
    )
    e = spark.createDataFrame(
        [("33318", "s1", "c1", "10", "", "FOCH", "PESSAC", ""), ("33318", "s2", "c2", "10", "", "FOCHE", "PESSAC", ""), ("33318", "s3", "c3", "5", "", "AUTRE", "PESSAC", "")],
        "code_insee string, siret string, siren string, numero string, indice string, voie string, commune string, cp string",
    )
    got = {r["query_id"]: r for r in company_match.match_establishments(q, e).collect()}
    assert got["q1"]["status_technique"] == "matched" and got["q1"]["sirets"][0] == "s1" and got["q1"]["matching_confidence"] == 86
    assert got["q2"]["status_technique"] == "no_address_tokens"
    assert got["q3"]["status_technique"] == "low_confidence" and got["q3"]["siret_count"] == 0
    assert got["q4"]["status_technique"] == "no_candidate"
    more = q.selectExpr("*", "case when query_id = 'q3' then '  ' else 'x' end address").withColumn("numbers", F.when(F.col("query_id") == "q4", F.array().cast("array<string>")).otherwise(F.col("numbers")))
    status = {r["query_id"]: (r["status_technique"], r["matching_reason"]) for r in company_match.match_establishments(more, e).collect()}
    assert {k: v[0] for k, v in status.items()} == {"q1": "matched", "q2": "no_address_tokens", "q3": "no_address", "q4": "no_passerelle_numero"}
    assert status["q4"][1].startswith("Pas de num") and got["q3"]["matching_reason"].startswith("Candidats")
    missing = company_match.match_establishments(q, None).collect()
    assert {(r["status_technique"], r["status_metier"], r["siret_count"], r["sirets"]) for r in missing} == {("source_missing", "none", 0, None)}


PAIRS = "building_id string, code_insee string, section string, numero_norm string, intersection_area_m2 double"
OWNERS = "code_insee string, section string, numero_norm string, siren string, denomination string, address string"


def test_shared_building_goes_to_the_shared_owner(spark):
    pairs = spark.createDataFrame([("w:1", "33318", "HC", "0035", 500.0), ("w:1", "33318", "AB", "0002", 450.0), ("w:2", "33318", "AB", "0002", 900.0)], PAIRS)
    rows = [("33318", "HC", "0035", "432758597", "d", "a")] * 5 + [("33318", "AB", "0002", "432758597", "d", "b")] * 3 + [("33318", "AB", "0002", "111111111", "d", "b"), ("33318", "HC", "0035", "x", "d", "z")]
    owners = resolution.owners_by_parcel(spark.createDataFrame(rows, OWNERS))
    by = {r["numero_norm"]: r for r in owners.collect()}
    assert by["0002"]["siren_rows"] == {"111111111": 1, "432758597": 3} and by["0002"]["owner_status"] == "multiple"
    assert by["0035"]["address"] == "a" and by["0035"]["n_rows"] == 6
    (found,) = resolution.resolve_shared_buildings(pairs, owners).collect()
    assert (found["section"], found["numero_norm"], found["matching_siren_selected"], found["matching_decision"]) == ("HC", "0035", "432758597", "shared_siren")
    (alone,) = resolution.resolve_shared_buildings(pairs.replace({450.0: 700.0}), owners.limit(0)).collect()
    assert (alone["numero_norm"], alone["matching_decision"]) == ("0002", "unique_by_intersection")


def test_combos(spark):
    parcels = spark.createDataFrame(
        [("p1", "33318", "AB", "0001", 684.0, 10.0, "School"), ("p2", "33318", "AA", "0002", 551.0, 20.0, "industrial"), ("p3", "33318", "AC", "0003", 77.0, 5.0, "forest")],
        "scout_v5_id string, code_insee string, section string, numero_norm string, footprint_sum_m2 double, contour_m2 double, zone_tag string",
    )
    buildings = spark.createDataFrame(
        [
            ("p1", "b1", "w:1", 551.0, "1987", "retail", "landuse", "yes", "partage", 0),
            ("p1", "b2", "bad", 133.0, "900", "x", "building", "yes", "mono", 1),
            ("p2", "b1", "w:1", 551.0, "2001.0", "commercial", "building", "yes", "partage", 0),
            ("p2", "b3", "w:3", 999.0, None, "hospital", "amenity", "", "mono", 1),
        ],
        "scout_v5_id string, batiment_construction_id string, osm_building_id string, footprint_m2 double, annee_construction string, zone_tag string, zone_source string, building_tag string, matching_status string, ord int",
    )
    parkings = spark.createDataFrame([("p1", "r", -5, 100.0, 0), ("p2", "w", 5, 100.0, 0), ("p2", "e", 9, 50.0, 1)], "scout_v5_id string, osm_parking_type string, osm_parking_id long, parking_area_m2 double, ord int")
    sirens = spark.createDataFrame([("p1", "owner", "432758597", None), ("p2", "domiciliation", "111111111", "47.11"), ("p2", "owner", "12", None)], "scout_v5_id string, role string, siren string, ape string")
    got = {r["combo_id"]: r for r in combos.build_combos(parcels, buildings, parkings, sirens).collect()}
    assert set(got) == {"combo:p1|p2", "combo:p3"}
    c = got["combo:p1|p2"]
    assert (c["footprint_sum_m2"], c["parking_sum_m2"], c["parcel_contour_sum_m2"]) == (684.0, 150.0, 30.0)
    assert c["anchor_parcelle_id"] == "p2" and c["parcelle_scout_v5_ids"] == ["p2", "p1"] and c["has_landuse_waiver"]
    assert c["zone_tags"] == ["commercial", "education", "hospital", "industrial", "retail"] and c["construction_years"] == [1987, 2001]
    assert (c["osm_building_ids"], c["owner_sirens"], c["domiciliation_sirens"], c["naf_divisions"]) == (["w:1", "w:3"], ["432758597"], ["111111111"], ["47"])
    assert got["combo:p3"]["footprint_sum_m2"] == 77.0 and got["combo:p3"]["zone_tags"] == []


def test_export_threshold(spark):
    rows = [(450.0, False, False), (400.0, False, False), (100.0, True, False), (450.0, True, True), (501.0, False, True)]
    df = spark.createDataFrame(rows, "f double, w boolean, s boolean")
    got = [r[0] for r in df.select(filters.meets_export_threshold(F.col("f"), F.col("w"), F.col("s"))).collect()]
    assert got == [True, False, True, False, True]


def test_request_filters():
    assert filters.sirens_param("432758597, 12,432758597,111111111") == ["432758597", "111111111"]
    assert [filters.clamp_limit(n, "overview") for n in (None, 5, 10**6)] == [20_000, 5, 35_000]
    with pytest.raises(ValueError):
        OverviewFilters(box=(0, 0, 1, 1), sirens=["432758597"], division="47")


def test_reverse_hits(spark):
    rows = [("street", "1", "1", 0.86, 20.0, False, False), ("street", "1", "1", 0.86, 20.0, True, False), ("city", "1", "1", 1.0, 0.0, False, False), ("street", "2", "1", 1.0, 0.0, False, False), ("housenumber", None, "1", 0.9, 29.0, False, True)]
    df = spark.createDataFrame(rows, "k string, city string, com string, s double, m double, pro boolean, fb boolean")
    got = [(r[0]["ok"], r[0]["reason"]) for r in df.select(filters.accepts_reverse(*map(F.col, df.columns))).collect()]
    assert got == [(True, ""), (False, "ban_score_below_threshold"), (False, "ban_type_not_address"), (False, "ban_citycode_mismatch"), (True, "")]


def test_poi_and_parking_tags(spark):
    df = spark.createDataFrame([({"amenity": "Bench"},), ({"amenity": "cafe"},), ({"shop": "x", "disused:shop": "y"},), ({"leisure": "parking"},), ({},)], "t map<string,string>")
    rows = df.select(filters.is_interesting_poi(F.col("t")).alias("i"), filters.parking_tag(F.col("t")).alias("p")).collect()
    assert [r["i"] for r in rows] == [False, True, False, True, False]
    assert rows[3]["p"]["tag"] == "leisure" and rows[0]["p"] is None


def test_parking_dedup_prefers_the_register(spark):
    schema = "id string, {0}xmin double, {0}ymin double, {0}xmax double, {0}ymax double"
    osm = spark.createDataFrame([("w:1", 0.0, 0.0, 10.0, 10.0), ("w:2", 100.0, 0.0, 110.0, 10.0), ("w:3", 6.0, 0.0, 26.0, 5.0), ("w:4", None, None, None, None)], schema.format("a"))
    enr = spark.createDataFrame([("e:1", 0.0, 0.0, 10.0, 10.0)], schema.format("b")).drop("id")
    assert sorted(r["id"] for r in spatial.without_covered(osm, enr, "a", "b", 16.0, ["id"]).collect()) == ["w:2", "w:3", "w:4"]


def test_geometry_columns(spark):
    assert [one(spark, geo.distance_score(F.lit(d))) for d in (0.0, 25.0, 50.0)] == pytest.approx([0.99, 0.865, 0.74])
    xy = one(spark, geo.to_lambert93(F.lit(46.5), F.lit(3.0)))
    assert (xy["x"], xy["y"]) == pytest.approx((700_000, 6_600_000), abs=1e-3)
    back = one(spark, geo.from_lambert93(F.lit(417_000.0), F.lit(6_422_000.0)))
    there = one(spark, geo.to_lambert93(F.lit(back["lat"]), F.lit(back["lng"])))
    assert (there["x"], there["y"]) == pytest.approx((417_000, 6_422_000), abs=1e-3)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (20, 0), (20, 10), (0, 10))])
    assert one(spark, geo.ring_area(ring)) == 200 and one(spark, geo.azimuth_from_longest_side(ring)) == 0.0
    hole = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((5, 2), (15, 2), (15, 8), (5, 8))])
    inside = lambda x, y: one(spark, geo.point_in_polygon(F.lit(x), F.lit(y), F.array(ring, hole)))
    assert inside(1.0, 1.0) and not inside(10.0, 5.0) and not inside(30.0, 5.0)


def test_energy(spark):
    assert one(spark, E.surface_to_kwp(F.lit(1000.0), F.lit(20.0))) == 150.0 and one(spark, E.surface_to_kwp(F.lit(0.0), F.lit(20.0))) == 0
    assert one(spark, E.battery_target_kwh(F.lit(3650.0), F.lit(5.0))) == 11.1 and one(spark, E.battery_target_kwh(F.lit(-1.0), F.lit(4.0))) == 5.0
    shares = F.array(*[F.lit(1 / 12)] * 12)
    split = one(spark, E.split_evenly(F.lit(100), shares))
    assert sum(split) == 100 and split[0] == 8
    assert one(spark, E.break_even_years(F.lit(1000.0), F.lit(0.0))) is None


def test_year_simulation_conserves(spark):
    day = lambda k: [[max(0.0, math.sin((h - 6) / 12 * math.pi)) * k if 6 <= h <= 18 else 0.0 for h in range(24)] for _ in range(12)]
    df = spark.createDataFrame([(day(10.0), [[2.0] * 24] * 12)], "p array<array<double>>, c array<array<double>>")
    for battery in (None, E.Battery(20.0, 5.0, 5.0, 81.0, 0.0)):
        r = df.select(E.simulate_year(F.col("p"), F.col("c"), battery).alias("r")).head()["r"]
        assert r["direct"] + r["via_battery"] + r["grid"] == pytest.approx(2 * 24 * 365, abs=0.1)
        assert r["direct"] + r["charged"] + r["exported"] == pytest.approx(sum(day(10.0)[0]) * 365, abs=0.1)
        assert (r["via_battery"] > 0) == (battery is not None)


def test_merges(spark):
    old = spark.createDataFrame([("a", "matched", "p"), ("b", "cadastre_only", "p"), ("c", None, "p")], "k string, match_status string, properties_json string")
    new = spark.createDataFrame([("a", "n"), ("b", "n"), ("d", "n")], "k string, properties_json string")
    got = {r["k"]: (r["match_status"], r["properties_json"]) for r in merging.upsert_keeping_matched(old, new, "k").collect()}
    assert got == {"a": ("matched", "p"), "b": ("cadastre_only", "n"), "c": (None, "p"), "d": ("cadastre_only", "n")}
    ids = merging.effective_ids(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("a")))
    assert one(spark, ids) == ["b", "c"]


def test_polygon_overlap_join(spark):
    ring = lambda *p: [[{"x": float(x), "y": float(y)} for x, y in p]]
    a = spark.createDataFrame([(1, ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 5), (0, 5)), 0.0, 0.0, 3.0, 5.0)], "i int, ap array<array<struct<x:double,y:double>>>, axmin double, aymin double, axmax double, aymax double")
    b = spark.createDataFrame([(2, ring((0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)), 0.5, 0.5, 3.0, 3.0)], "j int, bp array<array<struct<x:double,y:double>>>, bxmin double, bymin double, bxmax double, bymax double")
    (r,) = spatial.overlap_join(a, b, "a", "b", 2.0, 1.0, exact=overlaps.overlap_area("ap", "bp")).collect()
    assert r["overlap_m2"] == pytest.approx(2.25)


def test_adjacent_polygons(spark):
    tri = lambda i, *p: (i, [[{"x": float(x), "y": float(y)} for x, y in p]], *[float(f(c)) for f, c in ((min, [q[0] for q in p]), (min, [q[1] for q in p]), (max, [q[0] for q in p]), (max, [q[1] for q in p]))])
    rows = [tri(1, (0, 0), (10, 0), (0, 10)), tri(2, (10, 10), (10, 2), (2, 10)), tri(3, (10, 10), (10, 6), (6, 10))]
    df = spark.createDataFrame(rows, "i int, ppolygon array<array<struct<x:double,y:double>>>, pxmin double, pymin double, pxmax double, pymax double")
    near = lambda exact: sorted(r["i"] for r in spatial.adjacent(df, df.filter("i = 1"), "p", 2.0, ["i"], 4.0, exact).collect())
    assert near(False) == [2, 3] and near(True) == [2]


def test_components(spark):
    import random

    from parcelight.operators.components import connected_components

    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    whole = [e for e in edges if None not in e]
    for a, b in whole:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for e in whole for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_multipolygons(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [("LineString", square, None), ("LineString", square[:3], None), ("Polygon", None, [[square]]), ("GeometryCollection", None, [[square], [square]]), ("Point", None, []), ("Point", None, None)]
    df = spark.createDataFrame(rows, "k string, l array<struct<x:double,y:double>>, p array<array<array<struct<x:double,y:double>>>>")
    got = [r[0] for r in df.select(geo.as_multipolygon(F.col("k"), F.col("l"), F.col("p"))).collect()]
    assert [None if g is None else len(g) for g in got] == [1, None, 1, 2, None, None]


def test_shared_steps_are_worked_out_once(spark):
    """A lambda that names a Column has it worked out again for each element, so what is shared is bound first."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0))])
    rows = spark.range(1).select(ring.alias("ring"))
    centre = geo.area_centroid(F.col("ring"))
    df = rows.select(centre.alias("c"), geo.point_in_ring(centre["x"], centre["y"], F.col("ring")).alias("inside"))
    assert df.head() == ((2.0, 1.0), True)
    steps = lambda df, name: df._jdf.queryExecution().analyzed().toString().count(name)
    assert steps(rows.select(geo.point_in_ring(centre["x"], centre["y"], F.col("ring")).alias("i")), "aggregate(") == 6  # a centre and its mean of points, for x and y
    split = spark.range(1).select(E.split_evenly(F.lit(100) + F.col("id"), F.array(*[F.lit(1 / 12)] * 12)).alias("s"))
    assert sum(split.head()["s"]) == 100 and steps(split, "aggregate(") == 1


def test_components_by_block(spark, monkeypatch):
    import random

    from parcelight.operators import components

    rng = random.Random(7)
    edges = [(1000 * c + rng.randint(0, 60), 1000 * c + rng.randint(0, 60)) for c in range(40) for _ in range(30)]
    block = lambda node: F.floor(node / 1000)
    of = lambda rows, kind="long", **more: {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, f"a {kind}, b {kind}"), **more).collect()}
    rounds = []
    monkeypatch.setattr(components, "_stars", lambda *a, whole=components._stars, **k: (rounds.append(1), whole(*a, **k))[1])
    whole = of([*edges, (None, 1), (7, 7)], block=block)
    assert not rounds and whole == of([*edges, (7, 7)])
    crossing = [*edges, (5, 2007), (2007, 39001), (39001, 39001)]
    assert of(crossing, block=block) == of(crossing)
    texts = [(f"n{a:06}", f"n{b:06}") for a, b in edges]
    assert of(texts, "string", block=lambda node: F.substring(node, 1, 4)) == of(texts, "string")
    assert of([], block=block) == {}


def test_blocks_too_large_are_cut(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from parcelight.operators import components

    monkeypatch.setattr(components, "CHUNK", 10)
    x = np.arange(200)
    table = pa.table({"x": x, "y": x + 1, "block": np.where(x < 25, x // 5, 9)})
    found = pa.Table.from_batches(components._blocks(iter(table.to_batches(max_chunksize=4))))
    cut = np.array(found["cut"])
    assert not cut[np.array(found["node"]) < 25].any() and cut[np.array(found["node"]) > 26].all()
    edges = set(zip(found["node"].to_pylist(), found["component"].to_pylist()))
    assert components.least_labels(*np.array(sorted(edges)).T, 201).max() == 0 or len(edges) >= 201


def test_crowded_streets_give_only_candidates(spark):
    import re

    q = spark.createDataFrame([("q1", "c", ["1"], "", "FOCH", "", "")], "query_id string, code_insee string, numbers array<string>, indice_q string, voie string, commune_q string, cp_q string")
    k = F.col("id")
    street = F.when(k % 2 == 0, "RUE FOCH").otherwise("FOCH NORD")
    e = spark.range(900).select(F.lit("c").alias("code_insee"), F.lpad(k.cast("string"), 5, "0").alias("siret"), F.lit("s").alias("siren"), F.lit("1").alias("numero"), F.lit("").alias("indice"), street.alias("voie"), F.lit("").alias("commune"), F.lit("").alias("cp"))
    found = company_match.street_candidates(q, e)
    assert sorted(r["siret"] for r in found.collect()) == [f"{i:05}" for i in range(220)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"WindowGroupLimit .*siret#", plan)) == 2 and "< 220))" in plan


def test_combos_shuffle_rows_by_component_once(spark, sf_dir):
    """A number stands for a combo on the way, its parcels are not broadcast, and what a building says stays where it came."""
    from parcelight.plans import business

    plan = business.combos(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("_item" in line or "_key" in line for line in shuffles)
    assert sum("hashpartitioning(component" in line for line in shuffles) <= 4
    assert "BroadcastExchange" not in plan


def test_crowded_streets_give_all_their_matches(spark):
    """No establishment of a candidate street is left out, however many there are."""
    q = spark.createDataFrame([("q1", "c", ["899"], "", "FOCH", "", ""), ("q2", "c", ["7"], "", "RUE GRANDE", "", ""), ("q3", "c", ["x"], "", "RUE BASSE", "", "")], "query_id string, code_insee string, numbers array<string>, indice_q string, voie string, commune_q string, cp_q string")
    k, text = F.col("id"), lambda v: F.lit(v).cast("string")
    row = lambda n, siret, numero, voie: spark.range(n).select(F.lit("c").alias("code_insee"), siret.alias("siret"), F.concat(F.lit("s"), k % 3).alias("siren"), numero.alias("numero"), text(None).alias("indice"), voie.alias("voie"), text("").alias("commune"), text("").alias("cp"))
    number = lambda lead: F.concat(F.lit(lead), F.lpad(k.cast("string"), 5, "0"))
    e = row(900, number("a"), k.cast("string"), F.when(k % 2 == 0, "RUE FOCH").otherwise("FOCH NORD"))
    e = e.union(row(300, number("b"), text("7"), text("RUE GRANDE"))).union(row(60, number("c"), text("7"), F.concat(F.lit("RUE GRANDES "), F.char(65 + k % 26), F.char(65 + F.floor(k / 26).cast("int")))))
    e = e.union(row(2, number("d"), text("1"), text("RUE BASSE")))
    got = {r["query_id"]: r for r in company_match.match_establishments(q, e).collect()}
    assert got["q1"]["sirets"] == ["a00899"]
    assert got["q2"]["siret_count"] == 360 and got["q2"]["sirens"] == ["s0", "s1", "s2"] and got["q2"]["sirets"][0] == "b00000"
    assert (got["q3"]["status_technique"], got["q3"]["siret_count"]) == ("low_confidence", 0)


def test_lists_are_made_after_the_shuffle(spark, sf_dir):
    """Both sides of a list's shuffle held lists before, which takes far more memory than the rows."""
    from parcelight.plans import nested

    plan = nested.nested_json(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_list" in plan.split("Exchange hashpartitioning(o_orderkey")[0]
    assert "collect_list" not in "".join(plan.split("Exchange hashpartitioning(o_orderkey")[1:])
