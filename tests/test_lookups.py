import pytest
from pyspark.sql import functions as F

from parcelight.functions import energy as E
from parcelight.operators import lookups as L


def test_requests():
    assert L.parse_ids(" a:1,b ,a:1", 3) == ["a:1", "b"] and L.parse_ids(None, 3) == []
    for bad, most in (("a,b", 1), ("a;drop", 5)):
        with pytest.raises(ValueError):
            L.parse_ids(bad, most)
    assert L.parse_communes("33318,2A004") == ["33318", "2A004"]
    assert [L.buffer_metres(x) for x in (None, -3, 99, 7)] == [5.0, 0.0, 50.0, 7]
    assert L.box_allowed(0, 44.8, 0.01, 44.808) and not L.box_allowed(0, 44.8, 0.1, 44.9)


def test_viewport_and_search(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 2.05, 0.0, 3.0, 1.0), (3, 5.0, 5.0, 6.0, 6.0), (4, None, None, None, None)], "i int, bxmin double, bymin double, bxmax double, bymax double")
    assert sorted(r["i"] for r in df.filter(L.in_viewport("b", (0.0, 0.0, 2.0, 2.0), 0.05)).collect()) == [1, 2, 4]
    divisions = spark.createDataFrame([("47", "Commerce de détail"), ("10", "Industries alimentaires")], "code string, label string")
    assert [r["code"] for r in L.search_text(divisions, "COMMERCE").collect()] == ["47"] and L.search_text(divisions, "1").count() == 1
    assert L.records_where(divisions, {"code": "47"}, [F.asc("label")], 1).count() == 1


def test_joins(spark):
    objects = spark.createDataFrame([(1, 5.0, 5.0, None), (2, 5.0, 5.0, "33318"), (3, 50.0, 50.0, "1")], "i int, x double, y double, code_insee string")
    parcels = spark.createDataFrame([("33318", 0.0, 0.0, 10.0, 10.0), ("33999", 0.0, 0.0, 10.0, 10.0)], "code_insee string, pxmin double, pymin double, pxmax double, pymax double")
    got = {r["i"]: (r["code_insee"], r["changed"]) for r in L.assign_commune(objects, parcels, ["i"], 8.0).collect()}
    assert got == {1: ("33318", True), 2: ("33318", False), 3: ("1", False)}
    parkings = spark.createDataFrame([("k1", ["a", "b"]), ("k2", ["z"])], "k string, parcels array<string>")
    buildings = spark.createDataFrame([("b1", ["b", "a", "c"]), ("b2", ["c"])], "b string, parcels array<string>")
    assert [(r["k"], r["b"], r["common"]) for r in L.link_by_parcels(parkings, buildings, "k", "b").collect()] == [("k1", "b1", ["a", "b"])]
    extras = spark.createDataFrame([("k1", 3), ("k1", 2)], "k string, v int")
    assert {r["k"]: r["v"] for r in L.first_of_group(parkings.select("k"), extras, "k", [F.asc("v")]).collect()} == {"k1": 2, "k2": None}


def test_permits(spark):
    permits = spark.createDataFrame([("n1", "1", "AB", "35", None, None), ("n2", "1", "AB", "x9", None, None), ("n3", "1", "AB", "35", 9.0, 9.0), ("n4", "1", "ZZ", "35", None, None)], "num_permis string, code_commune string, section string, numero string, x double, y double")
    parcels = spark.createDataFrame([("1", "AB", "0035", 1.0, 2.0), ("1", "AB", "9", 3.0, 4.0)], "code_insee string, section string, numero string, x double, y double")
    got = {r["num_permis"]: (r["x"], r["y"]) for r in L.locate_permits(permits, parcels).collect()}
    assert got == {"n1": (1.0, 2.0), "n2": (3.0, 4.0), "n3": (9.0, 9.0), "n4": (None, None)}


def test_ids_and_surfaces(spark):
    df = spark.createDataFrame([([" bdnbcstr:g1:2", "g2", "", "g2"],)], "ids array<string>")
    r = df.select(L.split_building_ids(F.col("ids")).alias("s")).head()["s"]
    assert (r["constructions"], r["groups"]) == (["g1:2"], ["g2"])
    rows = [(5.0, 1.0, 1, 9.0, 3, 7.0), (None, 1.0, 1, 9.0, 3, 7.0), (None, 1.0, 3, 9.0, 3, 7.0), (None, 0.0, 3, 9.0, 3, 7.0), (None, 0.0, 3, 9.0, 3, 0.0)]
    surfaces = spark.createDataFrame(rows, "s double, f double, n int, h double, hn int, o double")
    assert [r[0] for r in surfaces.select(L.energy_footprint(*map(F.col, surfaces.columns))).collect()] == [5.0, 9.0, 1.0, 7.0, 9.0]


def test_financial_summary(spark):
    day, load = [[0.0] * 8 + [5.0] * 8 + [0.0] * 8] * 12, [[1.5] * 24] * 12
    schema = "i int, footprint_m2 double, kwp double, annual_per_kwp double, production array<array<double>>, consumption array<array<double>>, consumption_kwh double, panel_w double, panel_m2 double, panel_eur double, inverter_kw double, inverter_eur double, battery_kwh double, battery_charge_kw double, battery_discharge_kw double, battery_pct double, battery_eur double"
    base = (400.0, 1.0, 12.0, day, load, 13140.0, 400.0, 2.0, 150.0, 10.0, 2000.0)
    rows = [(1, 500.0, *base[1:], None, None, None, None, None), (2, 500.0, *base[1:], 10.0, 5.0, 5.0, 90.0, 3000.0), (3, 500.0, 1.0, 12.0, None, None, 10.0, *base[6:], None, None, None, None, None), (4, 0.0, *base[1:], None, None, None, None, None)]
    got = {r["i"]: r["summary"] for r in E.financial_summary(spark.createDataFrame(rows, schema)).collect()}
    assert got[4] is None and got[1]["panels"] == 2 and got[1]["inverters"] == 1 and got[1]["equipment_eur"] == 2300
    assert got[1]["direct_kwh"] == 12 * 365 and got[1]["exported_kwh"] == 28 * 365 and got[1]["via_battery_kwh"] == 0
    assert got[2]["via_battery_kwh"] > 0 and got[2]["equipment_eur"] == 5300 and got[2]["savings_eur"] > got[1]["savings_eur"]
    assert not got[3]["from_hours"] and got[3]["savings_eur"] == 2
    assert got[1]["low_eur"] == 2970 and got[1]["years_low"] == E_round(2970 / got[1]["savings_eur"])


def E_round(x):
    import math

    return math.floor(x * 10 + 0.5) / 10
