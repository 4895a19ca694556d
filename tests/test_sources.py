"""Readers and sinks over files made here."""

import gzip
import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelight.sources import geopackage, readers, sinks


def test_owners(spark, tmp_path):
    rows = [("33318", "AB", "1", "432758597"), ("33001", "AC", "2", "nan"), ("75056", "AD", "3", "x")]
    spark.createDataFrame(rows, "code_insee string, section string, numero string, siren string").write.parquet(f"{tmp_path}/o")
    got = readers.owner_parcels(spark, f"{tmp_path}/o", department="33")
    assert got.columns == list(readers.OWNER_COLUMNS) and {r["siren"] for r in got.collect()} == {"432758597", None}
    assert readers.owner_parcels(spark, f"{tmp_path}/o", code_insee="75056").count() == 1
    with pytest.raises(ValueError):
        readers.owner_parcels(spark, f"{tmp_path}/o")


def test_establishments(spark, tmp_path):
    (tmp_path / "e.csv").write_text("siret,siren,libelle_voie,numero_voie,code_commune_insee,etat_administratif\n43275859700011,432758597,De l'Église,12 bis,33318,A\n43275859700012,432758597,X,1,33318,F\n1,2,x,1,33318,A\n")
    rows = readers.establishments(spark, str(tmp_path / "e.csv"))
    assert rows.count() == 2
    (r,) = readers.active_establishments(rows, "33318").collect()
    assert (r["voie_norm"], r["numero_norm"]) == ("DE L EGLISE", "12")


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    feature = lambda p, g: {"type": "Feature", "properties": p, "geometry": g}
    features = [
        feature({"commune": "33318", "section": "AB", "numero": "35"}, {"type": "Polygon", "coordinates": square}),
        feature({"commune": "33318", "section": "AB", "numero": "36"}, {"type": "MultiPolygon", "coordinates": [square, square]}),
        feature({"commune": "33318", "section": "", "numero": "37"}, {"type": "Polygon", "coordinates": square}),
        feature({"commune": "33318", "section": "AB", "numero": "38"}, {"type": "Point", "coordinates": [0, 0]}),
    ]
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(json.dumps({"type": "FeatureCollection", "features": features}).encode()))
    got = {r["numero_norm"]: len(r["polygons"]) for r in readers.geojson_parcels(spark, str(tmp_path / "c.json.gz")).collect()}
    assert got == {"0035": 1, "0036": 2}
    text = json.dumps({"features": features})
    assert len(list(readers.features_of(text[k : k + 7] for k in range(0, len(text), 7)))) == 4


def test_addresses(spark, tmp_path):
    lines = ["id;numero;nom_voie;lon;lat", "a;1;x;2.0;48.0", "a;2;y;2.0;48.0", "b;1;x;200;48", "c;1;x;bad;48", ";1;x;2;48", "d;1;x;3.5;44.1"]
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    assert {(r["ban_id"], r["numero"]) for r in readers.addresses(spark, str(tmp_path / "a.csv.gz")).collect()} == {("a", "1"), ("d", "1")}


def test_permits(spark, tmp_path):
    (tmp_path / "2026").mkdir()
    head = "NUM_DAU;COMM;SEC_CADASTRE1;NUM_CADASTRE1;DESTINATION_PRINCIPALE;SURF_LOC_CREEE;SURF_LOC_AVANT;ETAT_DAU;DATE_REELLE_AUTORISATION"
    (tmp_path / "2026/p.csv").write_text(head + "\nN1;33318;AB;1;4;1 500;0;2;2026-02-03\nN2;97411;AB;1;4;900;10;2;2026-02\nN3;33318;AB;1;9;5000;1;5;x\n")
    rows = readers.permits(spark, str(tmp_path / "2026/p.csv"))
    got = {r["num_permis"]: r for r in rows.collect()}
    assert (got["N1"]["destination"], got["N1"]["surface_created"], got["N1"]["nature"], got["N1"]["source_year"], got["N1"]["authorised"]) == ("03", 1500, "NC", 2026, "2026-02")
    assert got["N2"]["department"] == "974" and got["N2"]["nature"] == "EX"
    assert [r["num_permis"] for r in readers.business_permits(rows).collect()] == ["N1"]


def test_osm_objects(spark):
    df = spark.createDataFrame([("w", 1, {"building": "yes"}), ("w", 2, {"building": "no"}), ("w", 3, {"amenity": "school"}), ("w", 4, {"landuse": "Retail"}), ("w", 5, {"amenity": "parking"})], "osm_type string, osm_id long, tags map<string,string>")
    ids = lambda x: sorted(r["osm_id"] for r in x.collect())
    assert ids(readers.osm_buildings(df)) == [1, 3]
    assert [r["landuse"] for r in readers.osm_landuse(df).collect()] == ["Retail"]
    assert ids(readers.osm_parking(df)) == [5]
    assert ids(readers.osm_pois(df.withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)}))) == [3]


def test_energy_records(spark):
    df = spark.createDataFrame([("33318", "2024", 3, "12", "rue", "Foch", None, None, "Pessac", 5.0), ("33318", "2024", None, None, None, None, "ZI Nord", "i", "Pessac", 7.5)], "cc string, y string, t int, n string, k string, s string, a string, i string, c string, m double")
    label = readers.energy_label("n", F.lit(None), "k", "s", "a", "i", "c")
    got = [tuple(r) for r in df.select(label, readers.energy_site_id("cc", "y", "t", label, "m")).collect()]
    assert got == [("12 rue Foch Pessac", "33318:2024:3"), ("ZI Nord Pessac", "33318:2024:zi nord pessac:7.5")]


def test_paged_service(spark):
    def fetch(request, offset, limit):
        return [{"commune": request["c"], "k": k} for k in range(offset, min(offset + limit, request["n"]))]

    schema = T.StructType([T.StructField("commune", T.StringType()), T.StructField("k", T.LongType())])
    got = readers.paged_records(spark, fetch, [{"c": "a", "n": 25}, {"c": "b", "n": 10}, {"c": "z", "n": 0}], schema, page=10)
    assert {r["commune"]: r["count"] for r in got.groupBy("commune").count().collect()} == {"a": 25, "b": 10}


def test_names_and_absent_tables(spark):
    assert readers.qualified_name(None, "parcels") == "public.parcels" and readers.qualified_name("a.b", "x") == "a.b"
    for bad in ("A.b", "a.b.c", "a;drop", "1a"):
        with pytest.raises(ValueError):
            readers.qualified_name(bad, "x")
    df, status = readers.table_or_empty(spark, "no_such_table", T.StructType([T.StructField("a", T.StringType())]))
    assert status == "skipped_no_table" and df.count() == 0 and df.columns == ["a"]
    spark.range(3).createOrReplaceTempView("some_ids")
    assert readers.first_table(spark, ["no_such_table", "some_ids"], ("id",)).count() == 3
    assert readers.first_table(spark, ["some_ids"], ("x",)) is None


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]
    wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    multi = struct.pack("<BII", 1, 6, 2) + wkb + wkb
    head = b"GP\x00\x01" + struct.pack("<i", 2154)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES ('parking', 'geom')")
        con.execute("CREATE TABLE parking (fid INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
        con.executemany("INSERT INTO parking VALUES (?, ?, ?)", [(1, "a", head + wkb), (25, None, head + multi), (30, "c", None)])
    rows = {r["fid"]: r for r in geopackage.geopackage_layer(spark, path, "parking", rows=10).collect()}
    assert set(rows) == {1, 25} and rows[1]["properties"]["name"] == "a" and len(rows[25]["polygons"]) == 2
    assert rows[1]["polygons"][0][0][1]["x"] == 2.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", '{"type":"Point","coordinates":[1,2]}', 5), ("2", "b", "junk", 6), ("3", "", None, 7)], "id string, part string, g string, v int")
    sinks.write_csv(df, f"{tmp_path}/csv", ["v", "missing", "id"])
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == ["v", "missing", "id"] and back.count() == 3
    sinks.write_features(df, f"{tmp_path}/geo", "id", "g", ["v", "part"])
    (line,) = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/geo").collect()]
    assert line == {"type": "Feature", "id": "1", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"v": 5, "part": "a"}}
    assert sinks.replace_partitions(df, f"{tmp_path}/parts", "part") == {"written": 2, "skipped": 1}
    sinks.replace_partitions(df.filter("part = 'a'").withColumn("v", F.lit(9)), f"{tmp_path}/parts", "part")
    assert {r["part"]: r["v"] for r in spark.read.parquet(f"{tmp_path}/parts").collect()} == {"a": 9, "b": 6}
    sinks.empty_parquet(spark, f"{tmp_path}/none", df.schema)
    assert spark.read.parquet(f"{tmp_path}/none").columns == df.columns
    left, doomed = sinks.reset_partition(df, "part", "a")
    assert doomed == 1 and left.count() == 2
    kept = sinks.cascade_delete(df.filter("id = '1'"), "id", {"x": df})["x"]
    assert kept.count() == 2
    assert spark.read.parquet(sinks.refresh_view(df, f"{tmp_path}/view", 3)).count() == 3


def test_backfill(spark):
    features = spark.createDataFrame([("f1", ["b", "a", "z"]), ("f2", [])], "f string, ids array<string>")
    geometries = spark.createDataFrame([("a", "ga"), ("b", "gb")], "id string, geometry string")
    got = {r["f"]: [tuple(g) for g in r["geoms"]] for r in sinks.backfill_nested(features, geometries, "f", "ids", "geoms").collect()}
    assert got == {"f1": [("b", "gb"), ("a", "ga")], "f2": []}
