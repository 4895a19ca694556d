"""Sources of the reference's inputs as DataFrames with fixed schemas."""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.geo import valid_wgs84
from ..functions.labels import osm_address
from ..operators import filters
from ..operators import osm_shapes as S
from ..operators.ranking import best_per_key

#: Columns of the owner table (legal persons by parcel).
OWNER_COLUMNS = (
    "code_insee", "section", "numero", "siren", "denomination", "numero_voirie", "indice_repetition", "nature_voie", "nom_voie",
    "code_postal", "commune",
)
_IDENTIFIER = re.compile(r"^[a-z][a-z0-9_]*$")


def conform(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df with exactly these columns as text: absent ones are null, and so are NaN and the texts nan and none."""

    def clean(c: str) -> Column:
        v = F.trim(F.col(c).cast("string"))
        return F.when(F.lower(v).isin("nan", "none", ""), None).otherwise(v)

    return df.select(*[(clean(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def owner_parcels(spark: SparkSession, path: str, code_insee: str | None = None, department: str | None = None) -> DataFrame:
    """Owner rows of one commune or one department (exactly one must be given); the filter reaches the scan."""
    if (code_insee is None) == (department is None):
        raise ValueError("give either a commune or a department")
    raw = spark.read.parquet(path)
    wanted = F.col("code_insee") == code_insee if code_insee else F.col("code_insee").startswith(department)
    return conform(raw.filter(wanted), OWNER_COLUMNS)


ESTABLISHMENT_COLUMNS = (
    "siret", "siren", "denomination", "numero_voie", "indice_repetition", "type_voie", "libelle_voie", "code_postal", "commune",
    "code_commune_insee", "tranche_effectifs", "annee_effectifs", "activite_principale", "etat_administratif",
)


def establishments(spark: SparkSession, path: str) -> DataFrame:
    """Establishments with valid codes from CSV or Parquet, with the normalised fields of their address."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    rows = conform(raw, ESTABLISHMENT_COLUMNS).filter(F.col("siret").rlike(r"^\d{14}$") & F.col("siren").rlike(r"^\d{9}$"))
    parts = X.address_parts("numero_voie", "indice_repetition", "type_voie", "libelle_voie", "commune", "code_postal")
    return rows.withColumn("_a", parts).select(*ESTABLISHMENT_COLUMNS, *[f"_a.{f}" for f in ("numero_norm", "indice_norm", "type_voie_norm", "voie_norm", "commune_norm", "address_norm")])


def active_establishments(rows: DataFrame, code_insee: str) -> DataFrame:
    return rows.filter((F.col("code_commune_insee") == code_insee) & filters.has_text(F.col("voie_norm")) & filters.is_active("etat_administratif"))


RINGS = "array<array<array<struct<x:double,y:double>>>>"


def features_of(chunks: Iterator[str]) -> Iterator[dict]:
    """The features of a FeatureCollection, decoded one by one from pieces of its text."""
    decoder, buffer, inside = json.JSONDecoder(), "", False
    for chunk in chunks:
        buffer += chunk
        if not inside:
            found = re.search(r'"features"\s*:\s*\[', buffer)
            if not found:
                continue
            buffer, inside = buffer[found.end() :], True
        while True:
            buffer = buffer.lstrip(" \t\r\n,")
            if not buffer or buffer[0] == "]":
                break
            try:
                feature, end = decoder.raw_decode(buffer)
            except ValueError:
                break
            yield feature
            buffer = buffer[end:]


def geojson_parcels(spark: SparkSession, path: str) -> DataFrame:
    """Parcels of gzipped FeatureCollections: polygons and multipolygons with commune, section and number. A file is one
    task (gzip can't be split), which holds its packed bytes and unpacks and decodes it piece by piece."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content)
                text = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, "utf-8", "replace")
                rows = []
                for f in features_of(iter(lambda: text.read(1 << 20), "")):
                    p, g = f.get("properties") or {}, f.get("geometry") or {}
                    if g.get("type") not in ("Polygon", "MultiPolygon"):
                        continue
                    shapes = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
                    polygons = [[[{"x": float(q[0]), "y": float(q[1])} for q in ring] for ring in shape] for shape in shapes]
                    rows.append((p.get("commune") or p.get("code_insee"), p.get("section"), p.get("numero"), polygons))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=["code_insee", "section", "numero", "polygons"])
                        rows = []
                yield pd.DataFrame(rows, columns=["code_insee", "section", "numero", "polygons"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(decode, f"code_insee string, section string, numero string, polygons {RINGS}")
    return rows.withColumn("numero_norm", X.parcel_number_for_import("numero")).filter(filters.has_text(F.col("code_insee")) & filters.has_text(F.col("section")) & F.col("numero_norm").isNotNull())


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """National addresses from `;`-separated CSV, with valid coordinates, the first row of each id in the file's order."""
    raw = spark.read.option("header", True).option("sep", ";").option("mode", "DROPMALFORMED").csv(path)
    column = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        column("id").alias("ban_id"),
        *[column(c) for c in ("numero", "rep", "nom_voie", "code_postal", "code_insee", "nom_commune")],
        column("lon").try_cast("double").alias("lon"),
        column("lat").try_cast("double").alias("lat"),
        F.monotonically_increasing_id().alias("_line"),
    )
    fine = rows.filter(filters.has_text(F.col("ban_id")) & valid_wgs84(F.col("lat"), F.col("lon")))
    return best_per_key(fine, ["ban_id"], [F.asc("_line")]).drop("_line")


#: Land uses and leisure areas that are imported.
LANDUSE = (
    "industrial", "commercial", "retail", "residential", "education", "religious", "military", "port", "depot", "cemetery",
    "farmyard", "farmland", "meadow", "orchard", "vineyard", "recreation_ground", "allotments", "brownfield", "construction",
)
LEISURE = ("sports_centre", "stadium", "pitch", "track", "golf_course", "swimming_pool", "marina")
PARKING = ("amenity=parking", "leisure=parking", "landuse=parking")


def is_building() -> Column:
    building = F.lower(S.tag_text("building"))
    return (building != "") & (building != "no")


def is_footprint() -> Column:
    """A building, or the ground of an institution by its amenity."""
    return is_building() | F.lower(S.tag_text("amenity")).isin(*filters.AMENITY_ZONES)


def allowed_landuse(landuse: tuple[str, ...] = LANDUSE, leisure: tuple[str, ...] = LEISURE) -> Column:
    """The land use, or else the kind of leisure, as it is spelled; null unless it is among the allowed ones in any case."""
    one = lambda key, some: F.when(F.lower(S.tag_text(key)).isin(*[a.lower() for a in some]), S.tag_text(key))
    return F.coalesce(one("landuse", landuse), one("leisure", leisure))


def osm_buildings(objects: DataFrame) -> DataFrame:
    """Objects (osm_type, osm_id, tags map, ...) that are buildings, or institutions by their amenity."""
    return objects.filter(is_footprint()).withColumn("kind", F.when(is_building(), "building").otherwise("zone"))


def osm_landuse(objects: DataFrame, allowed: tuple[str, ...] = LANDUSE, leisure: tuple[str, ...] = LEISURE) -> DataFrame:
    return objects.withColumn("landuse", allowed_landuse(allowed, leisure)).filter("landuse is not null")


def osm_parking(objects: DataFrame, allowed: tuple[str, ...] = PARKING) -> DataFrame:
    """Objects with the first allowed tag that says parking; `key` alone stands for `key=parking`."""
    pairs = [(k.strip().lower(), (v or "parking").strip().lower()) for k, _, v in (a.partition("=") for a in allowed)]
    wanted = [k for k, v in pairs if v == "parking"]
    tagged = objects.withColumn("_p", filters.parking_tag(F.map_filter("tags", lambda k, v: k.isin(*wanted)))).filter(F.col("_p").isNotNull())
    return tagged.withColumn("parking_tag", F.col("_p.tag")).withColumn("parking_value", F.col("_p.value")).drop("_p")


def osm_pois(objects: DataFrame) -> DataFrame:
    """Points of interest, the first object of each type and number."""
    found = objects.filter(filters.is_interesting_poi(F.col("tags")))
    return best_per_key(found, ["osm_type", "osm_id"], [F.asc("lon"), F.asc("lat")])


def pbf_buildings(objects: DataFrame) -> DataFrame:
    """Footprints with polygons, kind and address from the objects of an extract."""
    return osm_buildings(S.polygons_of_objects(objects, is_footprint())).withColumn("address_text", osm_address("tags"))


def pbf_landuse(objects: DataFrame, allowed: tuple[str, ...] = LANDUSE, leisure: tuple[str, ...] = LEISURE) -> DataFrame:
    return osm_landuse(S.polygons_of_objects(objects, allowed_landuse(allowed, leisure).isNotNull()), allowed, leisure)


def pbf_parking(objects: DataFrame, allowed: tuple[str, ...] = PARKING) -> DataFrame:
    return osm_parking(S.area_objects(objects, filters.parking_tag(F.col("tags")).isNotNull()), allowed)


def pbf_pois(objects: DataFrame) -> DataFrame:
    return S.points_of_objects(objects, filters.is_interesting_poi(F.col("tags")))


def in_box(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points in (west, south, east, north), borders included."""
    west, south, east, north = box
    return points.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


#: Codes of destinations and states of permits.
DESTINATIONS, STATES = {3: "02", 4: "03", 6: "04", 8: "05"}, {2: "AT", 5: "CO", 6: "TE", 4: "AN"}


def permits(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Construction permits, with the year of the folder; null cells as in the file."""
    raw = spark.read.option("header", True).option("sep", ";").option("encoding", encoding).csv(path)
    year = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4})/[^/]*$", 1)
    rows = raw.withColumn("source_year", F.nullif(year, F.lit("")).cast("int"))
    pick = lambda codes, c: F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[X.loose_int(c)]
    new, before = X.loose_int("SURF_LOC_CREEE"), X.loose_int("SURF_LOC_AVANT")
    nature = F.when((new > 0) & before.isNotNull(), F.when(before == 0, "NC").when(before > 0, "EX"))
    return rows.select(
        F.col("NUM_DAU").alias("num_permis"),
        F.trim("COMM").alias("code_commune"),
        X.department("COMM").alias("department"),
        F.col("SEC_CADASTRE1").alias("section"),
        F.col("NUM_CADASTRE1").alias("numero"),
        pick(DESTINATIONS, "DESTINATION_PRINCIPALE").alias("destination"),
        new.alias("surface_created"),
        before.alias("surface_before"),
        pick(STATES, "ETAT_DAU").alias("state"),
        X.year_month("DATE_REELLE_AUTORISATION").alias("authorised"),
        nature.alias("nature"),
        "source_year",
    )


def business_permits(rows: DataFrame, least: int = 1000) -> DataFrame:
    """Offices, shops, industry and warehouses above the surface, authorised or begun."""
    return rows.filter(F.col("destination").isNotNull() & (F.col("surface_created") > least) & F.col("state").isin("AT", "CO"))


def constructions_of(groups: DataFrame) -> DataFrame:
    """A row per polygon of building groups (batiment_groupe_id, polygons): id group:1, group:2 ..."""
    each = groups.select("*", F.posexplode("polygons").alias("_pos", "polygon")).drop("polygons")
    return each.withColumn("batiment_construction_id", F.concat_ws(":", "batiment_groupe_id", F.col("_pos") + 1)).drop("_pos")


def energy_label(number, repetition, kind, street, address, area, commune) -> Column:
    """The address label of an energy record; null below five characters."""
    road = X.join_parts(kind, street)
    where = F.coalesce(F.nullif(road, F.lit("")), F.nullif(F.trim(X.blank(address)), F.lit("")), F.nullif(F.trim(X.blank(area)), F.lit("")))
    label = F.trim(F.replace(X.join_parts(number, repetition, where, commune), F.lit("  "), F.lit(" ")))
    return F.when(F.length(label) >= 5, label)


def energy_site_id(commune, year, order, label, mwh) -> Column:
    """By the record's order in its commune and year, else by address key and consumption."""
    cc, y, t = F.trim(X.blank(commune)), F.trim(X.blank(year)), X.as_column(order).try_cast("int")
    by_order = F.when((cc != "") & (y != "") & (t >= 0), F.concat_ws(":", cc, y, t.cast("string")))
    return F.coalesce(by_order, F.concat_ws(":", cc, y, X.address_key(X.blank(label)), F.coalesce(X.as_column(mwh).cast("string"), F.lit("0"))))


def paged_records(spark: SparkSession, fetch: Callable[[dict, int, int], list[dict]], requests: list[dict], schema: T.StructType, page: int = 100) -> DataFrame:
    """Rows of a paged service, a task per request: fetch(request, offset, limit) gives the records of a page; a short
    page ends a request. Requests are few (such as one per 40 communes)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for request in map(json.loads, batch["request"]):
                offset = 0
                while True:
                    rows = fetch(request, offset, page)
                    if rows:
                        yield pd.DataFrame(rows).reindex(columns=schema.names)
                    if len(rows) < page:
                        break
                    offset += page

    todo = spark.createDataFrame([(json.dumps(r),) for r in requests], "request string")
    return todo.repartition(max(1, len(requests))).mapInPandas(read, schema)


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, fetch_rows: int = 2000) -> DataFrame:
    """A table read in ranges of a numeric column, in pages of fetch_rows; rows stay distributed."""
    options = {"url": url, "dbtable": name, "partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts, "fetchsize": fetch_rows}
    return spark.read.format("jdbc").options(**{k: str(v) for k, v in options.items()}).load()


def qualified_name(raw: str | None, default: str, schema: str = "public") -> str:
    """schema.table from one or two lower-case parts; anything else is an error."""
    parts = [p.strip() for p in (raw or default).split(".") if p.strip()]
    parts = [schema, *parts] if len(parts) == 1 else parts
    if len(parts) != 2 or not all(map(_IDENTIFIER.match, parts)):
        raise ValueError(f"not a table name: {raw!r}")
    return ".".join(parts)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> tuple[DataFrame, str]:
    """The table, or an empty one of the schema and the status skipped_no_table."""
    if spark.catalog.tableExists(name):
        return spark.table(name), "ok"
    return spark.createDataFrame([], schema), "skipped_no_table"


def first_table(spark: SparkSession, names: list[str], needed: tuple[str, ...] = ()) -> DataFrame | None:
    """The first of the tables that exists and has the needed columns."""
    for name in names:
        if spark.catalog.tableExists(name) and set(needed) <= set(spark.table(name).columns):
            return spark.table(name)
    return None


def commune_codes(spark: SparkSession, path: str) -> DataFrame:
    """The five-character codes listed in a text file, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("code_insee")).filter(F.col("code_insee").rlike(r"^[0-9][0-9AB][0-9]{3}$")).distinct()
