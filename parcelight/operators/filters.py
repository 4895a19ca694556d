"""Filters and status columns of discovery and of the matcher."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_wgs84
from ..functions.text import blank

#: Fixed values.
SURFACE_SLIDER_MAX, RATIO_SLIDER_MAX, ENERGY_SLIDER_MAX = 50_000.0, 100.0, 10_000.0
FIRST_YEAR = 1850
WAIVER_LANDUSE = ("commercial", "industrial", "retail")
EXPORT_MIN, SHARED_EXPORT_MIN = 400.0, 500.0
LANDUSE_PRIORITY = ("commercial", "industrial", "retail", "education", "religious", "military", "port", "depot")
AMENITY_ZONES = {"school": "education", "kindergarten": "education", "college": "education", "university": "education", "hospital": "hospital"}
EDUCATION_BUILDINGS = ("school", "kindergarten", "college", "university")
LIMITS = {"overview": (20_000, 35_000), "features": (2_000, 5_000), "leads": (200, 1_000), "energy": (2_000, 2_000)}


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def has_text(c) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def is_active(status) -> Column:
    """An establishment without status, or with A."""
    return (F.trim(blank(status)) == "") | (F.upper(F.trim(blank(status))) == "A")


def not_residential(usage) -> Column:
    """Neither collective nor individual housing, with or without accents; null passes."""
    return ~F.lower(blank(usage)).rlike("r[ée]sidentiel (collectif|individuel)")


def open_range(value: Column, low: float | None, high: float | None, slider_max: float) -> list[Column]:
    """Above low (exclusive, if positive) and up to high (unless the slider is at its end)."""
    parts = []
    if low is not None and low > 0:
        parts.append(value > low)
    if high is not None and high < slider_max:
        parts.append(value <= max(0.0, high))
    return parts


def ratio_range(part: Column, whole: Column, low_pct: float | None, high_pct: float | None) -> list[Column]:
    unit = lambda p: min(1.0, max(0.0, p / 100))
    bounds = open_range(F.try_divide(part, F.nullif(whole, F.lit(0.0))), unit(low_pct or 0), None if high_pct is None or high_pct >= RATIO_SLIDER_MAX else unit(high_pct), 2.0)
    return [whole > 0, *bounds] if bounds else []


def sirens_param(raw: str | list[str] | None) -> list[str]:
    """Nine-digit codes from a repeated or comma-separated parameter, in first-seen order."""
    parts = [] if raw is None else raw.split(",") if isinstance(raw, str) else [x for s in raw for x in s.split(",")]
    return list(dict.fromkeys(p.strip() for p in parts if len(p.strip()) == 9 and p.strip().isdigit() and p.strip().isascii()))


def has_siren(column, sirens: list[str]) -> list[Column]:
    if not sirens:
        return []
    return [F.array_contains(column, sirens[0])] if len(sirens) == 1 else [F.arrays_overlap(column, F.array(*map(F.lit, sirens)))]


def any_year_between(years, a: int, b: int, slider_max: int) -> Column:
    """Any known year within the two bounds in either order; a full range passes all."""
    low, high = min(a, b), max(a, b)
    if low <= FIRST_YEAR and high >= slider_max:
        return F.lit(True)
    return F.coalesce(F.exists(years, lambda y: y.between(low, high)), F.lit(False))


def in_box(lng, lat, box: tuple[float, float, float, float]) -> Column:
    """(lng, lat, lng, lat) in either order of corners."""
    x, y = sorted((box[0], box[2])), sorted((box[1], box[3]))
    return lng.between(*x) & lat.between(*y)


def clamp_limit(asked: int | None, kind: str) -> int:
    default, most = LIMITS[kind]
    return default if asked is None or asked <= 0 else min(int(asked), most)


def owner_bucket(n) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "single").otherwise("multiple")


def establishment_bucket(n) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "single").otherwise("shared")


def overlap_status(area, least: float = 20.0) -> Column:
    a = F.coalesce(area, F.lit(0.0))
    return F.when(a <= 0, "unmatched").when(a < least, "low_overlap").otherwise("matched")


def only_if_matched(df: DataFrame, status: str, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(status) == "matched", F.col(c)) for c in columns})


def zone_tag(landuse, building_use, building, amenity) -> Column:
    """A struct (tag, source): dedicated land use, then amenity, other land use, declared use, building type."""
    lu, am = F.lower(F.trim(blank(landuse))), F.lower(F.trim(blank(amenity)))
    bu, bl = F.trim(blank(building_use)), F.trim(blank(building))
    zone = F.create_map(*[F.lit(x) for pair in AMENITY_ZONES.items() for x in pair])[am]
    of = lambda tag, source: F.struct(tag.alias("tag"), F.lit(source).alias("source"))
    kind = F.when(F.lower(bl).isin(*EDUCATION_BUILDINGS), "education").otherwise(bl)
    return (
        F.when(lu.isin(*LANDUSE_PRIORITY), of(lu, "landuse"))
        .when(zone.isNotNull(), of(zone, "amenity"))
        .when(lu != "", of(lu, "landuse"))
        .when(bu != "", of(bu, "building_use"))
        .when((bl != "") & (F.lower(bl) != "yes"), of(kind, "building"))
        .otherwise(of(F.lit(""), "none"))
    )


def meets_export_threshold(footprint, waived, shared, least: float = EXPORT_MIN, least_shared: float = SHARED_EXPORT_MIN) -> Column:
    """Strictly above the threshold; parcels of shared buildings have a higher one and no land-use waiver."""
    return F.when(shared, footprint > least_shared).otherwise((footprint > least) | F.coalesce(waived, F.lit(False)))


def floor_or_waiver(df: DataFrame, area: str, least: float, waivers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of at least the area, or with a row in waivers. The waiver is a flag joined once per key."""
    if least <= 0:
        return df
    flags = waivers.select(*keys).distinct().withColumn("_waived", F.lit(True))
    return df.join(flags, keys, "left").filter((F.col(area) >= least) | F.col("_waived").isNotNull()).drop("_waived")


#: What makes a point of interest, and what doesn't.
POI_KEYS = ("shop", "amenity", "craft", "office", "healthcare", "leisure", "tourism", "man_made")
DULL_AMENITY = (
    "parking", "parking_space", "parking_entrance", "motorcycle_parking", "bicycle_parking", "bench", "waste_basket", "drinking_water",
    "fountain", "toilets", "bbq", "bicycle_repair_station", "vending_machine", "atm", "post_box", "parcel_locker",
)
DULL_LEISURE = ("playground", "picnic_table", "slipway", "firepit")


def is_interesting_poi(tags: Column) -> Column:
    """A point of interest by its tags, unless a key says that it is gone."""
    gone = F.exists(F.map_keys(tags), lambda k: F.lower(k).rlike("^(disused|abandoned|was):"))
    value = lambda k: F.lower(F.trim(blank(F.try_element_at(tags, F.lit(k)))))
    dull = {"amenity": DULL_AMENITY, "leisure": DULL_LEISURE}
    kinds = [(value(k) != "") & ~(value(k).isin(*dull[k]) if k in dull else F.lit(False)) for k in POI_KEYS]
    return ~gone & reduce(lambda a, b: a | b, kinds)


def parking_tag(tags: Column) -> Column:
    """A struct (tag, value) of the first of amenity, leisure and landuse that says parking, else null."""
    out = F.lit(None).cast("struct<tag:string,value:string>")
    for key in ("landuse", "leisure", "amenity"):
        v = F.lower(F.trim(blank(F.try_element_at(tags, F.lit(key)))))
        out = F.when(v == "parking", F.struct(F.lit(key).alias("tag"), v.alias("value"))).otherwise(out)
    return out


def accepts_reverse(kind, city, commune, score, metres, pro, fallback) -> Column:
    """A struct (ok, reason): the type, the commune, then score and distance by zone; tighter scores, wider distances for
    parcel fallbacks."""
    least = F.when(pro, 0.88).otherwise(0.85) + F.when(fallback, 0.02).otherwise(0.0)
    most = F.when(pro, 20.0).otherwise(25.0) + F.when(fallback, 5.0).otherwise(0.0)
    no = lambda reason: F.struct(F.lit(False).alias("ok"), F.lit(reason).alias("reason"))
    return (
        F.when(~F.coalesce(kind.isin("housenumber", "street"), F.lit(False)), no("ban_type_not_address"))
        .when((F.trim(blank(commune)) != "") & (blank(city) != "") & (city != F.trim(commune)), no("ban_citycode_mismatch"))
        .when(~F.coalesce(score >= least, F.lit(False)), no("ban_score_below_threshold"))
        .when(~F.coalesce(metres <= most, F.lit(False)), no("ban_distance_above_threshold"))
        .otherwise(F.struct(F.lit(True).alias("ok"), F.lit("").alias("reason")))
    )


#: Fixed value: the least score of a forward geocode hit.
FORWARD_SCORE = 0.75


def accepts_forward(score, lat, lng, city, commune, least: float = FORWARD_SCORE) -> Column:
    """Whether a forward hit counts: score, a place on earth, and the commune asked for, which must be a five-digit code."""
    asked = F.trim(blank(commune))
    return F.coalesce(asked.rlike(r"^[0-9]{5}$") & (score >= least) & valid_wgs84(lat, lng) & (F.trim(blank(city)) == asked), F.lit(False))
