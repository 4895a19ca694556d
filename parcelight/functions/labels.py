"""Labels, names and addresses of tagged objects and companies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import haversine_m
from .text import address_key, as_column, blank, join_parts, round_half_up


def tag(tags, *keys: str) -> Column:
    """The first tag of the keys that isn't blank, trimmed, or ''."""
    values = [F.nullif(F.trim(blank(F.try_element_at(as_column(tags), F.lit(k)))), F.lit("")) for k in keys]
    return F.coalesce(*values, F.lit(""))


def osm_address(tags) -> Column:
    """One line from the addr:* tags: number and street (or place) and unit, postcode and town, a foreign country; the
    contact address if there is nothing else."""
    t = lambda *k: tag(tags, *k)
    first = join_parts(t("addr:housenumber"), t("addr:housename"), t("addr:street", "addr:place"))
    unit = t("addr:unit", "addr:flats")
    line1 = join_parts(first, unit, sep=", ")
    town = t("addr:city", "addr:town", "addr:village")
    line2 = join_parts(t("addr:postcode"), F.when(town != "", town).otherwise(t("addr:suburb")))
    country = t("addr:country")
    abroad = F.when(~F.upper(country).isin("FR", "FRA", "FRANCE") | ((line1 == "") & (line2 == "")), country)
    built = join_parts(line1, line2, abroad, sep=", ")
    return F.when(t("addr:full") != "", t("addr:full")).when(built != "", built).otherwise(t("contact:address"))


def stored_tags(tags, kept: tuple[str, ...]) -> Column:
    """The tags of the kept keys and all addr:* tags that aren't blank."""
    return F.map_filter(as_column(tags), lambda k, v: (k.isin(*kept) | k.startswith("addr:")) & (F.trim(blank(v)) != ""))


def words_label(key, value) -> Column:
    """Category and words of a tag without a translation: 'Shop - Car Repair'."""
    words = lambda c: F.initcap(F.regexp_replace(blank(c), "[_;]+", " "))
    return F.when(blank(value) == "", "").otherwise(F.concat(words(key), F.lit(" - "), words(value)))


#: Abbreviations of streets in lower case, in the order in which they are expanded.
STREET_WORDS = (
    (r"\bimp\.\s*", "impasse "),
    (r"\bpl\.\s*", "place "),
    (r"\bch\.\s*", "chemin "),
    (r"\bav\.\s*", "avenue "),
    (r"\bave\b", "avenue"),
    (r"\bbd\b", "boulevard"),
    (r"\bboul\b", "boulevard"),
    (r"\brte\b", "route"),
)
#: Legal forms, words that say nothing, and words too common to tell companies apart.
LEGAL_FORMS = ("selarl", "selas", "sasu", "sarl", "sas", "eurl", "scop", "snc", "sci", "gie", "sa")
STOP_WORDS = (
    "le", "la", "les", "de", "du", "des", "et", "au", "aux", "the", "and", "chez", "societe", "service", "services", "business",
    "solutions", "consulting", "ingenierie", "technologies", "technology", "international", "france", "europe", "groupe", "holding",
    "global", "digital",
)


def street_line(c) -> Column:
    line = address_key(c)
    for pattern, word in STREET_WORDS:
        line = F.regexp_replace(line, pattern, word)
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def without_legal_form(c, rounds: int = 3) -> Column:
    """The name without legal forms at its end, up to `rounds` of them."""
    pattern = rf"(?:\s*[-–,]\s*|\s+)(?:{'|'.join(LEGAL_FORMS)}|s\.?\s*a)\.?\s*$"
    name = address_key(c)
    for _ in range(rounds):
        name = F.trim(F.regexp_replace(name, pattern, ""))
    return F.regexp_replace(name, r"\s+", " ")


def name_tokens(name, commune) -> Column:
    """Words of four letters or more that tell a place's name from others."""
    words = F.split(without_legal_form(name), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS) & (w != address_key(commune)))


def shares_token(name, other, commune) -> Column:
    """Whether a telling word of name is a whole word of other (its parts: letters, digits, underscores)."""
    return F.arrays_overlap(name_tokens(name, commune), F.split(address_key(other), "[^a-z0-9_]+"))


WEIGHTS = {"name": 250, "street": 380, "postcode": 270, "distance": 100}
TOKEN_FLOOR, NEAR_M, OWNER_BONUS = 0.92, 1000.0, 200


def candidate_score(name_likeness, name, other, commune, street, address, cp, other_cp, lat, lng, other_lat, other_lng) -> Column:
    """0 to 1000 for a company as that of a place: name, street, postcode and distance. A shared telling word lifts the
    name's part where the address agrees."""
    a, b = street_line(street), street_line(address)
    on_street = (blank(street) != "") & (blank(address) != "") & (F.contains(b, a) | F.contains(a, b))
    same_cp = (blank(cp) != "") & (F.trim(blank(cp)) == F.trim(blank(other_cp)))
    near = F.coalesce(haversine_m(lat, lng, other_lat, other_lng) <= NEAR_M, F.lit(False))
    anchored = on_street | (same_cp & near)
    part = F.when(anchored & shares_token(name, other, commune), F.greatest(name_likeness, F.lit(TOKEN_FLOOR))).otherwise(name_likeness)
    of = lambda flag, k: F.when(flag, float(WEIGHTS[k])).otherwise(0.0)
    return round_half_up(part * WEIGHTS["name"]) + of(on_street, "street") + of(same_cp, "postcode") + of(near, "distance")


#: How telling the types of a nearby place are.
TYPE_WEIGHTS = {
    "establishment": 1.35, "point_of_interest": 1.15, "store": 1.2, "food": 1.1, "restaurant": 1.1, "cafe": 1.05, "finance": 0.95,
    "health": 1.05, "gym": 1.0, "lodging": 1.05, "route": 0.2, "street_address": 0.35, "locality": 0.25, "political": 0.2,
    "premise": 1.0, "subpremise": 0.85, "geocode": 0.3,
}


def type_score(types) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair])
    best = F.array_max(F.transform(types, lambda t: F.coalesce(weights[t], F.lit(0.0))))
    return F.when(types.isNull() | (F.size(types) == 0), 0.55).otherwise(F.least(F.lit(1.5), F.greatest(F.lit(0.5), best)))


def relevance(metres, types, inside) -> Column:
    """Of a nearby place: by distance and types, more inside the parcel."""
    return 0.62 / (1 + metres / 30) + 0.38 * type_score(types) + F.when(inside, 0.2).otherwise(0.0)


def person(raw: Column) -> Column:
    """A contact from a loosely typed record: composed or given name (null without one), first phone, e-mail status and
    domain."""
    t = lambda c: F.nullif(F.trim(c), F.lit(""))
    composed = F.nullif(join_parts(raw["first_name"], raw["last_name"]), F.lit(""))
    phone = F.get(F.filter(F.transform(raw["phone_numbers"], lambda p: F.coalesce(t(p["sanitized_number"]), t(p["raw_number"]))), lambda p: p.isNotNull()), F.lit(0))
    status = F.lower(t(raw["email_status"]))
    known = F.when(status.isin("verified", "valid"), "verified").when(status.isin("guessed", "likely"), "guessed").when(status.isin("unverified", "unavailable", "extrapolated"), "unverified")
    name = F.coalesce(composed, t(raw["name"]))
    return F.when(name.isNotNull(), F.struct(name.alias("full_name"), t(raw["email"]).alias("email"), known.alias("email_status"), phone.alias("phone")))


def address_context(name, address) -> Column:
    """A struct (name, commune, code_postal, street, zac) from a name and a comma-separated address: the segment with the
    postcode holds the commune, the one before it the street."""
    text = F.trim(blank(address))
    segments = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    code = F.nullif(F.regexp_extract(text, r"\b(\d{5})\b", 1), F.lit(""))
    at = F.array_position(F.transform(segments, lambda s: F.coalesce(F.contains(s, code), F.lit(False))), F.lit(True))
    commune = F.when(at > 0, F.nullif(F.trim(F.regexp_replace(F.get(segments, (at - 1).cast("int")), r"\d{5}\s*", "")), F.lit("")))
    street = F.when(at > 1, F.get(segments, (at - 2).cast("int")))
    zac = F.get(F.filter(segments, lambda s: F.lower(s).rlike(r"zac\s")), F.lit(0))
    return F.struct(
        F.nullif(F.trim(blank(name)), F.lit("")).alias("name"),
        commune.alias("commune"),
        code.alias("code_postal"),
        street.alias("street"),
        F.trim(F.regexp_replace(zac, r"(?i)\bde\s+", " ")).alias("zac"),
    )


def search_queries(context: Column) -> Column:
    """The company searches to try, in order: street, name with postcode, name, zone."""
    quoted = lambda a, *more: F.concat_ws(" ", F.concat(F.lit('"'), a, F.lit('"')), *more)
    c = context
    steps = (
        F.when(c["street"].isNotNull() & c["commune"].isNotNull() & c["code_postal"].isNotNull(), quoted(c["street"], c["commune"], c["code_postal"])),
        F.when(c["name"].isNotNull() & c["commune"].isNotNull() & c["code_postal"].isNotNull(), quoted(c["name"], c["commune"], c["code_postal"])),
        F.when(c["name"].isNotNull() & c["commune"].isNotNull(), quoted(c["name"], c["commune"])),
        F.when(c["zac"].isNotNull() & c["commune"].isNotNull(), quoted(c["zac"], c["commune"])),
    )
    return F.array_compact(F.array(*steps))


#: Sectors by zone tag and by type of place.
ZONE_SECTORS = {"industrial": "industrial", "retail": "retail", "commercial": "tertiary", "residential": "other"}
PLACE_SECTORS = {
    "industrial": ("industrial", "factory", "manufacturing", "plant", "warehouse", "storage", "storage_facility"),
    "retail": ("retail", "supermarket"),
    "tertiary": (
        "office", "bank", "post_office", "real_estate_agency", "insurance_agency", "accounting", "lawyer", "finance", "courthouse",
        "city_hall", "local_government_office",
    ),
}


def activity_sector(zone, place) -> Column:
    """By the zone's tag, else by the type of place, else other."""
    zones = F.create_map(*[F.lit(x) for pair in ZONE_SECTORS.items() for x in pair])
    kind, by_place = F.lower(F.trim(blank(place))), F.lit("other")
    for sector, kinds in PLACE_SECTORS.items():
        by_place = F.when(kind.isin(*kinds), sector).otherwise(by_place)
    return F.coalesce(zones[F.lower(F.trim(blank(zone)))], by_place)
