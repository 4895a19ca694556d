"""Lookups, small joins and request checks of the serving side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, parcel_number
from . import filters, spatial
from .ranking import best_per_key

#: Fixed values of the parcel search.
PARCEL_ID = re.compile(r"^[A-Za-z0-9:_-]{1,120}$")
MAX_BOX_M2, MAX_COMMUNES, BUFFER_M = 1_000_000.0, 3, (5.0, 50.0)
METRES_PER_DEGREE = 111_320.0


def parse_ids(raw: str | None, most: int, pattern: re.Pattern = PARCEL_ID) -> list[str]:
    """Distinct ids of a comma-separated parameter; too many or malformed ones are an error."""
    parts = [p.strip() for p in (raw or "").split(",") if p.strip()]
    if len(parts) > most or not all(map(pattern.match, parts)):
        raise ValueError(f"not a list of at most {most} ids")
    return list(dict.fromkeys(parts))


def parse_communes(raw: str | None) -> list[str]:
    return parse_ids(raw, MAX_COMMUNES, re.compile(r"^[0-9][0-9AB][0-9]{3}$"))


def buffer_metres(raw: float | None) -> float:
    return BUFFER_M[0] if raw is None else min(BUFFER_M[1], max(0.0, raw))


def box_allowed(xmin: float, ymin: float, xmax: float, ymax: float) -> bool:
    import math

    high, wide = abs(ymax - ymin) * METRES_PER_DEGREE, abs(xmax - xmin) * METRES_PER_DEGREE * math.cos(math.radians((ymin + ymax) / 2))
    return high * wide <= MAX_BOX_M2


def in_viewport(box: str, view: tuple[float, float, float, float], padding: float) -> Column:
    """Rows whose box meets the view (xmin, ymin, xmax, ymax) grown by a fraction of its size; rows without box pass."""
    dx, dy = (view[2] - view[0]) * padding, (view[3] - view[1]) * padding
    low, high = max(-90.0, view[1] - dy), min(90.0, view[3] + dy)
    c = lambda side: F.col(box + side)
    meets = (c("xmax") >= view[0] - dx) & (c("xmin") <= view[2] + dx) & (c("ymax") >= low) & (c("ymin") <= high)
    return F.coalesce(meets, F.lit(True))


def search_text(rows: DataFrame, asked: str, columns: tuple[str, ...] = ("code", "label")) -> DataFrame:
    """Rows of which a column contains the text, in any case; all for an empty text."""
    q = asked.strip().lower()
    if not q:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(blank(c)), F.lit(q))
    return rows.filter(found)


def records_where(rows: DataFrame, equal: dict[str, str], order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Document lookups: equality, order, limit."""
    found = rows.filter(filters.every([F.col(k) == v for k, v in equal.items()]))
    found = found.orderBy(*order) if order else found
    return found.limit(limit) if limit else found


def assign_commune(objects: DataFrame, parcels: DataFrame, key: list[str], cell: float) -> DataFrame:
    """objects (key, x, y, code_insee) with the commune of the parcel that holds their point; of several the smallest
    code; unchanged where none does. `changed` marks those whose code differs."""
    box = spatial.box_columns("p")
    codes = parcels.filter(F.col("code_insee").isNotNull()).select(*box, F.col("code_insee").alias("_new"))
    codes = spatial.uncovered(codes, "p", ["_new"], cell)  # a parcel in another of no larger code decides nothing
    held = spatial.points_in_boxes(objects.select(*key, "x", "y"), codes, "x", "y", "p", cell)
    found = held.groupBy(*key).agg(F.min("_new").alias("_new"))
    joined = objects.join(found.hint("merge"), key, "left")
    differs = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("code_insee"))
    return joined.withColumn("changed", differs).withColumn("code_insee", F.coalesce("_new", "code_insee")).drop("_new")


def first_of_group(rows: DataFrame, extras: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with one row of extras per key, the first in order (null if there is none)."""
    return rows.join(best_per_key(extras, [key], order), key, "left")


def link_by_parcels(parkings: DataFrame, buildings: DataFrame, parking: str, building: str, parcels: str = "parcels") -> DataFrame:
    """(parking, building, common): pairs that share a parcel, with the sorted parcels that they share."""
    p, b = parkings.select(parking, F.explode(parcels).alias("_p")), buildings.select(building, F.explode(parcels).alias("_p"))
    return p.join(b, "_p").groupBy(parking, building).agg(F.array_sort(F.collect_set("_p")).alias("common"))


def locate_permits(permits: DataFrame, parcels: DataFrame) -> DataFrame:
    """permits (num_permis, code_commune, section, numero, x, y) with places filled in from parcels (code_insee, section,
    numero, x, y): the number as it is, padded, then its digits; the first that is found counts. Places that are known
    stay."""
    forms = F.array(F.trim(blank("numero")), parcel_number("numero"), F.regexp_replace(blank("numero"), r"\D", ""))
    missing = permits.filter(F.col("x").isNull() | F.col("y").isNull())
    tries = missing.select("num_permis", F.col("code_commune").alias("code_insee"), F.trim("section").alias("section"), F.posexplode(forms).alias("_k", "numero"))
    number = ["code_insee", "section", "numero"]
    once = best_per_key(parcels.withColumnsRenamed({"x": "_x", "y": "_y"}), number, [F.asc("_x"), F.asc("_y")])  # many parcels of one number: the first
    hits = tries.filter(filters.has_text(F.col("numero"))).join(once.hint("merge"), number)
    best = best_per_key(hits, ["num_permis"], [F.asc("_k"), F.asc("_x"), F.asc("_y")]).select("num_permis", "_x", "_y")
    joined = permits.join(best, "num_permis", "left")
    return joined.withColumn("x", F.coalesce("x", "_x")).withColumn("y", F.coalesce("y", "_y")).drop("_x", "_y")


def split_building_ids(ids: Column) -> Column:
    """A struct of construction ids (with a colon) and group ids, without blanks and the source's prefix."""
    plain = F.filter(F.transform(ids, lambda i: F.regexp_replace(F.trim(i), "^bdnbcstr:", "")), lambda i: i != "")
    return F.struct(F.array_distinct(F.filter(plain, lambda i: F.contains(i, F.lit(":")))).alias("constructions"), F.array_distinct(F.filter(plain, lambda i: ~F.contains(i, F.lit(":")))).alias("groups"))


def energy_footprint(selected, from_rows, n_rows, hint, hint_rows, overview) -> Column:
    """The surface for energy: of the chosen buildings; of the loaded parcels, or the hint if these are incomplete; then
    the overview's and the hint's."""
    incomplete = (hint_rows > 0) & (n_rows < hint_rows)
    return (
        F.when(selected.isNotNull(), selected)
        .when(incomplete & (hint > 0), hint)
        .when(from_rows > 0, from_rows)
        .when(overview > 0, overview)
        .when(hint > 0, hint)
        .otherwise(from_rows)
    )
