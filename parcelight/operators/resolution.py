"""Owners of parcels and buildings that straddle parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from . import filters
from .ranking import modal_value

PARCEL = ["code_insee", "section", "numero_norm"]


def owners_by_parcel(owners: DataFrame) -> DataFrame:
    """owners (parcel key, siren, denomination, address) to a row per parcel: sirens (sorted), siren_rows (rows of each),
    address (the most frequent, the smallest on a tie, also of rows without a valid code), n_rows and status."""
    valid = F.trim(blank("siren")).rlike(r"^\d{9}$")
    rows = owners.withColumn("_siren", F.when(valid, F.trim(F.col("siren")))).withColumn("_address", F.nullif(F.trim(blank("address")), F.lit("")))
    counts = rows.filter(F.col("_siren").isNotNull()).groupBy(*PARCEL, "_siren").agg(F.count(F.lit(1)).cast("int").alias("n"))
    by_siren = counts.groupBy(*PARCEL).agg(F.array_sort(F.collect_list("_siren")).alias("sirens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_siren", "n")))).alias("siren_rows"))
    address = modal_value(rows, PARCEL, "_address", "address", "address_rows").drop("address_rows")
    whole = rows.groupBy(*PARCEL).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = whole.join(by_siren, PARCEL, "left").join(address, PARCEL, "left")
    return joined.withColumn("owner_status", filters.owner_bucket(F.coalesce(F.size("sirens"), F.lit(0))))


def resolve_shared_buildings(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """A row per building of several parcels: the parcel it goes to, decision, siren and the candidates.

    pairs has building_id, the parcel key and intersection_area_m2; owners is by parcel. If all parcels share an owner,
    the one with the most rows over them (the smallest on a tie) decides, and of its parcels the one that the building
    covers most wins, the largest key on a tie; without a shared owner the parcels are compared alike.
    """
    by_parcel = pairs.groupBy("building_id", *PARCEL).agg(F.greatest(F.coalesce(F.max("intersection_area_m2"), F.lit(0.0)), F.lit(0.0)).alias("area"))
    # A building has few parcels, so they meet in one array and the rest needs no further shuffle. They become arrays after it
    # only: arrays made on both sides take more memory than rows.
    joined = by_parcel.join(owners.select(*PARCEL, "siren_rows"), PARCEL, "left").repartition("building_id")
    some = lambda p: F.coalesce(F.map_keys(p["siren_rows"]), F.array().cast("array<string>"))
    whole = joined.groupBy("building_id").agg(F.count(F.lit(1)).alias("n_parcels"), F.max(F.struct("area", *PARCEL)).alias("widest"), F.collect_list(F.struct("siren_rows")).alias("_p"))
    many = whole.filter("n_parcels > 1")
    common = F.aggregate("_p", some(F.get("_p", F.lit(0))), lambda kept, p: F.array_intersect(kept, some(p)))
    many = many.withColumn("shared_sirens", F.array_sort(common))
    rows = lambda s: F.aggregate("_p", F.lit(0), lambda n, p: n + F.coalesce(F.try_element_at(p["siren_rows"], s), F.lit(0)))
    best = F.array_min(F.transform("shared_sirens", lambda s: F.struct((-rows(s)).alias("minus"), s.alias("siren"))))["siren"]
    # A shared owner is one of every parcel, so the widest parcel wins either way.
    return many.select(
        "building_id",
        *[F.col(f"widest.{k}").alias(k) for k in PARCEL],
        F.lit("partage").alias("matching_status"),
        F.when(best.isNull(), "unique_by_intersection").otherwise("shared_siren").alias("matching_decision"),
        F.coalesce(best, F.lit("")).alias("matching_siren_selected"),
        "shared_sirens",
        "n_parcels",
    )


def buildings_of_parcels(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The pairs with how each building stands on its parcel. A building of several parcels stays on every parcel that it
    covers: matching_status is mono or partage, matching_decision and matching_siren_selected say why, assigned marks the
    parcel that it was given to, and shared_candidate the parcels that any such building touches."""
    won = resolved.select("building_id", F.struct(*PARCEL).alias("_won"), "matching_decision", "matching_siren_selected")
    joined = pairs.join(won, "building_id", "left")
    shared = F.col("_won").isNotNull()
    touched = joined.filter(shared).select(*PARCEL).distinct().withColumn("shared_candidate", F.lit(True))
    marked = joined.withColumns(
        {
            "matching_status": F.when(shared, "partage").otherwise("mono"),
            "matching_decision": F.coalesce("matching_decision", F.lit("mono")),
            "matching_siren_selected": F.coalesce("matching_siren_selected", F.lit("")),
            "assigned": ~shared | (F.col("_won") == F.struct(*PARCEL)),
        }
    ).drop("_won")
    return marked.join(touched, PARCEL, "left").withColumn("shared_candidate", F.coalesce("shared_candidate", F.lit(False)))


def export_parcels(buildings: DataFrame, least: float = filters.EXPORT_MIN, least_shared: float = filters.SHARED_EXPORT_MIN) -> DataFrame:
    """A row per parcel whose buildings reach the threshold: footprint_sum_m2, building count and the nested buildings."""
    waived = (F.col("zone_source") == "landuse") & F.lower(blank("zone_tag")).isin(*filters.WAIVER_LANDUSE)
    footprint = F.when((F.col("footprint_m2") > 0) & ~F.isnan("footprint_m2"), F.col("footprint_m2")).otherwise(0.0)
    rows = buildings.groupBy(*PARCEL).agg(
        F.sum(footprint).alias("footprint_sum_m2"),
        F.count(F.lit(1)).alias("n_buildings"),
        F.bool_or(waived).alias("has_waiver"),
        F.bool_or("shared_candidate").alias("shared_candidate"),
        F.array_sort(F.collect_list(F.struct("building_id", "footprint_m2", "zone_tag", "zone_source"))).alias("buildings"),
    )
    return rows.filter(filters.meets_export_threshold(F.col("footprint_sum_m2"), F.col("has_waiver"), F.col("shared_candidate"), least, least_shared))
