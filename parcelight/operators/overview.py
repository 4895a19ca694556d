"""The overview query: filtered sites in a box, nearest to its centre first."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from . import filters


@dataclass(frozen=True)
class OverviewFilters:
    """Bounds as in the request; None leaves one open. role is owner or domiciliation."""

    box: tuple[float, float, float, float]
    footprint: tuple[float | None, float | None] = (None, None)
    parking: tuple[float | None, float | None] = (None, None)
    ratio_pct: tuple[float | None, float | None] = (None, None)
    sirens: list[str] = field(default_factory=list)
    role: str = "owner"
    division: str | None = None
    limit: int | None = None

    def __post_init__(self):
        if self.role not in ("owner", "domiciliation"):
            raise ValueError(f"unknown role {self.role!r}")
        if self.division and self.sirens and self.role == "owner":
            raise ValueError("a division can't be combined with the owner role")


def overview(sites: DataFrame, f: OverviewFilters) -> DataFrame:
    """sites (combo_id, lng, lat, footprint_sum_m2, parcel_contour_sum_m2, parking_sum_m2, owner_sirens,
    domiciliation_sirens, naf_divisions) within the box and all bounds, with distance_m, in order.

    The bounds are plain predicates that reach the scan; ordering with a limit keeps the best rows per task.
    """
    footprint, contour = F.col("footprint_sum_m2"), F.col("parcel_contour_sum_m2")
    parts = [
        filters.in_box(F.col("lng"), F.col("lat"), f.box),
        *filters.open_range(footprint, *f.footprint, filters.SURFACE_SLIDER_MAX),
        *filters.open_range(F.col("parking_sum_m2"), *f.parking, filters.SURFACE_SLIDER_MAX),
        *filters.ratio_range(footprint, contour, *f.ratio_pct),
        *filters.has_siren(F.col("owner_sirens" if f.role == "owner" else "domiciliation_sirens"), f.sirens),
        *([F.array_contains("naf_divisions", f.division)] if f.division else []),
    ]
    centre = ((f.box[0] + f.box[2]) / 2, (f.box[1] + f.box[3]) / 2)
    found = sites.filter(filters.every(parts)).withColumn("distance_m", haversine_m(F.col("lat"), F.col("lng"), F.lit(centre[1]), F.lit(centre[0])))
    return found.orderBy(F.asc_nulls_last("distance_m"), F.desc("footprint_sum_m2"), "combo_id").limit(filters.clamp_limit(f.limit, "overview"))
