"""Solar, battery and money formulas as Column expressions. Rounding is floor(x + 0.5)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import once, round_half_up

#: Fixed values of the model.
USABLE_ROOF = 0.75
PANEL_AREA_M2, INVERTER_KW = 1.6, 10.0
PANEL_EUR, INVERTER_EUR = 150.0, 2000.0
BOS_EUR_PER_WP = (0.4, 0.9)
PROJECT_SHARE = (0.1, 0.2)
RETAIL_EUR, FEED_IN_EUR, ESCALATION = 0.20, 0.053, 0.03
CO2_KG_PER_KWH = 0.052
ROUND_TRIP = 0.9
DAYS_OF_MONTHS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
YEAR_DAYS = 365


def surface_to_kwp(area, efficiency_pct, ratio=None) -> Column:
    """Peak power of a roof, two decimals; 0 without area. The usable share is kept within 0.01 and 1."""
    share = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.lit(USABLE_ROOF) if ratio is None else ratio))
    return F.when(area <= 0, F.lit(0.0)).otherwise(round_half_up(area * share * (efficiency_pct / 100), 2))


def panel_count(area, width=None, length=None) -> Column:
    size = F.lit(PANEL_AREA_M2) if width is None else F.when((width > 0) & (length > 0), width * length).otherwise(PANEL_AREA_M2)
    return F.greatest(F.lit(0), F.floor(area / size)).cast("long")


def total_power_kw(panels, watts) -> Column:
    return panels * watts / 1000


def annual_production_kwh(panels, watts, sun_hours, panel_efficiency_pct, inverter_efficiency_pct) -> Column:
    return round_half_up(total_power_kw(panels, watts) * sun_hours * (panel_efficiency_pct / 100) * (inverter_efficiency_pct / 100))


def inverter_count(power_kw, inverter_kw=INVERTER_KW) -> Column:
    return F.ceil(power_kw / inverter_kw).cast("long")


def installation_price(panels, inverters, panel_eur=PANEL_EUR, inverter_eur=INVERTER_EUR, batteries=0, battery_eur=0.0) -> Column:
    return round_half_up(panels * panel_eur + inverters * inverter_eur + F.lit(batteries) * battery_eur)


def price_range(power_kw, equipment_eur) -> Column:
    """A struct (low, high): balance of system by the watt, then the project's share."""
    of = lambda k: round_half_up((equipment_eur + BOS_EUR_PER_WP[k] * power_kw * 1000) * (1 + PROJECT_SHARE[k]))
    return F.struct(of(0).alias("low"), of(1).alias("high"))


def savings(production, consumption, retail=RETAIL_EUR, feed_in=FEED_IN_EUR) -> Column:
    """A struct (self_kwh, excess_kwh, eur) without a battery."""
    own, excess = F.least(production, consumption), F.greatest(F.lit(0.0), production - consumption)
    return F.struct(own.alias("self_kwh"), excess.alias("excess_kwh"), round_half_up(own * retail + excess * feed_in).alias("eur"))


def price_factor(year, escalation=ESCALATION) -> Column:
    return F.pow(F.lit(1.0 + escalation), F.greatest(F.lit(0), F.floor(year)).cast("double"))


def projected_bill(kwh, year, retail=RETAIL_EUR, escalation=ESCALATION) -> Column:
    return round_half_up(F.greatest(F.lit(0.0), kwh) * retail * price_factor(year, escalation))


def savings_at_year(self_kwh, excess_kwh, year, retail=RETAIL_EUR, feed_in=FEED_IN_EUR, escalation=ESCALATION) -> Column:
    f = price_factor(year, escalation)
    return round_half_up(F.greatest(F.lit(0.0), self_kwh) * retail * f + F.greatest(F.lit(0.0), excess_kwh) * feed_in * f)


def retail_price_from_bill(kwh, bill) -> Column:
    return F.when((kwh > 0) & (bill > 0), bill / kwh).otherwise(RETAIL_EUR)


def break_even_years(price, yearly) -> Column:
    return F.when(yearly > 0, round_half_up(price / yearly, 1))


def co2_avoidance(consumption, self_consumption) -> Column:
    """A struct (baseline_kg, avoided_kg, pct, has_data)."""
    use, own = F.greatest(F.lit(0.0), consumption), F.greatest(F.lit(0.0), self_consumption)
    base, avoided = use * CO2_KG_PER_KWH, own * CO2_KG_PER_KWH
    pct = F.when(base > 0, F.least(F.lit(100.0), avoided / base * 100)).when(avoided > 0, 100.0).otherwise(0.0)
    return F.struct(base.alias("baseline_kg"), avoided.alias("avoided_kg"), pct.alias("pct"), ((use > 0) & (own > 0)).alias("has_data"))


def battery_target_kwh(surplus_kwh, kwp, per_kwp: float = 1.25) -> Column:
    """The capacity that takes an average day's surplus, one decimal; without surplus by peak power; null without power."""
    by_surplus = round_half_up(surplus_kwh / YEAR_DAYS / ROUND_TRIP, 1)
    return F.when(kwp <= 0, None).when(surplus_kwh > 0, by_surplus).otherwise(round_half_up(F.greatest(F.lit(0.0), kwp * per_kwp), 1))


def perfect_fit_kwp(consumption, per_kwp, roof_kwp, share: float = 0.7) -> Column:
    """Peak power for a share of the consumption, at most the roof's; the roof's if it can't be told."""
    wanted = round_half_up(consumption * share / per_kwp, 2)
    return F.when((per_kwp > 0) & (consumption > 0), F.least(wanted, roof_kwp)).otherwise(roof_kwp)


def split_evenly(total, shares: Column) -> Column:
    """total as whole numbers in proportion to shares (which add up to 1), adding up to it rounded: what rounding leaves
    goes to the last part that doesn't fall below 0 by it."""

    def settled(parts, rest):
        fits = F.array_max(F.filter(F.transform(parts, lambda x, i: F.when(x + rest >= 0, i)), lambda i: i.isNotNull()))
        return once(fits, lambda k: F.transform(parts, lambda x, i: x + F.when(i == k, rest).otherwise(F.lit(0).cast("long"))))

    def left(parts):
        return F.floor(total + 0.5) - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

    return once(F.transform(shares, lambda s: F.floor(total * s + 0.5)), lambda parts: once(left(parts), lambda rest: settled(parts, rest)))


def rounded_year(monthly: Column) -> Column:
    """The sum of twelve rounded months."""
    return F.aggregate(F.transform(monthly, lambda x: F.floor(x + 0.5)), F.lit(0).cast("long"), lambda a, x: a + x)


@dataclass(frozen=True)
class Battery:
    """Columns or numbers: capacity (kWh), power (kW) and round-trip efficiency (percent)."""

    capacity: object
    charge: object
    discharge: object
    efficiency_pct: object = 90.0
    initial: float = 0.5


_FLOWS = ("direct", "via_battery", "charged", "exported", "grid")


def _column(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def battery_fold(hours: Column, battery: Battery | None) -> Column:
    """A struct of the five flows and the final state of charge over hours, an array of structs (prod, cons) in order.

    Each hour: production serves the load, then the battery does, then the grid; what is left charges, then is exported.
    Losses are the square root of the efficiency each way.
    """
    zero = F.lit(0.0)
    if battery is None:
        capacity = charge = discharge = zero
        eta, soc = F.lit(1.0), zero
    else:
        capacity, charge, discharge = map(_column, (battery.capacity, battery.charge, battery.discharge))
        eta = F.sqrt(_column(battery.efficiency_pct) / 100)
        soc = F.greatest(zero, F.least(capacity, capacity * battery.initial))
    start = F.struct(soc.alias("soc"), *[zero.alias(f) for f in _FLOWS])

    def step(s, h):
        prod, cons = h["prod"].cast("double"), h["cons"].cast("double")
        direct = F.least(prod, cons)
        need, left = cons - direct, prod - direct
        served = F.when((need > 0) & (s["soc"] > 0), F.least(F.least(discharge, s["soc"]) * eta, need)).otherwise(zero)
        after = s["soc"] - served / eta
        stored = F.when((left > 0) & (after < capacity), F.least(capacity - after, F.least(charge, left) * eta)).otherwise(zero)
        used = stored / eta
        now = {"direct": direct, "via_battery": served, "charged": used, "exported": F.greatest(zero, left - used), "grid": F.greatest(zero, need - served)}
        return F.struct((after + stored).alias("soc"), *[(s[f] + now[f]).alias(f) for f in _FLOWS])

    return F.aggregate(hours, start, step)


def year_hours(production: Column, consumption: Column) -> Column:
    """8 760 (prod, cons) structs from two 12 x 24 arrays of typical days: months in order, a leap February, cut after
    365 days."""
    days = F.slice(F.flatten(F.array(*[F.array_repeat(F.lit(m), d) for m, d in enumerate(DAYS_OF_MONTHS)])), 1, YEAR_DAYS)
    hour = lambda m: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.struct(F.coalesce(F.get(F.get(production, m), h), F.lit(0.0)).alias("prod"), F.coalesce(F.get(F.get(consumption, m), h), F.lit(0.0)).alias("cons")))
    return F.flatten(F.transform(days, hour))


def simulate_year(production: Column, consumption: Column, battery: Battery | None) -> Column:
    """The year's flows, two decimals."""
    flows = battery_fold(year_hours(production, consumption), battery)
    return F.struct(*[round_half_up(flows[f], 2).alias(f) for f in _FLOWS])


#: The year's and the day's shapes.
MONTH_SHAPE = (1.15, 1.05, 1.0, 0.92, 0.88, 0.9, 0.95, 0.95, 0.98, 1.02, 1.1, 1.2)
HOUR_SHAPE = (
    0.015, 0.012, 0.012, 0.012, 0.014, 0.018, 0.025, 0.04, 0.055, 0.06, 0.058, 0.055,
    0.048, 0.052, 0.058, 0.06, 0.058, 0.052, 0.042, 0.032, 0.025, 0.022, 0.018, 0.016,
)
SUN_SHAPE = (0, 0, 0, 0, 0, 0, 0.02, 0.05, 0.08, 0.1, 0.11, 0.12, 0.12, 0.11, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01, 0, 0, 0, 0)
PLAUSIBLE_KWH_PER_KWP = (500.0, 2000.0)


def _half_up(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


HOUR_FRACTIONS = tuple(_half_up(h / sum(HOUR_SHAPE), 3) for h in HOUR_SHAPE)


def monthly_breakdown(annual) -> Column:
    """Twelve monthly values of an annual one, one decimal each."""
    return F.array(*[round_half_up(annual * (m / sum(MONTH_SHAPE)), 1) for m in MONTH_SHAPE])


def hourly_breakdown(annual) -> Column:
    """The hours of an average day of an annual value, three decimals each."""
    return F.array(*[round_half_up(annual / YEAR_DAYS * h, 3) for h in HOUR_FRACTIONS])


def production_day(month_kwh_per_kwp, month: int, kwp) -> Column:
    """A typical day of a month's production per kWp (month from 0), two decimals an hour."""
    daily = month_kwh_per_kwp / DAYS_OF_MONTHS[month] * kwp
    return F.array(*[round_half_up(daily * (s / sum(SUN_SHAPE)), 2) for s in SUN_SHAPE])


def consumption_day(month_kwh_per_m2, month: int, surface) -> Column:
    """A typical day of a month's consumption per square metre, three decimals an hour."""
    daily = month_kwh_per_m2 / DAYS_OF_MONTHS[month] * surface
    return F.array(*[round_half_up(daily * h, 3) for h in HOUR_FRACTIONS])


def per_kwp(stored, annual_kwh, kwp) -> Column:
    """Production per kWp: the stored one if positive, else derived if plausible, else null."""
    derived = F.when((annual_kwh > 0) & (kwp > 0), annual_kwh / kwp)
    return F.coalesce(F.when(stored > 0, stored), F.when(derived.between(*PLAUSIBLE_KWH_PER_KWP), derived))


def pick_battery(targets: DataFrame, catalog: DataFrame, target: str) -> DataFrame:
    """targets with the battery model and count nearest to the target capacity.

    From the largest model's capacity on, that model; below, the model and count of the smallest gap, then of the fewest
    units, then of the largest capacity. catalog has model, capacity_kwh, most (units of a rack; null: 20) and is small.
    """
    options = catalog.withColumn("count", F.explode(F.sequence(F.lit(1), F.coalesce("most", F.lit(20)))))
    largest = F.array_max(F.collect_list(F.struct("capacity_kwh", "model")))
    offered = options.agg(F.collect_list(F.struct("model", "capacity_kwh", "count")).alias("_o"), largest["capacity_kwh"].alias("_l"), largest["model"].alias("_m"))
    joined = targets.crossJoin(F.broadcast(offered))  # one row
    t = F.col(target)
    fit = lambda o: F.struct(F.abs(o["capacity_kwh"] * o["count"] - t).alias("gap"), o["count"].alias("count"), (-o["capacity_kwh"]).alias("minus"), o["model"].alias("model"))
    allowed = F.filter("_o", lambda o: (t < F.col("_l")) | (o["model"] == F.col("_m")))
    best = F.when(t > 0, F.array_min(F.transform(allowed, fit)))
    return joined.withColumn("battery_model", best["model"]).withColumn("battery_count", best["count"]).drop("_o", "_l", "_m")


def pick_inverter(targets: DataFrame, catalog: DataFrame, power: str, most: int = 8) -> DataFrame:
    """targets with the inverter for a power: of the models that need at most `most` units the recommended one, else the
    one of fewest units, then of most power; the catalog's first if none fits. catalog has model, power_w, recommended and
    ord and is small."""
    offered = catalog.agg(F.array_sort(F.collect_list(F.struct("ord", "model", "power_w", "recommended"))).alias("_o"))
    joined = targets.crossJoin(F.broadcast(offered))  # one row
    kw = F.col(power)
    units = lambda o: F.ceil(kw / (o["power_w"] / 1000))
    fitting = F.filter("_o", lambda o: units(o) <= most)
    liked = F.filter(fitting, lambda o: o["recommended"])
    best = F.array_min(F.transform(fitting, lambda o: F.struct(units(o).alias("n"), (-o["power_w"]).alias("minus"), o["ord"].alias("ord"), o["model"].alias("model"))))["model"]
    any_liked = F.filter("_o", lambda o: o["recommended"])
    first = F.get("_o", F.lit(0))["model"]
    chosen = F.when(~(kw > 0), F.coalesce(F.get(any_liked, F.lit(0))["model"], first)).otherwise(F.coalesce(F.get(liked, F.lit(0))["model"], best, first))
    return joined.withColumn("inverter_model", chosen).drop("_o")


def financial_summary(sites: DataFrame) -> DataFrame:
    """sites with a summary of their installation, null without roof or power.

    sites: footprint_m2, kwp, annual_per_kwp, production and consumption (12 x 24 arrays, null without profiles),
    consumption_kwh, panel_w, panel_m2, panel_eur, inverter_kw, inverter_eur, battery_kwh, battery_charge_kw,
    battery_discharge_kw, battery_pct and battery_eur (null without battery; all batteries together).
    """
    panels = F.least(F.floor(F.col("kwp") * 1000 / F.col("panel_w")), F.floor(round_half_up(F.col("footprint_m2") * USABLE_ROOF, 2) / F.col("panel_m2")))
    made = round_half_up(F.col("annual_per_kwp") * F.col("kwp"))
    flows = lambda battery: simulate_year(F.col("production"), F.col("consumption"), battery)
    battery = Battery(F.col("battery_kwh"), F.col("battery_charge_kw"), F.col("battery_discharge_kw"), F.col("battery_pct"))
    stored = F.when(F.col("battery_kwh") > 0, flows(battery)).otherwise(flows(None))
    simulated = F.col("production").isNotNull() & F.col("consumption").isNotNull() & (made > 0) & (F.col("consumption_kwh") > 0)
    fine = (F.col("footprint_m2") > 0) & (F.col("kwp") > 0)
    df = sites.withColumns({"panels": panels.cast("long"), "inverters": inverter_count(F.col("kwp"), F.col("inverter_kw")), "annual_kwh": made, "_f": F.when(simulated & fine, stored)})
    by_hours = round_half_up((F.col("_f.direct") + F.col("_f.via_battery")) * RETAIL_EUR + F.col("_f.exported") * FEED_IN_EUR)
    by_year = savings(F.col("annual_kwh"), F.col("consumption_kwh"))["eur"]
    equipment = round_half_up(F.col("panels") * F.col("panel_eur") + F.col("inverters") * F.col("inverter_eur") + F.when(F.col("_f").isNotNull(), F.coalesce("battery_eur", F.lit(0.0))).otherwise(0.0))
    df = df.withColumns({"equipment_eur": equipment, "savings_eur": F.coalesce(by_hours, by_year)})
    prices = price_range(F.col("kwp"), F.col("equipment_eur"))
    whole = F.struct(
        "panels",
        "inverters",
        "annual_kwh",
        "equipment_eur",
        "savings_eur",
        prices["low"].alias("low_eur"),
        prices["high"].alias("high_eur"),
        break_even_years(prices["low"], F.col("savings_eur")).alias("years_low"),
        break_even_years(prices["high"], F.col("savings_eur")).alias("years_high"),
        F.coalesce(F.col("_f.direct"), F.lit(0.0)).alias("direct_kwh"),
        F.coalesce(F.col("_f.via_battery"), F.lit(0.0)).alias("via_battery_kwh"),
        F.coalesce(F.col("_f.exported"), F.lit(0.0)).alias("exported_kwh"),
        F.col("_f").isNotNull().alias("from_hours"),
    )
    return df.withColumn("summary", F.when(fine, whole)).select(*sites.columns, "summary")


#: Yearly consumption in kWh per square metre by type of place, and types that stand for others.
INTENSITY = {
    "store": 168, "shopping_mall": 200, "clothing_store": 150, "electronics_store": 180, "supermarket": 350,
    "grocery_or_supermarket": 350, "convenience_store": 250, "pharmacy": 180, "gas_station": 200, "restaurant": 464, "cafe": 300,
    "bar": 350, "night_club": 400, "office": 190, "bank": 200, "real_estate_agency": 150, "lawyer": 180, "accounting": 170,
    "warehouse": 55, "storage": 50, "storage_facility": 55, "factory": 100, "industrial": 100, "manufacturing": 120, "plant": 150,
    "gym": 250, "fitness_center": 250, "sports_complex": 200, "stadium": 150, "swimming_pool": 400, "other": 170,
}
CANONICAL_PLACES = {"grocery_or_supermarket": "supermarket", "fitness_center": "gym", "storage_facility": "storage", "night_club": "bar"}


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical_place(place: Column) -> Column:
    """A type of place in lower case, under the name by which it is grouped; a blank one is `other`."""
    plain = F.coalesce(F.nullif(F.lower(F.trim(place)), F.lit("")), F.lit("other"))
    return F.coalesce(_looked_up(CANONICAL_PLACES, plain), plain)


def reference_intensity(place: Column) -> Column:
    """Yearly kWh per square metre: of the type as it is given, else of its canonical one, else of `other`."""
    given = F.coalesce(place, F.lit(""))
    return F.coalesce(_looked_up(INTENSITY, given), _looked_up(INTENSITY, canonical_place(place)), F.lit(INTENSITY["other"])).cast("double")
