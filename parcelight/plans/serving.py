"""Lookups, filters, energy shapes, sizing and nearby places over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import energy as E
from ..functions import labels
from ..functions.text import round_half_up
from ..operators import features, filters, lookups, merging
from ..session import table
from ..streaming import sessions
from .register import registry
from .spatial import _SQL_BOXES, boxes

QUERIES, ORACLES, query = registry()


def pick(key, *values):
    """values by turns."""
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


@query("""
    WITH s AS (SELECT *, [NULL, '', 'A', 'a', 'F', ' '][1 + o_orderkey % 6] AS status, 1940 + o_custkey % 90 AS y1, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1980 + o_orderkey % 50 END AS y2,
      [NULL, 'housenumber', 'street', 'municipality'][1 + o_orderkey % 4] AS kind, 0.8 + (o_orderkey % 17) / 100.0::DOUBLE AS score, (o_custkey % 37)::DOUBLE AS metres, o_orderkey % 3 = 0 AS pro, o_orderkey % 5 = 0 AS fallback, ['33318', '33063', ''][1 + o_orderkey % 3] AS city FROM orders)
    SELECT o_orderkey, status IS NULL OR trim(status) = '' OR upper(trim(status)) = 'A' AS active, (y1 BETWEEN 1990 AND 2005) OR coalesce(y2 BETWEEN 1990 AND 2005, false) AS built,
      CASE WHEN kind IS NULL OR kind NOT IN ('housenumber', 'street') THEN 'ban_type_not_address' WHEN city <> '' AND city <> '33318' THEN 'ban_citycode_mismatch'
        WHEN score < CASE WHEN pro THEN 0.88::DOUBLE ELSE 0.85::DOUBLE END + CASE WHEN fallback THEN 0.02::DOUBLE ELSE 0 END THEN 'ban_score_below_threshold'
        WHEN metres > CASE WHEN pro THEN 20 ELSE 25 END + CASE WHEN fallback THEN 5 ELSE 0 END THEN 'ban_distance_above_threshold' ELSE '' END AS refused
    FROM s
""")
def acceptance_rules(spark, sf_dir):
    """Active establishments, construction years between two bounds in either order, and reverse hits."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    years = F.array((1940 + c % 90).cast("int"), F.when(k % 4 != 0, (1980 + k % 50).cast("int")))
    accepted = filters.accepts_reverse(pick(k, None, "housenumber", "street", "municipality"), pick(k, "33318", "33063", ""), F.lit(" 33318 "), F.lit(0.8) + (k % 17) / F.lit(100.0), (c % 37).cast("double"), k % 3 == 0, k % 5 == 0)
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", filters.is_active(pick(k, None, "", "A", "a", "F", " ")).alias("active"), filters.any_year_between(F.filter(years, lambda y: y.isNotNull()), 2005, 1990, 2030).alias("built"), accepted["reason"].alias("refused"))


@query("""
    WITH t AS (SELECT p_partkey, ['bench', 'school', '', 'cafe', NULL][1 + p_partkey % 5] AS amenity, [NULL, 'playground', 'pitch', 'parking'][1 + p_partkey % 4] AS leisure, ['', ' Supermarket ', NULL][1 + p_partkey % 3] AS shop, p_partkey % 11 = 0 AS gone, CASE WHEN p_partkey % 7 = 0 THEN 'Parking' END AS landuse FROM part)
    SELECT p_partkey, NOT gone AND (coalesce(amenity, '') NOT IN ('', 'bench') OR coalesce(leisure, '') NOT IN ('', 'playground') OR trim(coalesce(shop, '')) <> '') AS interesting,
      CASE WHEN coalesce(leisure, '') = 'parking' THEN 'leisure' WHEN landuse IS NOT NULL THEN 'landuse' END AS parking, gone AS has_was
    FROM t
""")
def poi_tags(spark, sf_dir):
    """Points of interest and parking by tags; presence and removal of a key."""
    k = F.col("p_partkey")
    tags = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (("amenity", pick(k, "bench", "school", "", "cafe", None)), ("leisure", pick(k, None, "playground", "pitch", "parking")), ("shop", pick(k, "", " Supermarket ", None)), ("was:shop", F.when(k % 11 == 0, "yes")), ("landuse", F.when(k % 7 == 0, "Parking")))]))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.map_filter(tags, lambda n, v: v.isNotNull()).alias("t"))
    return rows.select("p_partkey", filters.is_interesting_poi(F.col("t")).alias("interesting"), filters.parking_tag(F.col("t"))["tag"].alias("parking"), F.map_contains_key("t", "was:shop").alias("has_was"))


@query("""
    SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00000001') OR contains(lower(s_nationkey::VARCHAR), '00000001')
""")
def text_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("code"))
    return lookups.search_text(rows, " 00000001 ", ("s_name", "code")).drop("code")


@query(f"WITH {_SQL_BOXES} SELECT id FROM b WHERE bxmax >= 1900 AND bxmin <= 3100 AND bymax >= -90 AND bymin <= 90")
def viewport_rows(spark, sf_dir):
    b, _ = boxes(spark, sf_dir)
    return b.filter(lookups.in_viewport("b", (2000.0, -80.0, 3000.0, 120.0), 0.1)).select("id")


@query(f"""
    WITH {_SQL_BOXES}, o AS (SELECT id, bxmin + 0.5 AS x, bymin + 0.5 AS y, ['00003', '99999', NULL][1 + id % 3] AS code FROM b),
    n AS (SELECT id, min(lpad((pid % 4)::VARCHAR, 5, '0')) AS new FROM o JOIN p ON x > pxmin AND x < pxmax AND y > pymin AND y < pymax GROUP BY 1)
    SELECT o.id, coalesce(new, code) AS code_insee, new IS NOT NULL AND new IS DISTINCT FROM code AS changed FROM o LEFT JOIN n ON n.id = o.id
""")
def commune_update(spark, sf_dir):
    b, p = boxes(spark, sf_dir)
    objects = b.select("id", (F.col("bxmin") + 0.5).alias("x"), (F.col("bymin") + 0.5).alias("y"), pick(F.col("id"), "00003", "99999", None).alias("code_insee"))
    parcels = p.withColumn("code_insee", F.lpad((F.col("pid") % 4).cast("string"), 5, "0"))
    return lookups.assign_commune(objects, parcels, ["id"], 128.0).select("id", "code_insee", "changed")


@query("""
    SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1) o ON o_custkey = c_custkey
""")
def lateral_first(spark, sf_dir):
    """One order of each customer, the first by priority and number."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return lookups.first_of_group(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", [F.asc("o_orderpriority"), F.asc("o_orderkey")])


@query("""
    WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), m AS (SELECT p, 'combo:' || min(o::VARCHAR) AS combo_id FROM l GROUP BY 1),
    c AS (SELECT x.o AS a, y.o AS b, count(*) AS n FROM l x JOIN l y ON x.p = y.p WHERE x.o % 40 = 1 AND y.o % 40 = 2 GROUP BY ALL),
    h AS (SELECT p, count(DISTINCT q) AS n FROM (SELECT x.p, y.p AS q FROM l x JOIN l y ON x.o = y.o WHERE x.p % 50 = 0) GROUP BY 1)
    SELECT 'combo' AS kind, p::VARCHAR AS a, combo_id AS b, NULL::BIGINT AS n FROM m UNION ALL SELECT 'shared', a::VARCHAR, b::VARCHAR, n FROM c
    UNION ALL SELECT 'hop', '', '', count(DISTINCT y.p) FROM l x JOIN l y ON x.o = y.o WHERE x.p % 50 = 0
""")
def memberships(spark, sf_dir):
    """Orders as combos of parts: each part's smallest combo, orders that share parts, parts one hop from chosen ones."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("parcels"))
    combos = lists.select(F.concat(F.lit("combo:"), F.col("l_orderkey").cast("string")).alias("combo_id"), F.col("parcels").alias("parcelle_scout_v5_ids"))
    of = features.combo_of_parcel(combos, "p").select(F.lit("combo").alias("kind"), F.col("p").alias("a"), F.col("combo_id").alias("b"), F.lit(None).cast("long").alias("n"))
    side = lambda r, n: lists.filter(F.col("l_orderkey") % 40 == r).select(F.col("l_orderkey").cast("string").alias(n), "parcels")
    shared = lookups.link_by_parcels(side(1, "a"), side(2, "b"), "a", "b").select(F.lit("shared"), "a", "b", F.size("common").cast("long"))
    parcels = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.collect_set("l_orderkey").alias("buildings"))
    hop = features.neighbours_by_building(parcels, parcels.filter("p % 50 = 0").select("p"), "p", "buildings")
    return of.union(shared).union(hop.agg(F.count(F.lit(1)).alias("n")).select(F.lit("hop"), F.lit(""), F.lit(""), "n"))


@query("""
    WITH c AS (SELECT l_orderkey AS g, lpad((l_suppkey % 20)::VARCHAR, 9, '0') AS siren, max(l_quantity)::BIGINT AS score FROM lineitem GROUP BY ALL),
    o AS (SELECT DISTINCT l_orderkey AS g, lpad((l_suppkey % 20)::VARCHAR, 9, '0') AS siren FROM lineitem WHERE l_linenumber = 1),
    r AS (SELECT c.*, score + CASE WHEN o.g IS NOT NULL THEN 20 ELSE 0 END AS total FROM c LEFT JOIN o ON o.g = c.g AND o.siren = c.siren)
    SELECT g, siren, total AS score, row_number() OVER (PARTITION BY g ORDER BY total DESC, siren) AS rank FROM r
""")
def owner_bonus(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 9, "0").alias("siren"), F.col("l_quantity").cast("long").alias("score"), "l_linenumber")
    return features.owner_bonus(lines.groupBy("g", "siren").agg(F.max("score").alias("score")), lines.filter("l_linenumber = 1"), "g", 20)


@query("""
    WITH par AS (SELECT p_partkey % 100 AS c, lpad((p_partkey % 3000)::VARCHAR, 4, '0') AS numero, min(p_size) AS x FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL),
    per AS (SELECT o_orderkey, o_custkey % 100 AS c, o_orderkey % 5 = 0 AS known, o_custkey % 3000 AS n FROM orders)
    SELECT o_orderkey, CASE WHEN known THEN -1.0 ELSE x::DOUBLE END AS x FROM per LEFT JOIN par ON par.c = per.c AND par.numero = lpad(n::VARCHAR, 4, '0')
""")
def permit_places(spark, sf_dir):
    """Permits without place take that of their parcel, whose number they give without leading zeros."""
    code = lambda c: F.lpad((F.col(c) % 100).cast("string"), 5, "0")
    parcels = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(code("p_partkey").alias("code_insee"), F.lit("AB").alias("section"), F.lpad((F.col("p_partkey") % 3000).cast("string"), 4, "0").alias("numero"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"))
    known = F.when(F.col("o_orderkey") % 5 == 0, -1.0)
    permits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("num_permis"), code("o_custkey").alias("code_commune"), F.lit(" AB").alias("section"), F.concat(F.lit("n "), (F.col("o_custkey") % 3000).cast("string")).alias("numero"), known.alias("x"), known.alias("y"))
    return lookups.locate_permits(permits, parcels).select(F.col("num_permis").alias("o_orderkey"), "x")


@query("""
    SELECT s_nationkey, floor(avg(s_acctbal) + 0.5)::BIGINT AS mean, round(avg((s_suppkey % 97)::DOUBLE), 6) AS x, array_to_string(list_sort(list(DISTINCT lpad((s_suppkey % 50)::VARCHAR, 3, '0'))), ',') AS ids,
      round(coalesce(sum((s_suppkey % 97)::DOUBLE * (s_suppkey % 5)) / nullif(sum(s_suppkey % 5), 0), avg((s_suppkey % 97)::DOUBLE)), 6) AS wx, round(avg((s_suppkey % 97)::DOUBLE), 6) AS plain
    FROM supplier GROUP BY 1
""")
def component_stats(spark, sf_dir):
    """Whole means, markers and area-weighted centroids."""
    points = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 97).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("s_suppkey") % 5).cast("double").alias("area"), F.lpad((F.col("s_suppkey") % 50).cast("string"), 3, "0").alias("i"), "s_acctbal")
    means = features.mean_by_category(points, "s_nationkey", "s_acctbal")
    marks = features.component_markers(points, "s_nationkey", "i").select("s_nationkey", round_half_up("x", 6).alias("x"), F.array_join("ids", ",").alias("ids"))
    centres = features.weighted_centroid(points, "s_nationkey", "area").select("s_nationkey", round_half_up("x", 6).alias("wx"))
    return means.join(marks, "s_nationkey").join(centres, "s_nationkey").withColumn("plain", F.col("x"))


@query("""
    WITH n AS (SELECT l_orderkey AS g, l_linenumber AS k, l_quantity::DOUBLE AS m, [1.2, 0.55, 0.5, 1.35][1 + l_partkey % 4]::DOUBLE AS t, l_suppkey % 6 = 0 AS inside FROM lineitem)
    SELECT g, k, round(0.62 / (1 + m / 30) + 0.38 * t + CASE WHEN inside THEN 0.2 ELSE 0 END, 9) AS relevance FROM n
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(0.62 / (1 + m / 30) + 0.38 * t + CASE WHEN inside THEN 0.2 ELSE 0 END, 9) DESC, k) <= 3
""")
def nearby_top(spark, sf_dir):
    """The three most relevant places of each group."""
    from ..operators.ranking import top_per_group

    types = F.when(F.col("l_partkey") % 4 == 0, F.array(F.lit("store"), F.lit("route"))).when(F.col("l_partkey") % 4 == 2, F.array(F.lit("political"))).when(F.col("l_partkey") % 4 == 3, F.array(F.lit("x"), F.lit("establishment")))
    score = round_half_up(labels.relevance(F.col("l_quantity").cast("double"), types, F.col("l_suppkey") % 6 == 0), 9)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), score.alias("relevance"))
    return top_per_group(rows, ["g"], [F.desc("relevance"), F.asc("k")], 3, "_r").drop("_r")


_MONTHS = "[1.15, 1.05, 1.0, 0.92, 0.88, 0.9, 0.95, 0.95, 0.98, 1.02, 1.1, 1.2]::DOUBLE[]"


@query(f"""
    WITH o AS (SELECT o_orderkey, floor(o_totalprice) AS a, {_MONTHS} AS s FROM orders),
    m AS (SELECT *, [floor(a * (x / 12.1::DOUBLE) * 10 + 0.5) / 10 for x in s] AS parts, [floor(a * (x / 12.1::DOUBLE) + 0.5)::BIGINT for x in s] AS whole FROM o)
    SELECT o_orderkey, parts[1] AS january, parts[5] AS may, parts[12] AS december, list_sum([floor(x + 0.5)::BIGINT for x in parts])::BIGINT AS year,
      whole[11] AS november, (whole[12] + a - list_sum(whole))::BIGINT AS last, round(a / 365 * floor((0.015 / 0.86)::DOUBLE * 1000 + 0.5) / 1000, 3) AS midnight
    FROM m
""")
def energy_breakdown(spark, sf_dir):
    """Months and hours of an annual value, whole months that add up to it, the year of rounded months."""
    a = F.floor("o_totalprice")
    months = E.monthly_breakdown(a)
    shares = F.array(*[F.lit(m / sum(E.MONTH_SHAPE)) for m in E.MONTH_SHAPE])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", months.alias("m"), E.rounded_year(months).alias("year"), E.split_evenly(a, shares).alias("s"), E.hourly_breakdown(a).alias("h"))
    at = lambda c, k: F.get(c, F.lit(k))
    return rows.select("o_orderkey", at("m", 0).alias("january"), at("m", 4).alias("may"), at("m", 11).alias("december"), "year", at("s", 10).alias("november"), at("s", 11).alias("last"), at("h", 0).alias("midnight"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS r, o_totalprice::DOUBLE AS c, (o_custkey % 900)::DOUBLE AS kwp, CASE WHEN o_orderkey % 4 = 0 THEN 1150.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN -1.0 END AS stored FROM orders),
    p AS (SELECT *, CASE WHEN kwp > 0 AND c > 0 THEN c / kwp END AS d FROM o),
    q AS (SELECT *, coalesce(CASE WHEN stored > 0 THEN stored END, CASE WHEN d BETWEEN 500 AND 2000 THEN d END) AS per_kwp FROM p),
    opt AS (SELECT m, cap, unnest(range(1, n + 1)) AS k FROM (VALUES ('s', 5.0::DOUBLE, 4), ('m', 12.0, 20), ('l', 100.0, 6)) v(m, cap, n)),
    b AS (SELECT o_orderkey, m, k FROM o JOIN opt ON kwp > 0 AND (kwp < 100 OR m = 'l') QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(cap * k - kwp), k, cap DESC) = 1)
    SELECT o_orderkey, round(per_kwp, 6) AS per_kwp, CASE WHEN per_kwp > 0 AND c > 0 THEN least(floor(c * 0.7 / per_kwp * 100 + 0.5) / 100, 80.0) ELSE 80.0 END AS fit_kwp, m AS battery, k::INT AS units
    FROM q LEFT JOIN b USING (o_orderkey)
""")
def sizing(spark, sf_dir):
    """Production per kWp, the fitting peak power, and the battery of the nearest capacity."""
    k, c, kwp = F.col("o_orderkey"), F.col("o_totalprice").cast("double"), (F.col("o_custkey") % 900).cast("double")
    stored = F.when(k % 4 == 0, 1150.0).when(k % 4 == 1, -1.0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c.alias("c"), kwp.alias("kwp"), E.per_kwp(stored, c, kwp).alias("per"))
    catalog = spark.createDataFrame([("s", 5.0, 4), ("m", 12.0, None), ("l", 100.0, 6)], "model string, capacity_kwh double, most int")
    sized = E.pick_battery(rows, catalog, "kwp")
    return sized.select("o_orderkey", round_half_up("per", 6).alias("per_kwp"), E.perfect_fit_kwp(F.col("c"), F.col("per"), F.lit(80.0)).alias("fit_kwp"), F.col("battery_model").alias("battery"), F.col("battery_count").alias("units"))


@query("""
    WITH v AS (SELECT event_id, ts, value * 100000 - 2000000 AS x FROM events)
    SELECT event_id, floor(least(86400000, greatest(0, x)))::BIGINT AS duration, floor(least(1000000, greatest(0, x)))::BIGINT AS counter, least(1.0, greatest(0.0, x)) AS share, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS recent FROM v
""")
def metric_clamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts").alias("_now"))  # one row
    x = F.col("value") * 100000 - 2000000
    rows = events.crossJoin(F.broadcast(latest))
    return rows.select("event_id", sessions.clamp_duration(x).alias("duration"), sessions.clamp_counter(x).alias("counter"), sessions.clamp_share(x).alias("share"), sessions.is_recent(F.col("ts"), F.col("_now")).alias("recent"))


@query("""
    WITH l AS (SELECT l_orderkey AS o, list(DISTINCT l_partkey) AS ps FROM lineitem GROUP BY 1)
    SELECT o, (SELECT count(*) FROM (SELECT unnest(ps) AS p) WHERE p % 3 = 0) AS n_constructions, (SELECT count(*) FROM (SELECT unnest(ps) AS p) WHERE p % 3 <> 0) AS n_groups,
      (SELECT count(*) FROM (SELECT unnest(ps) AS p UNION SELECT 1) WHERE p % 5 <> 0) AS n_effective
    FROM l
""")
def id_sets(spark, sf_dir):
    """Construction and group ids of a list; matched ids, an own one more and some removed."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list("l_partkey").alias("ps"))
    name = lambda p: F.concat(F.lit(" bdnbcstr:"), p.cast("string"), F.when(p % 3 == 0, ":1").otherwise(""))
    split = lookups.split_building_ids(F.transform("ps", lambda p: F.trim(name(p))))
    text = F.transform("ps", lambda p: p.cast("string"))
    kept = merging.effective_ids(text, F.array(F.lit("1")), F.transform(F.filter("ps", lambda p: p % 5 == 0), lambda p: p.cast("string")))
    size = lambda c: F.size(c).cast("long")
    return lines.select("o", size(split["constructions"]).alias("n_constructions"), size(split["groups"]).alias("n_groups"), size(F.array_distinct(kept)).alias("n_effective"))


@query("""
    WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 10.0::DOUBLE END AS chosen, (o_custkey % 4)::DOUBLE AS rows, o_orderkey % 5 AS n, (o_custkey % 3)::DOUBLE AS hint, o_custkey % 6 AS nh, (o_orderkey % 2)::DOUBLE AS over FROM orders)
    SELECT o_orderkey, CASE WHEN chosen IS NOT NULL THEN chosen WHEN nh > 0 AND n < nh AND hint > 0 THEN hint WHEN rows > 0 THEN rows WHEN over > 0 THEN over WHEN hint > 0 THEN hint ELSE rows END AS surface FROM s
""")
def energy_surface(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda x: x.cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", lookups.energy_footprint(F.when(k % 7 == 0, 10.0), d(c % 4), k % 5, d(c % 3), c % 6, d(k % 2)).alias("surface"))


@query("""
    WITH a AS (SELECT o_orderkey, ['12 rue A', '', NULL][1 + o_orderkey % 3] AS osm, [NULL, 'siege', ' '][1 + o_custkey % 3] AS est, ['owner', NULL][1 + o_custkey % 2] AS own, o_orderkey % 5 = 0 AS ok, [' back', ''][1 + o_orderkey % 2] AS rev, o_custkey % 4 = 0 AS fine FROM orders)
    SELECT o_orderkey, CASE WHEN coalesce(osm, '') <> '' THEN 'osm' WHEN trim(coalesce(est, '')) <> '' THEN 'sirene' WHEN own IS NOT NULL AND ok THEN 'ppm' WHEN trim(rev) <> '' AND fine THEN 'ban_reverse' ELSE 'none' END AS source,
      CASE WHEN coalesce(osm, '') <> '' THEN osm WHEN trim(coalesce(est, '')) <> '' THEN est WHEN own IS NOT NULL AND ok THEN own WHEN trim(rev) <> '' AND fine THEN trim(rev) ELSE '' END AS address FROM a
""")
def display_addresses(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    shown = features.display_address(pick(k, "12 rue A", "", None), pick(c, None, "siege", " "), pick(c, "owner", None), k % 5 == 0, pick(k, " back", ""), c % 4 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("s")).select("o_orderkey", "s.source", "s.address")


@query("""
    WITH h AS (SELECT o_orderkey, 0.6 + (o_orderkey % 40) / 100.0::DOUBLE AS score, CASE WHEN o_custkey % 9 = 0 THEN 95.0 ELSE 44.8 END AS lat, ['33318', ' 33318 ', '33063', NULL][1 + o_custkey % 4] AS city, CASE WHEN o_orderkey % 13 = 0 THEN '2A004' ELSE '33318' END AS asked FROM orders)
    SELECT o_orderkey, coalesce(asked = '33318' AND score >= 0.75::DOUBLE AND lat <= 90 AND trim(city) = asked, false) AS accepted FROM h
""")
def forward_hits(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lat = F.when(c % 9 == 0, 95.0).otherwise(44.8)
    accepted = filters.accepts_forward(F.lit(0.6) + (k % 40) / F.lit(100.0), lat, F.lit(-0.6), pick(c, "33318", " 33318 ", "33063", None), F.when(k % 13 == 0, "2A004").otherwise("33318"))
    return table(spark, sf_dir, "orders").select("o_orderkey", accepted.alias("accepted"))


@query("""
    WITH s AS (SELECT s_suppkey AS k, lpad(s_suppkey::VARCHAR, 14, '1') AS head, lpad(s_suppkey::VARCHAR, 14, '2') AS other FROM supplier),
    p AS (SELECT *, [head, other, 'x', '9'][1 + k % 4] AS asked FROM s)
    SELECT k, CASE WHEN asked = other THEN other ELSE head END AS siret, CASE WHEN asked = other AND k % 8 < 4 THEN '47.11Z' WHEN asked = head THEN '01.11Z' ELSE '62.01Z' END AS naf,
      CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'Ann Lee (Gérante)' ELSE 'Lee' END AS manager, CASE WHEN asked = other AND k % 8 < 4 THEN '11' ELSE '03' END AS workforce, CASE WHEN asked = other AND k % 8 < 4 THEN '2021' ELSE '2020' END AS workforce_year, 'N' AS name, 'H' AS address
    FROM p
""")
def company_enrichment(spark, sf_dir):
    """Head office or a second establishment as the preferred one; leaders with and without role."""
    k = F.col("s_suppkey")
    text = lambda v: F.lit(v).cast("string")
    place = lambda siret, naf, size, year: F.struct(siret.alias("siret"), F.lit("H").alias("adresse"), text(None).alias("geo_adresse"), naf.alias("activite_principale"), size.alias("tranche_effectif_salarie"), year.alias("annee_tranche_effectif_salarie"))
    head, other = F.lpad(k.cast("string"), 14, "1"), F.lpad(k.cast("string"), 14, "2")
    told = lambda v: F.when(k % 8 < 4, v).otherwise(" ")
    leader = lambda kind, last, first, role: F.struct(F.lit(kind).alias("type_dirigeant"), text(last).alias("nom"), text(first).alias("prenoms"), text(role).alias("qualite"))
    firm, nobody = leader("personne morale", "Firm", None, "x"), leader("personne physique", " ", None, "x")
    leaders = F.when(k % 3 == 0, F.array(firm, nobody)).when(k % 3 == 1, F.array(firm, leader("personne physique", "Lee", " Ann ", "Gérante"))).otherwise(F.array(leader("personne physique", "Lee", None, None)))
    company = F.struct(
        F.lit("1").alias("siren"), text(None).alias("nom_complet"), F.lit("N").alias("nom_raison_sociale"), F.lit("62.01Z").alias("activite_principale"), F.lit("03").alias("tranche_effectif_salarie"), F.lit("2019").alias("annee_tranche_effectif_salarie"),
        place(head, F.lit("01.11Z"), text(None), F.lit("2020")).alias("siege"), F.array(place(other, told("47.11Z"), told("11"), told("2021"))).alias("matching_etablissements"), leaders.alias("dirigeants"),
    )
    asked = F.when(k % 4 == 0, head).when(k % 4 == 1, other).when(k % 4 == 2, "x").otherwise("9")
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), company.alias("c"), asked.alias("asked")).select("k", features.enriched_company(F.col("c"), F.col("asked")).alias("e"))
    return rows.select("k", *[F.col(f"e.{n}") for n in ("siret", "naf", "manager", "workforce", "workforce_year", "name", "address")])
