"""Resolution, combos, energy and money."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import energy as E
from ..operators import filters, resolution
from ..operators.components import connected_components
from ..functions.text import round_half_up
from ..session import materialize, table
from .register import registry

QUERIES, ORACLES, query = registry()


@query("""
    WITH RECURSIVE edges AS (SELECT DISTINCT o_custkey AS c, 2147483648 | l_suppkey AS s, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    e AS (SELECT c, s AS a, p AS b FROM edges UNION SELECT c, p, s FROM edges),
    reach(c, n, m) AS (SELECT DISTINCT c, a, a FROM e UNION SELECT r.c, e.b, r.m FROM reach r JOIN e ON e.c = r.c AND e.a = r.n)
    SELECT c AS customer, n AS node, min(m) AS component FROM reach GROUP BY ALL
""")
def components(spark, sf_dir):
    """Suppliers and parts that a customer's orders connect; a node's number has the customer in its upper half and a bit
    that tells suppliers from parts."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    at = F.shiftleft("o_custkey", 32)
    ends = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(at.bitwiseOR(F.col("l_suppkey")).bitwiseOR(F.lit(1 << 31)).alias("a"), at.bitwiseOR(F.col("l_partkey")).alias("b"))
    found, low = connected_components(ends, block=lambda node: F.shiftright(node, 32)), F.lit((1 << 32) - 1)
    return found.select(F.shiftright("node", 32).alias("customer"), F.col("node").bitwiseAND(low).alias("node"), F.col("component").bitwiseAND(low).alias("component"))


def _owner_pairs(spark, sf_dir):
    """Orders as buildings, suppliers as parcels, their nation and size class as owners."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    number = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    pairs = lines.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("intersection_area_m2"))
    pairs = pairs.select(F.col("l_orderkey").cast("string").alias("building_id"), F.lit("33318").alias("code_insee"), F.lit("AB").alias("section"), number.alias("numero_norm"), "intersection_area_m2")
    code = lambda c, lead: F.lpad(c.cast("string"), 9, lead)
    owners = suppliers.select(
        F.lit("33318").alias("code_insee"),
        F.lit("AB").alias("section"),
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("numero_norm"),
        F.explode(F.array(code(F.col("s_nationkey") % 3, "1"), code(F.col("s_suppkey") % 2, "2"), code(F.col("s_suppkey") % 2, "2"), F.lit("bad"))).alias("siren"),
        F.lit("d").alias("denomination"),
        F.concat(F.lit("a"), F.col("s_nationkey").cast("string")).alias("address"),
    )
    return pairs, owners


@query("""
    WITH pairs AS (SELECT l_orderkey AS b, l_suppkey AS s, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS a FROM lineitem GROUP BY ALL),
    own AS (SELECT s_suppkey AS s, lpad((s_nationkey % 3)::VARCHAR, 9, '1') AS siren, 1 AS n FROM supplier UNION ALL SELECT s_suppkey, lpad((s_suppkey % 2)::VARCHAR, 9, '2'), 2 FROM supplier),
    many AS (SELECT b, count(*) AS k, max(a) AS top FROM pairs GROUP BY 1 HAVING count(*) > 1),
    shared AS (SELECT b, siren, sum(n) AS n FROM pairs JOIN own USING (s) JOIN many USING (b) GROUP BY b, siren, k HAVING count(*) = k),
    best AS (SELECT b, siren FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, siren) AS rn FROM shared) WHERE rn = 1),
    lists AS (SELECT b, string_agg(siren, ',' ORDER BY siren) AS all_sirens FROM shared GROUP BY 1),
    wide AS (SELECT b, lpad(max(s)::VARCHAR, 6, '0') AS numero FROM pairs JOIN many USING (b) WHERE a = top GROUP BY 1)
    SELECT b::VARCHAR AS building_id, numero AS numero_norm, CASE WHEN siren IS NULL THEN 'unique_by_intersection' ELSE 'shared_siren' END AS matching_decision,
      coalesce(siren, '') AS siren, coalesce(all_sirens, '') AS shared_sirens, k AS n_parcels
    FROM many JOIN wide USING (b) LEFT JOIN best USING (b) LEFT JOIN lists USING (b)
""")
def argmax_assign(spark, sf_dir):
    pairs, owners = _owner_pairs(spark, sf_dir)
    found = resolution.resolve_shared_buildings(pairs, resolution.owners_by_parcel(owners))
    return found.select("building_id", "numero_norm", "matching_decision", F.col("matching_siren_selected").alias("siren"), F.array_join("shared_sirens", ",").alias("shared_sirens"), "n_parcels")


@query("""
    SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS numero_norm, lpad((s_nationkey % 3)::VARCHAR, 9, '1') || ',' || lpad((s_suppkey % 2)::VARCHAR, 9, '2') AS sirens, 'a' || s_nationkey AS address, 'multiple' AS owner_status, 4 AS n_rows
    FROM supplier
""")
def owner_rows(spark, sf_dir):
    found = resolution.owners_by_parcel(_owner_pairs(spark, sf_dir)[1])
    return found.select("numero_norm", F.array_join("sirens", ",").alias("sirens"), "address", "owner_status", "n_rows")


@query("""
    WITH pairs AS (SELECT l_orderkey AS b, l_suppkey AS s, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS a FROM lineitem GROUP BY ALL),
    k AS (SELECT *, count(*) OVER (PARTITION BY b) AS k, row_number() OVER (PARTITION BY b ORDER BY a DESC, s DESC) AS rn FROM pairs),
    sh AS (SELECT DISTINCT s FROM k WHERE k > 1),
    kept AS (SELECT k.*, (b % 700)::DOUBLE AS fp, CASE WHEN b % 9 = 0 THEN 'retail' ELSE 'residential' END AS tag FROM k)
    SELECT lpad(s::VARCHAR, 6, '0') AS numero_norm, sum(fp) AS footprint_sum_m2, count(*) AS n_buildings, bool_or(tag = 'retail') AS has_waiver, s IN (SELECT s FROM sh) AS shared_candidate
    FROM kept GROUP BY s HAVING CASE WHEN s IN (SELECT s FROM sh) THEN sum(fp) > 500 ELSE sum(fp) > 400 OR bool_or(tag = 'retail') END
""")
def parcel_export(spark, sf_dir):
    pairs, owners = _owner_pairs(spark, sf_dir)
    kept = resolution.buildings_of_parcels(pairs, resolution.resolve_shared_buildings(pairs, resolution.owners_by_parcel(owners)))
    number = F.col("building_id").cast("long")
    kept = kept.withColumns({"footprint_m2": (number % 700).cast("double"), "zone_tag": F.when(number % 9 == 0, "retail").otherwise("residential"), "zone_source": F.lit("landuse")})
    return resolution.export_parcels(kept).select("numero_norm", "footprint_sum_m2", "n_buildings", "has_waiver", "shared_candidate")


@query("""
    SELECT p_partkey, CASE WHEN lu IN ('commercial', 'industrial', 'retail', 'education', 'religious', 'military', 'port', 'depot') THEN lu WHEN am IS NOT NULL THEN am WHEN lu <> '' THEN lu
        WHEN bu <> '' THEN bu WHEN bl <> '' AND bl <> 'yes' THEN CASE WHEN bl = 'school' THEN 'education' ELSE bl END ELSE '' END AS tag,
      CASE WHEN lu IN ('commercial', 'industrial', 'retail', 'education', 'religious', 'military', 'port', 'depot') THEN 'landuse' WHEN am IS NOT NULL THEN 'amenity' WHEN lu <> '' THEN 'landuse'
        WHEN bu <> '' THEN 'building_use' WHEN bl <> '' AND bl <> 'yes' THEN 'building' ELSE 'none' END AS source
    FROM (SELECT p_partkey, ['retail', 'residential', '', 'port', ''][1 + p_partkey % 5] AS lu, [NULL, 'education', NULL, 'hospital', NULL, NULL, NULL][1 + p_partkey % 7] AS am,
      ['', '', 'office'][1 + p_partkey % 3] AS bu, ['yes', 'school', 'shed', ''][1 + p_partkey % 4] AS bl FROM part)
""")
def zone_tags(spark, sf_dir):
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("p_partkey") % len(v)).cast("int"))
    z = filters.zone_tag(pick("Retail", "residential", None, "port", " "), pick("", None, "office"), pick("yes", "school", "shed", ""), pick(None, "school", "bank", "hospital", "", None, None))
    return table(spark, sf_dir, "part").select("p_partkey", z.alias("z")).select("p_partkey", "z.tag", "z.source")


@query("""
    WITH o AS (SELECT o_orderkey, o_totalprice / 10 AS area, o_totalprice / 4 AS cons FROM orders),
    k AS (SELECT *, floor(area * 0.75 * (21.5 / 100) * 100 + 0.5) / 100 AS kwp, greatest(0, floor(area / 1.6))::BIGINT AS panels FROM o),
    p AS (SELECT *, panels * 425.0 / 1000 AS kw, ceil(panels * 425.0 / 1000 / 10.0)::BIGINT AS inverters FROM k),
    m AS (SELECT *, floor(kw * 1250.0 * (21.5 / 100) * (97.0 / 100) + 0.5) AS prod, floor(panels * 150.0 + inverters * 2000.0 + 0.5) AS price FROM p),
    s AS (SELECT *, floor(least(prod, cons) * 0.2 + greatest(0, prod - cons) * 0.053 + 0.5) AS saved FROM m)
    SELECT o_orderkey, kwp, panels, inverters, prod AS production_kwh, price AS price_eur, floor((price + 0.4 * kw * 1000) * 1.1 + 0.5) AS low_eur, floor((price + 0.9 * kw * 1000) * 1.2 + 0.5) AS high_eur,
      saved AS saved_eur, CASE WHEN saved > 0 THEN floor(price / saved * 10 + 0.5) / 10 END AS years,
      round(least(prod, cons) * 0.052, 4) AS avoided_kg, floor(cons * 0.2 * pow(1.03, 5) + 0.5) AS bill_year5
    FROM s
""")
def finance_columns(spark, sf_dir):
    area, cons = F.col("o_totalprice") / 10, F.col("o_totalprice") / 4
    df = table(spark, sf_dir, "orders").select("o_orderkey", cons.alias("cons"), E.surface_to_kwp(area, F.lit(21.5)).alias("kwp"), E.panel_count(area).alias("panels"))
    df = df.withColumn("kw", E.total_power_kw(F.col("panels"), F.lit(425.0))).withColumn("inverters", E.inverter_count(F.col("kw")))
    df = df.withColumn("production_kwh", E.annual_production_kwh(F.col("panels"), 425.0, 1250.0, F.lit(21.5), F.lit(97.0))).withColumn("price_eur", E.installation_price(F.col("panels"), F.col("inverters")))
    df = df.withColumn("s", E.savings(F.col("production_kwh"), F.col("cons"))).withColumn("r", E.price_range(F.col("kw"), F.col("price_eur")))
    return df.select(
        "o_orderkey",
        "kwp",
        "panels",
        "inverters",
        "production_kwh",
        "price_eur",
        F.col("r.low").alias("low_eur"),
        F.col("r.high").alias("high_eur"),
        F.col("s.eur").alias("saved_eur"),
        E.break_even_years(F.col("price_eur"), F.col("s.eur")).alias("years"),
        round_half_up(E.co2_avoidance(F.col("cons"), F.col("s.self_kwh"))["avoided_kg"], 4).alias("avoided_kg"),
        E.projected_bill(F.col("cons"), F.lit(5)).alias("bill_year5"),
    )


@query("""
    WITH RECURSIVE h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY hour) AS i, prod, cons FROM (
        SELECT user_id, date_trunc('hour', ts) AS hour, sum(CASE WHEN event_type = 'view' OR event_type = 'click' THEN value::DECIMAL(18,2) ELSE 0 END)::DOUBLE AS prod,
          sum(CASE WHEN event_type = 'view' OR event_type = 'click' THEN 0 ELSE value::DECIMAL(18,2) END)::DOUBLE AS cons FROM events GROUP BY ALL)),
    f(user_id, i, soc, direct, via, charged, exported, grid) AS (
      SELECT DISTINCT user_id, 0::BIGINT, 100.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM h
      UNION ALL
      SELECT user_id, i, after + stored, direct + d, via + served, charged + stored / 0.9, exported + greatest(0, lft - stored / 0.9), grid + greatest(0, need - served) FROM (
        SELECT *, CASE WHEN lft > 0 AND after < 200 THEN least(200 - after, least(80, lft) * 0.9) ELSE 0 END AS stored FROM (
          SELECT *, soc - served / 0.9 AS after FROM (
            SELECT *, CASE WHEN need > 0 AND soc > 0 THEN least(least(60, soc) * 0.9, need) ELSE 0 END AS served FROM (
              SELECT f.user_id, h.i, f.soc, f.direct, f.via, f.charged, f.exported, f.grid, least(h.prod, h.cons) AS d, h.cons - least(h.prod, h.cons) AS need, h.prod - least(h.prod, h.cons) AS lft
              FROM f JOIN h ON h.user_id = f.user_id AND h.i = f.i + 1)))))
    SELECT user_id, round(direct, 3) AS direct, round(via, 3) AS via_battery, round(charged, 3) AS charged, round(exported, 3) AS exported, round(grid, 3) AS grid, round(soc, 3) AS soc
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS rn FROM f) WHERE rn = 1
""")
def battery_fold(spark, sf_dir):
    cents = F.col("value").cast("decimal(18,2)")
    makes = F.col("event_type").isin("view", "click")
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum(F.when(makes, cents).otherwise(0)).cast("double").alias("prod"), F.sum(F.when(makes, 0).otherwise(cents)).cast("double").alias("cons")
    )
    folded = hours.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("hour", "prod", "cons"))).alias("h"))
    flows = E.battery_fold(F.col("h"), E.Battery(200.0, 80.0, 60.0, 81.0))
    return folded.select("user_id", flows.alias("f")).select("user_id", *[round_half_up(f"f.{c}", 3).alias(c) for c in ("direct", "via_battery", "charged", "exported", "grid", "soc")])


@query("""
    SELECT p_partkey, 'combo' AS kind, count(*) AS n_lines, round(sum(DISTINCT CASE WHEN l_quantity > 0 THEN l_quantity ELSE 0 END), 2) AS dedup_qty
    FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1
""")
def dedup_sums(spark, sf_dir):
    from ..operators.combos import dedup_sum

    lines = table(spark, sf_dir, "lineitem").withColumn("item", F.col("l_quantity").cast("string")).withColumnRenamed("l_partkey", "p_partkey")
    sums = dedup_sum(lines, "p_partkey", "item", ["l_orderkey", "l_linenumber", "l_suppkey"], "l_quantity", "dedup_qty")
    counts = lines.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return table(spark, sf_dir, "part").select("p_partkey").join(counts, "p_partkey").join(sums, "p_partkey").select("p_partkey", F.lit("combo").alias("kind"), "n_lines", round_half_up("dedup_qty", 2).alias("dedup_qty"))


@query("""
    WITH RECURSIVE line AS (SELECT o_custkey AS c, l_suppkey AS s, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    e AS (SELECT DISTINCT c, 1 AS k, s AS a, p AS b FROM line UNION SELECT DISTINCT c, 2, p, s FROM line),
    reach(c, k, n, m) AS (SELECT DISTINCT c, 1, s, s FROM line UNION SELECT r.c, 3 - r.k, e.b, r.m FROM reach r JOIN e ON e.c = r.c AND e.k = r.k AND e.a = r.n),
    comp AS (SELECT c, k, n, min(m) AS m FROM reach GROUP BY ALL),
    par AS (SELECT comp.c, m, n AS s, 'p' || lpad(comp.c::VARCHAR, 9, '0') || '-' || lpad(n::VARCHAR, 9, '0') AS id, count(*) AS lines FROM comp JOIN line ON line.c = comp.c AND line.s = n WHERE k = 1 GROUP BY ALL),
    a AS (SELECT c, m, sha256('combo:' || string_agg(id, '|' ORDER BY id)) AS combo_sha256, min(id) AS anchor, count(*) AS n_parcels, sum(lines)::DOUBLE AS contour, max(CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END) AS own FROM par GROUP BY ALL),
    b AS (SELECT c, m, sum(n % 50 + 1)::DOUBLE AS footprint, array_to_string(list_sort(list(DISTINCT 1900 + n % 120)), ',') AS years, bool_or(n % 11 = 0) AS waiver,
      sum(CASE WHEN n % 2 = 0 THEN 100.0 + n % 7 ELSE 0 END) AS parking FROM comp WHERE k = 2 GROUP BY ALL)
    SELECT combo_sha256, anchor, n_parcels, contour, footprint, years, waiver, parking::DOUBLE AS parking, CASE WHEN own = 1 THEN '333333333' ELSE '' END AS owners FROM a JOIN b USING (c, m)
""")
def combos(spark, sf_dir):
    """A customer's suppliers as parcels and its parts as buildings that straddle them."""
    from ..operators.combos import build_combos

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    lines = materialize(lines.select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k")), "lines")  # read five times below
    number = F.concat(F.lit("p"), pad("c"), F.lit("-"), pad("s")).alias("scout_v5_id")
    rows = lines.select(number, F.concat(F.lit("b"), pad("c"), F.lit("-"), pad("k")).alias("batiment_construction_id"), "k", "s")
    parcels = lines.groupBy("c", "s").agg(F.count(F.lit(1)).cast("double").alias("contour_m2")).select(number, pad("c").alias("code_insee"), F.lit("A").alias("section"), pad("s").alias("numero_norm"), F.lit(0.0).alias("footprint_sum_m2"), "contour_m2", F.lit(None).cast("string").alias("zone_tag"))
    buildings = rows.select(
        "scout_v5_id",
        "batiment_construction_id",
        F.concat(F.lit("w:"), F.col("k").cast("string")).alias("osm_building_id"),
        (F.col("k") % 50 + 1).cast("double").alias("footprint_m2"),
        (F.col("k") % 120 + 1900).cast("string").alias("annee_construction"),
        F.when(F.col("k") % 11 == 0, "retail").otherwise("residential").alias("zone_tag"),
        F.lit("landuse").alias("zone_source"),
        F.lit("yes").alias("building_tag"),
        F.lit("partage").alias("matching_status"),
        F.lit(0).alias("ord"),
    )
    # A relation of negative number and the closed way of the same number are one parking.
    kind = F.when(F.col("s") % 2 == 0, "r").otherwise("w")
    parkings = rows.filter("k % 2 = 0").select("scout_v5_id", kind.alias("osm_parking_type"), F.when(kind == "r", -F.col("k") - 1).otherwise(F.col("k") + 1).alias("osm_parking_id"), (F.col("k") % 7 + 100).cast("double").alias("parking_area_m2"), F.lit(0).alias("ord"))
    sirens = lines.filter("s % 3 = 0").select("c", "s").distinct().select(number, F.lit("owner").alias("role"), F.lit("333333333").alias("siren"), F.lit(None).cast("string").alias("ape"))
    found = build_combos(parcels, buildings, parkings, sirens)
    return found.select(
        F.sha2("combo_id", 256).alias("combo_sha256"),
        F.col("anchor_parcelle_id").alias("anchor"),
        F.size("parcelle_scout_v5_ids").cast("long").alias("n_parcels"),
        F.col("parcel_contour_sum_m2").alias("contour"),
        F.col("footprint_sum_m2").alias("footprint"),
        F.array_join(F.transform("construction_years", lambda y: y.cast("string")), ",").alias("years"),
        F.col("has_landuse_waiver").alias("waiver"),
        F.col("parking_sum_m2").alias("parking"),
        F.array_join("owner_sirens", ",").alias("owners"),
    )


@query()
def company_match(spark, sf_dir):
    """Every part's name as a street of its type's commune and its size as a number, matched to all parts as
    establishments."""
    from ..functions.text import normalize_text
    from ..operators.company_match import match_establishments

    parts = table(spark, sf_dir, "part")
    number, street = F.col("p_size").cast("string"), normalize_text("p_name")
    empty = F.lit("")
    asked = parts.select(F.col("p_type").alias("code_insee"), street.alias("voie"), number.alias("n")).distinct()
    queries = asked.select(F.concat_ws("|", "code_insee", "voie", "n").alias("query_id"), "code_insee", F.array("n").alias("numbers"), empty.alias("indice_q"), "voie", empty.alias("commune_q"), empty.alias("cp_q"))
    known = parts.select(F.col("p_type").alias("code_insee"), F.lpad(F.col("p_partkey").cast("string"), 14, "0").alias("siret"), F.lpad((F.col("p_partkey") % 97).cast("string"), 9, "0").alias("siren"), number.alias("numero"), empty.alias("indice"), street.alias("voie"), empty.alias("commune"), empty.alias("cp"))
    found = match_establishments(queries, known)
    return found.select("query_id", "status_technique", "status_metier", "siret_count", "matching_confidence", "matching_reason")
