"""Arrays, JSON and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import energy, records
from ..operators.ranking import facet_counts as facets
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()


@query("SELECT event_id, (props->>'k')::INT AS k, (props->>'missing') AS missing, (props->>'k')::INT > 50 AS high FROM events")
def json_extract(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int, missing string").alias("p"))
    return parsed.select("event_id", "p.k", "p.missing", (F.col("p.k") > 50).alias("high"))


@query("SELECT event_type AS value, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def facet_counts(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("types"))
    return facets(users, F.col("types"))


@query("""
    SELECT o_orderkey, '[' || string_agg('{"part":' || l_partkey || ',"qty":' || l_quantity::INT || '}', ',' ORDER BY l_partkey, l_quantity) || ']' AS lines, count(*) AS n_lines
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def nested_json(spark, sf_dir):
    item = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty"))
    # Narrow rows go to their order before they become lists: lists made on both sides of a shuffle take far more memory.
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), item.alias("_i")).repartition("o_orderkey")
    lines = rows.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("_i")).alias("_l"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey")
    return joined.select("o_orderkey", F.to_json("_l").alias("lines"), F.size("_l").cast("long").alias("n_lines"))


@query("SELECT l_partkey AS part, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")
def explode_json(spark, sf_dir):
    rows = nested_json(spark, sf_dir).select("o_orderkey", F.explode(F.from_json("lines", "array<struct<part:long,qty:int>>")).alias("l"))
    return rows.groupBy(F.col("l.part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text)) AS n_chars FROM conversations GROUP BY 1")
def ordered_lists(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.sum(F.length("text")).alias("n_chars"))
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("roles"), "n_chars")


@query("""
    WITH c AS (SELECT c_custkey AS k, c_nationkey, c_acctbal FROM customer)
    SELECT k, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 + (k % 3 = 0)::INT END AS n, CASE WHEN k % 7 > 0 THEN lpad(k::VARCHAR, 14, '0') END AS siret,
      CASE WHEN k % 7 > 0 THEN lpad(c_nationkey::VARCHAR, 2, '0') END AS band, CASE WHEN k % 7 > 0 THEN c_nationkey || 'Z' END AS activity,
      CASE WHEN k % 7 > 0 AND k % 5 > 0 THEN k * 1.5 END AS score,
      CASE WHEN k % 7 = 0 THEN '—' ELSE ['0 salarié', '1 ou 2', '3 à 5', '6 à 9', '10 à 19', '20 à 49', '50 à 99', '100 à 199', '200 à 249', '250 à 499', '500 à 999', '1 000 à 1 999', '2 000 à 4 999', '5 000 à 9 999',
        '14', '15', '16', '17', '18', '19', '20', '21', '22', '23', '24'][1 + c_nationkey] END AS band_label
    FROM c
""")
def matched_records(spark, sf_dir):
    """Customers as matched establishments in JSON, under the field names of different sources; each seventh is cut off."""
    k, band, activity = F.col("c_custkey"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.concat(F.col("c_nationkey").cast("string"), F.lit("Z"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    score = F.when(k % 5 == 0, F.lit('"unknown"')).when(k % 2 == 0, quoted((k * 1.5).cast("string"))).otherwise((k * 1.5).cast("string"))
    one = F.concat(F.lit('{"siret":'), quoted(F.lpad(k.cast("string"), 14, "0")), F.lit(',"'), pick(*records.SIRET_FIELDS["tranche_effectifs"]), F.lit('":'), quoted(band), F.lit(',"'), pick(*records.SIRET_FIELDS["activite_principale"]), F.lit('":'), quoted(activity), F.lit(',"score":'), score, F.lit("}"))
    more = F.when(k % 3 == 0, F.lit(',{"siret":"2"},{"siret":" "},7')).otherwise("")
    raw = F.when(k % 7 == 0, F.concat(F.lit("["), one)).otherwise(F.concat(F.lit("["), one, more, F.lit("]")))
    found = table(spark, sf_dir, "customer").select(k.alias("k"), records.matched_sirets(raw).alias("m"))
    first = F.get("m", F.lit(0))
    return found.select("k", F.size("m").alias("n"), first["siret"].alias("siret"), first["tranche_effectifs"].alias("band"), first["activite_principale"].alias("activity"), first["score"].alias("score"), records.workforce_label(first["tranche_effectifs"]).alias("band_label"))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'supermarket' WHEN 1 THEN 'gym' WHEN 2 THEN 'office' WHEN 3 THEN 'other' ELSE lower(p_brand) END AS place,
      CASE p_partkey % 5 WHEN 0 THEN 350.0 WHEN 1 THEN 250.0 WHEN 2 THEN 190.0 ELSE 170.0 END AS intensity FROM part
""")
def place_intensity(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 5 == 0, "grocery_or_supermarket").when(F.col("p_partkey") % 5 == 1, " Fitness_Center ").when(F.col("p_partkey") % 5 == 2, "office").when(F.col("p_partkey") % 5 == 4, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", energy.canonical_place(kind).alias("place"), energy.reference_intensity(kind).alias("intensity"))
