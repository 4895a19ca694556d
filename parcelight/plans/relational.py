"""Joins, aggregations, windows and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, merging, ranking
from ..operators.overview import OverviewFilters, overview
from ..functions.text import round_half_up
from ..session import table
from .register import registry

QUERIES, ORACLES, query = registry()

_BOX = (-1.0, -5.0, 26.0, 95.0)


def sites(spark, sf_dir):
    """Customers as sites: sums of their orders, a place from nation and balance, supplier-like codes."""
    orders = table(spark, sf_dir, "orders")
    sums = orders.groupBy("o_custkey").agg(
        round_half_up(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 100, 4).alias("footprint_sum_m2"),
        round_half_up(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("decimal(18,2)")).otherwise(0)).cast("double") / 100, 4).alias("parking_sum_m2"),
        F.array_sort(F.collect_set(F.lpad(F.col("o_orderpriority").substr(1, 1), 2, "0"))).alias("naf_divisions"),
    )
    customers = table(spark, sf_dir, "customer")
    return sums.join(customers, sums.o_custkey == customers.c_custkey).select(
        F.concat(F.lit("combo:"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("combo_id"),
        F.col("c_nationkey").cast("double").alias("lng"),
        (F.col("c_acctbal") / 120).alias("lat"),
        "footprint_sum_m2",
        (F.col("footprint_sum_m2") * 2 + 100).alias("parcel_contour_sum_m2"),
        "parking_sum_m2",
        F.array(F.lpad(F.col("c_nationkey").cast("string"), 9, "0")).alias("owner_sirens"),
        F.array(F.lpad(F.col("c_nationkey").cast("string"), 9, "1")).alias("domiciliation_sirens"),
        "naf_divisions",
    )


@query("""
    WITH sums AS (
      SELECT o_custkey, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 100, 4)::DOUBLE AS footprint_sum_m2,
        round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(18,2) ELSE 0 END)::DOUBLE / 100, 4)::DOUBLE AS parking_sum_m2,
        list(DISTINCT lpad(substr(o_orderpriority, 1, 1), 2, '0')) AS naf
      FROM orders GROUP BY 1),
    s AS (
      SELECT 'combo:' || lpad(c_custkey::VARCHAR, 9, '0') AS combo_id, c_nationkey::DOUBLE AS lng, c_acctbal / 120 AS lat,
        footprint_sum_m2, footprint_sum_m2 * 2 + 100 AS contour, parking_sum_m2, naf, lpad(c_nationkey::VARCHAR, 9, '1') AS siren
      FROM sums JOIN customer ON c_custkey = o_custkey),
    d AS (
      SELECT *, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(45.0 - lat) / 2), 2)
        + cos(radians(lat)) * cos(radians(45.0)) * pow(sin(radians(12.5 - lng) / 2), 2)))) AS distance_m
      FROM s WHERE lng BETWEEN -1 AND 26 AND lat BETWEEN -5 AND 95 AND footprint_sum_m2 > 500 AND footprint_sum_m2 <= 40000
        AND parking_sum_m2 > 100 AND contour > 0 AND footprint_sum_m2 / contour > 0.4
        AND siren IN ('111111111', '111111113', '111111117', '111111112', '111111119') AND list_contains(naf, '01'))
    SELECT combo_id, footprint_sum_m2, parking_sum_m2, round(distance_m, 2) AS distance_m
    FROM d ORDER BY d.distance_m, footprint_sum_m2 DESC, combo_id LIMIT 50
""")
def overview_topk(spark, sf_dir):
    f = OverviewFilters(
        box=_BOX,
        footprint=(500, 40_000),
        parking=(100, None),
        ratio_pct=(40, None),
        sirens=["111111111", "111111113", "111111117", "111111112", "111111119"],
        role="domiciliation",
        division="01",
        limit=50,
    )
    return overview(sites(spark, sf_dir), f).select("combo_id", "footprint_sum_m2", "parking_sum_m2", round_half_up("distance_m", 2).alias("distance_m"))


@query("""
    SELECT s_suppkey, s_name, coalesce(n, 0) AS n_lines, coalesce(n_parts, 0) AS n_parts, flags
    FROM supplier LEFT JOIN (
      SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS n_parts,
        string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags
      FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
""")
def owner_agg_left(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")
    )
    s = table(spark, sf_dir, "supplier")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return s.join(lines, s.s_suppkey == lines.l_suppkey, "left").select("s_suppkey", "s_name", zero("n_lines"), zero("n_parts"), "flags")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn
      FROM lineitem) WHERE rn = 1
""")
def distinct_on_best(spark, sf_dir):
    best = ranking.best_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""
    SELECT o_custkey, o_orderkey, rn, greatest(0, n - 5) AS truncated FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn <= 5
""")
def topn_per_group_trunc(spark, sf_dir):
    top = ranking.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 5, cut="truncated")
    return top.select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"), "truncated")


@query("""
    SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers, count(DISTINCT l_suppkey) AS n_suppliers
    FROM lineitem GROUP BY 1
""")
def array_agg_mv(spark, sf_dir):
    found = ranking.array_union_per_key(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", "suppliers", "n_suppliers")
    return found.withColumn("suppliers", F.array_join(F.transform("suppliers", lambda s: s.cast("string")), ","))


@query("""
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_final,
      count(*) FILTER (o_totalprice > 200000) AS n_large, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
    FROM orders GROUP BY 1
""")
def filter_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_final"),
        F.count_if(F.col("o_totalprice") > 200000).alias("n_large"),
        F.min("o_orderdate").alias("first_date"),
        F.max("o_orderdate").alias("last_date"),
    )


@query("""
    SELECT substr(p_name, 1, 4) AS prefix, count(*) AS n, count(DISTINCT nullif(trim(p_brand), '')) AS n_brands
    FROM part GROUP BY 1 ORDER BY n DESC, prefix LIMIT 25
""")
def prefix_top(spark, sf_dir):
    grouped = table(spark, sf_dir, "part").groupBy(F.substring("p_name", 1, 4).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.nullif(F.trim("p_brand"), F.lit(""))).alias("n_brands"))
    return grouped.orderBy(F.desc("n"), "prefix").limit(25)


@query("""
    SELECT o_custkey, o_orderpriority AS modal, n AS modal_count FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn
      FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE rn = 1
""")
def modal_value(spark, sf_dir):
    return ranking.modal_value(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("""
    SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
    WHERE l_quantity >= 30 OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 45)
""")
def exists_or_waiver(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    waivers = table(spark, sf_dir, "part").filter("p_size >= 45").select(F.col("p_partkey").alias("l_partkey"))
    return filters.floor_or_waiver(lines, "l_quantity", 30, waivers, ["l_partkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("""
    SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (
      SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 45)
""")
def semi_join(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(wanted, "s_suppkey", "left_semi")


def _keyed_rows(spark, sf_dir):
    """Customers as the stored rows and orders as the incoming ones, keyed by customer."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).cast("long").alias("o"))
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("o"))
    return old, new


@query("""
    WITH new AS (SELECT o_custkey * 2 AS k, o_orderpriority AS v, o_orderkey AS o,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
    SELECT k, v, o FROM new WHERE rn = 1
    UNION ALL SELECT c_custkey, c_name, 0 FROM customer WHERE c_custkey NOT IN (SELECT k FROM new)
""")
def upsert_latest(spark, sf_dir):
    return merging.upsert(*_keyed_rows(spark, sf_dir), ["k"], [F.desc("o")])


@query("""
    WITH new AS (SELECT o_custkey * 2 AS k, o_orderpriority AS v, o_orderkey AS o,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
    SELECT c_custkey AS k, c_name AS v, 0 AS o FROM customer
    UNION ALL SELECT k, v, o FROM new WHERE rn = 1 AND k NOT IN (SELECT c_custkey FROM customer)
""")
def insert_absent(spark, sf_dir):
    return merging.insert_absent(*_keyed_rows(spark, sf_dir), ["k"], [F.asc("o")])


@query("""
    WITH old AS (SELECT c_custkey AS k, c_name AS properties_json, c_nationkey AS section,
        CASE WHEN c_acctbal > 5000 THEN 'matched' WHEN c_acctbal > 2000 THEN 'cadastre_only' END AS match_status FROM customer),
    new AS (SELECT DISTINCT o_custkey * 2 AS k FROM orders)
    SELECT coalesce(old.k, new.k) AS k,
      CASE WHEN new.k IS NULL OR match_status = 'matched' THEN properties_json ELSE 'new' END AS properties_json,
      CASE WHEN new.k IS NULL THEN section ELSE -1 END AS section,
      CASE WHEN new.k IS NULL OR match_status = 'matched' THEN match_status ELSE 'cadastre_only' END AS match_status
    FROM old FULL JOIN new ON old.k = new.k
""")
def upsert_keeping_matched(spark, sf_dir):
    status = F.when(F.col("c_acctbal") > 5000, "matched").when(F.col("c_acctbal") > 2000, "cadastre_only")
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("properties_json"), F.col("c_nationkey").alias("section"), status.alias("match_status"))
    new = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("k")).distinct().select("k", F.lit("new").alias("properties_json"), F.lit(-1).alias("section"))
    return merging.upsert_keeping_matched(old, new, "k")


@query("""
    WITH s AS (SELECT n_name AS v, 0 AS r FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT c_mktsegment, 2 FROM customer)
    SELECT v, min(r) AS origin FROM s GROUP BY 1
""")
def set_merge(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("v"), F.lit(k).alias("origin")).distinct() for k, (t, c) in enumerate((("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment")))]
    return merging.union_by_precedence(parts, ["v"], [F.asc("v")])


@query("""
    SELECT c_custkey, n_old, n_new, CASE WHEN n_new > n_old THEN 'new' ELSE 'old' END AS side FROM (
      SELECT c_custkey, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS n_old, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS n_new
      FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
""")
def richer_merge(spark, sf_dir):
    orders, early = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    counts = orders.groupBy("c_custkey").agg(F.count_if(early).alias("n_old"), F.count_if(~early).alias("n_new"))
    old, new = counts.withColumn("side", F.lit("old")), counts.withColumn("side", F.lit("new"))
    return merging.keep_richer(old, new, "c_custkey", F.when(F.col("side") == "old", F.col("n_old")).otherwise(F.col("n_new")))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def rollup_extra(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), round_half_up(F.sum("l_quantity"), 2).alias("qty"))


@query("""
    SELECT event_id, user_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, dense_rank() OVER (PARTITION BY user_id ORDER BY value) AS value_rank
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def window_extra(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rank = F.dense_rank().over(W.partitionBy("user_id").orderBy("value")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), rank.alias("value_rank"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def set_ops_extra(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(customers.filter("c_acctbal > 0").select("c_custkey")).exceptAll(customers.filter("c_nationkey < 5").select("c_custkey"))
