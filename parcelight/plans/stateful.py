"""Sessions, quotas and throttles over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import sessions as S
from .register import registry

QUERIES, ORACLES, query = registry()


@query("""
    SELECT user_id, period_start, n_calls, least(n_calls, 3) AS n_allowed, greatest(0, n_calls - 3) AS n_refused FROM (
      SELECT user_id, date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris') AS period_start, count(*) AS n_calls FROM events GROUP BY ALL)
""")
def quota_windows(spark, sf_dir):
    return S.quota_usage(table(spark, sf_dir, "events"), "user_id", "ts", 3, "day")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
    f(user_id, i, n, last) AS (SELECT user_id, i, 1::BIGINT, t FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.i, n + (e.t - last >= 21600000)::INT, CASE WHEN e.t - last >= 21600000 THEN e.t ELSE last END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, max(i) AS n_calls, max(n) AS n_accepted, max(last) AS last_accepted_ms FROM f GROUP BY 1
""")
def throttle(spark, sf_dir):
    return S.throttle(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600 * 1000)


@query("""
    WITH s AS (SELECT user_id, min(ts) AS started_at FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT user_id, event_id, started_at, ts FROM (
      SELECT e.user_id, event_id, started_at, ts, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS rn
      FROM events e JOIN s ON s.user_id = e.user_id AND ts >= started_at WHERE event_type = 'purchase') WHERE rn = 1
""")
def session_first_end(spark, sf_dir):
    found = S.first_ends(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", "signup", "purchase")
    return found.select("user_id", "event_id", "started_at", "ts")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return S.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "6 hours", "1 day")


@query("""
    WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS s FROM events),
    g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(ts) AS started_at, count(*) AS n FROM g GROUP BY user_id, k
""")
def session_windows_extra(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("started_at"), "n")


@query("""
    WITH w AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_acctbal > 3000),
    m AS (SELECT k, row_number() OVER (ORDER BY k) AS rn FROM w WHERE k NOT IN (SELECT k FROM c))
    SELECT o_orderkey, o_custkey AS k, v, coalesce(rn <= 25, false) AS lookup FROM orders LEFT JOIN c ON c.k = o_custkey LEFT JOIN m ON m.k = o_custkey
""")
def cache_read_through(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    cache = table(spark, sf_dir, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return S.geocode_plan(wanted, cache, ["k"], [F.asc("k")], 25)
