"""Streams give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from parcelight.streaming import sessions as S


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def events(spark, tmp_path, rows):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [(u, k, at + dt.timedelta(seconds=s)) for u, k, s in rows]
    df = spark.createDataFrame(data, "user_id long, kind string, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), df.withColumn("event_id", F.monotonically_increasing_id())


def test_throttle(spark, tmp_path):
    stream, batch = events(spark, tmp_path, [(1, "x", s) for s in (0, 5, 11, 12, 20, 24)] + [(2, "x", 3)])
    rows = run(S.throttle_stream(stream, "user_id", "ts", 12_000), "throttled")
    accepted = {u: sum(r["accepted"] for r in rows if r["user_id"] == u) for u in (1, 2)}
    assert accepted == {1: 3, 2: 1}
    assert accepted == {r["user_id"]: r["n_accepted"] for r in S.throttle(batch, "user_id", "ts", "event_id", 12_000).collect()}


def test_sessions(spark, tmp_path):
    stream, batch = events(spark, tmp_path, [(1, "end", 0), (1, "start", 1), (1, "end", 4), (1, "end", 9), (2, "start", 3), (3, "end", 1)])
    rows = run(S.sessions_stream(stream, "user_id", "kind", "ts", "start", "end"), "followed")
    assert [(r["user_id"], r["duration_ms"]) for r in rows] == [(1, 3000)]
    (first,) = S.first_ends(batch, "user_id", "kind", "ts", "event_id", "start", "end").collect()
    assert (first["ts"] - first["started_at"]).total_seconds() == 3


def test_windows(spark, tmp_path):
    stream, batch = events(spark, tmp_path, [(1, "a", 0), (1, "a", 50), (1, "b", 70), (1, "a", 130)])
    got = {tuple(r) for r in run(S.windowed_counts(stream, "ts", "kind", "1 minute", "10 minutes"), "windowed", "complete")}
    assert got == {tuple(r) for r in S.windowed_counts(batch, "ts", "kind", "1 minute", "10 minutes").collect()} and len(got) == 3


def test_decisions(spark):
    df = spark.createDataFrame([(None, "c", "x"), ("v", "", "x"), ("v", "v", "x"), ("v", "c", "Perdu"), ("v", "c", "ouvert")], "v string, c string, s string")
    got = [r[0] for r in df.select(S.session_start_decision(F.col("v"), F.col("c"), F.col("s"))).collect()]
    assert got == ["no_ip", "no_creator_ip", "same_ip", "terminal", "record_session"]
    clamps = spark.createDataFrame([("-5",), ("1e12",), ("NaN",), (None,), ("0.4",)], "x string")
    rows = clamps.select(S.clamp_duration(F.col("x")), S.clamp_counter(F.col("x")), S.clamp_share(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0.0), (86_400_000, 1_000_000, 1.0), (0, 0, 0.0), (0, 0, 0.0), (0, 0, 0.4)]


def test_throttle_of_a_busy_key(spark):
    """A key with calls over many batches, one without any, and the null key."""
    from pyspark.sql import functions as F

    from parcelight.streaming import sessions

    calls = spark.range(30_000).select(F.when(F.col("id") < 25_000, "hot").when(F.col("id") < 29_990, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("u"), F.timestamp_millis(F.col("id") * 1000).alias("ts"), "id")
    got = {r["u"]: tuple(r)[1:] for r in sessions.throttle(calls, "u", "ts", "id", 12_000).collect()}
    assert got["hot"] == (25_000, 2_084, 24_996_000) and got[None] == (10, 1, 29_990_000) and len(got) == 9
    assert sessions.throttle(calls.limit(0), "u", "ts", "id", 1).collect() == []
