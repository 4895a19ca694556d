"""Reading sessions, quotas and throttles: batch forms and their stateful streaming counterparts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import blank
from ..operators.ranking import best_per_key

#: Fixed values.
DAY_MS, COUNTER_MAX = 24 * 3600 * 1000, 1_000_000
TERMINAL = ("converti", "perdu")
ZONE = "Europe/Paris"
QUOTAS = {
    "premium": {"bdnb": (20000, "month"), "osm": (2000, "month"), "sitadel_map": (8000, "month")},
    "starter": {"bdnb": (2000, "month"), "osm": (200, "month"), "sitadel_map": (1200, "month")},
    "demo": {"bdnb": (50, "day"), "osm": (5, "day"), "sitadel_map": (80, "day")},
}


def clamp_duration(c) -> Column:
    x = c.try_cast("double")
    return F.floor(F.least(F.lit(float(DAY_MS)), F.greatest(F.lit(0.0), F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))))).cast("long")


def clamp_counter(c) -> Column:
    x = c.try_cast("double")
    return F.floor(F.least(F.lit(float(COUNTER_MAX)), F.greatest(F.lit(0.0), F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))))).cast("long")


def clamp_share(c) -> Column:
    x = c.try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))))


def session_start_decision(viewer_ip, creator_ip, status, allow_same_ip: bool = False) -> Column:
    """'record_session', or why not: no_ip, no_creator_ip, same_ip, terminal."""
    viewer, creator = F.trim(blank(viewer_ip)), F.trim(blank(creator_ip))
    return (
        F.when(viewer == "", "no_ip")
        .when(creator == "", "no_creator_ip")
        .when((viewer == creator) & F.lit(not allow_same_ip), "same_ip")
        .when(F.lower(F.trim(blank(status))).isin(*TERMINAL), "terminal")
        .otherwise("record_session")
    )


def first_ends(events: DataFrame, key: str, kind: str, ts: str, tie: str, start: str, end: str) -> DataFrame:
    """Each session's first end after its first start; later ends change nothing."""
    starts = best_per_key(events.filter(F.col(kind) == start), [key], [F.asc(ts), F.asc(tie)]).select(key, F.col(ts).alias("started_at"))
    ends = events.filter(F.col(kind) == end).join(starts, key).filter(F.col(ts) >= F.col("started_at"))
    return best_per_key(ends, [key], [F.asc(ts), F.asc(tie)])


def is_recent(ts, now, days: int = 7) -> Column:
    return ts >= now - F.expr(f"INTERVAL {days} DAYS")


def quota_usage(calls: DataFrame, user: str, ts: str, limit: int, period: str, zone: str = ZONE) -> DataFrame:
    """Calls per user and calendar period of the zone, how many were allowed and how many refused."""
    local = F.from_utc_timestamp(ts, zone)
    start = F.date_trunc(period, local)
    used = calls.groupBy(user, start.alias("period_start")).agg(F.count(F.lit(1)).alias("n_calls"))
    return used.withColumn("n_allowed", F.least("n_calls", F.lit(limit).cast("long"))).withColumn("n_refused", F.greatest(F.lit(0).cast("long"), F.col("n_calls") - limit))


def check_quota(count, reset_at, now, limit: int, period: str, zone: str = ZONE) -> Column:
    """A struct (allowed, current): the count falls to 0 once its reset lies before the period of now."""
    start = F.date_trunc(period, F.from_utc_timestamp(now, zone))
    stale = reset_at.isNull() | (F.from_utc_timestamp(reset_at, zone) < start)
    current = F.when(stale, F.lit(0)).otherwise(F.coalesce(count, F.lit(0)))
    return F.struct((current < limit).alias("allowed"), current.alias("current"))


def throttle(calls: DataFrame, key: str, ts: str, tie: str, interval_ms: int) -> DataFrame:
    """Each key's number of calls, accepted calls and the last accepted one's milliseconds: a call is accepted if the
    interval has passed since the last accepted one. The calls of a key pass by in order, batch after batch, and only its
    counts and last time are kept, so a key may have any number of them."""
    zoneless = calls.schema[ts].dataType.simpleString() == "timestamp_ntz"  # taken as UTC
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) if zoneless else F.unix_millis(ts)
    rows = calls.select(F.col(key).alias("key"), millis.alias("t"), F.col(tie).alias("tie")).repartition("key").sortWithinPartitions("key", "t", "tie").select("key", "t")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for k, t in zip(batch["key"].to_pylist(), batch["t"].to_pylist()):
                if now is None or now[0] != k:
                    out += [now] if now else []
                    now = [k, 0, 0, None]
                now[1] += 1
                if now[3] is None or t - now[3] >= interval_ms:
                    now[2], now[3] = now[2] + 1, t
            done, out = out, []
            yield told(done, batch.schema.field("key").type)
            kind = batch.schema.field("key").type
        if now:
            yield told([now], kind)

    def told(done: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()))], ["key", "n_calls", "n_accepted", "last_accepted_ms"])

    folded = rows.mapInArrow(fold, f"key {calls.schema[key].dataType.simpleString()}, n_calls long, n_accepted long, last_accepted_ms long")
    return folded.withColumnRenamed("key", key)


def throttle_stream(calls: DataFrame, key: str, ts: str, interval_ms: int) -> DataFrame:
    """The stream's calls with `accepted`: the last accepted time of each key is kept as state."""

    def judge(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(pd.concat(list(batches))[ts]):
            ms = int(t.timestamp() * 1000)
            accepted = last is None or ms - last >= interval_ms
            last = ms if accepted else last
            out.append((keys[0], t, accepted))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, ts, "accepted"])

    kind = calls.schema[key].dataType.simpleString()
    return calls.select(key, ts).groupBy(key).applyInPandasWithState(judge, f"{key} {kind}, {ts} timestamp, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def sessions_stream(events: DataFrame, key: str, kind: str, ts: str, start: str, end: str) -> DataFrame:
    """A row per session when it ends first; ends without an open session and repeated ends give none."""

    def follow(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started = state.get if state.exists else ("none", 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(ts)
        for what, t in zip(rows[kind], rows[ts]):
            ms = int(t.timestamp() * 1000)
            if what == start and status == "none":
                status, started = "open", ms
            elif what == end and status == "open":
                status = "closed"
                out.append((keys[0], ms - started))
        state.update((status, started))
        yield pd.DataFrame(out, columns=[key, "duration_ms"])

    kind_of = events.schema[key].dataType.simpleString()
    return events.select(key, kind, ts).groupBy(key).applyInPandasWithState(follow, f"{key} {kind_of}, duration_ms long", "status string, started long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts per tumbling event-time window and kind, for batches and, with a watermark, for streams."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def geocode_plan(wanted: DataFrame, cache: DataFrame, keys: list[str], order: list[Column], most_new: int) -> DataFrame:
    """wanted with the cache's columns and `lookup`: true for the first `most_new` distinct keys that the cache lacks."""
    missing = wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")
    new = missing.orderBy(*order).limit(most_new).withColumn("lookup", F.lit(True))
    return wanted.join(cache, keys, "left").join(new, keys, "left").withColumn("lookup", F.coalesce("lookup", F.lit(False)))
