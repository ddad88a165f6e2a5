"""Registered streaming queries: each drives a stream over the events file to
completion (availableNow) and returns the sink table (K2 stream, K6-K9, A8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shoplens.plans.base import register, ts_text
from shoplens.plans.q_online import DELTA_SQL
from shoplens.session import ensure_checkpoint_dir
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views
from shoplens.streaming import live as L


def event_stream(spark, d):
    return X.events_from(L.read_event_files(spark, d, "events.parquet"))


@register("live_kpis", with_views(["ev"], """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       CAST(count_if(event_type = 'view') AS BIGINT) AS views, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks,
       CAST(count_if(event_type = 'add_to_cart') AS BIGINT) AS add_to_cart FROM ev GROUP BY 1"""))
def q_live_kpis(spark, d):
    r = L.run_available(L.live_kpis(event_stream(spark, d), "1 day"), "kpis", ["window_start"], "update")
    return r.select(ts_text("window_start").alias("window_start"), "views", "clicks", "add_to_cart")


@register("live_sessions", with_views(["ev"], """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_events
FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM (
      SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                       OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM ev))
GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM ev)"""))
def q_live_sessions(spark, d):
    """Append mode: a session is emitted once the watermark (max event time seen,
    no extra delay) has passed its end; sessions still open are not final."""
    r = L.run_available(L.live_sessions(event_stream(spark, d), "30 minutes", watermark="0 seconds"),
                        "sessions")
    return r.select("user_id", ts_text("session_start").alias("session_start"),
                    ts_text("session_end").alias("session_end"), "n_events")


@register("dedup_late", with_views(["ev"], """
SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM ev"""))
def q_dedup_late(spark, d):
    """All events, half of them twice; then, to the restarted stream, all of them again, late or known by then."""
    raw = X.table(spark, d, "events")
    folder = f"{ensure_checkpoint_dir(spark)}/dedup-{uuid.uuid4().hex[:12]}"
    for more in (raw.unionByName(raw.where(F.col("event_id") % 2 == 0)), raw):
        more.write.mode("append").parquet(f"{folder}/input")
        stream = L.dedup_late(X.events_from(L.read_event_files(spark, f"{folder}/input")), "1 hour")
        r = L.run_available(stream, "dedup", folder=f"{folder}/stream")
    return r.select("event_id", "user_id", "event_type", ts_text("ts").alias("ts"))


@register("live_popularity", with_views(["ev"], """
SELECT item_id, count(*) AS interactions FROM ev WHERE event_type IN ('click', 'view') GROUP BY item_id"""))
def q_live_popularity(spark, d):
    r = L.run_available(L.live_popularity(event_stream(spark, d)), "popularity", ["item_id"], "update")
    return r.select("item_id", "interactions")


@register("stream_co_cart", with_views(["ev"], """
SELECT item_a, item_b, weight, strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated FROM pairs""",
                                       DELTA_SQL))
def q_stream_co_cart(spark, d):
    """K1/K2 as a stream: lists a user and weights a pair, kept up batch by batch."""
    return L.run_co_cart(event_stream(spark, d), "cocart").select("item_a", "item_b", "weight", ts_text("last_updated").alias("last_updated"))
