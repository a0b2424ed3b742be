"""Job state, caches, limits and event-time windows, bound to ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..session import Tables
from ..streaming import jobs


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("Q1", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at, count(*) AS n_events FROM events GROUP BY user_id")
def job_state_latest(t: Tables) -> DataFrame:
    return jobs.latest_state(t.events, "user_id", "ts", "event_id", "event_type")


@query("Q1 Q6", "SELECT event_id AS id FROM events WHERE event_type = (SELECT min(event_type) FROM events) OR (value > 50 AND ts <= TIMESTAMP '2024-01-10') ORDER BY ts, event_id LIMIT 25")
def claim_queue(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("event_type")).first()[0]
    state = F.when(F.col("event_type") == first, "pending").when(F.col("value") > 50, "deferred").otherwise("complete")
    rows = _events(t).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), state.alias("state"), F.col("ts").alias("next_attempt_at"))
    return jobs.claimable(rows, "2024-01-10 00:00:00", 25).select("id")


@query("Q2", "SELECT user_id, event_type, min(event_id) AS first_call, count(*) - 1 AS cache_hits FROM events GROUP BY ALL")
def call_cache(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_call"), (F.count("*") - 1).alias("cache_hits"))


@query("Q3 Q5", "SELECT event_type, max(ts) AS next_attempt_at, arg_max(user_id, (ts, event_id)) AS last_scope FROM events GROUP BY event_type")
def cooldown(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.max("ts").alias("next_attempt_at"), F.max(F.struct("ts", "event_id", "user_id")).alias("m")).select("event_type", "next_attempt_at", F.col("m.user_id").alias("last_scope"))


@query("Q4", "SELECT event_id, least(30.0, pow(2, event_id % 9 - 1))::DOUBLE AS delay FROM events")
def backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", jobs.backoff(F.col("event_id") % 9).alias("delay"))


@query("Q2", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(t: Tables) -> DataFrame:
    made = jobs.windowed(_events(t), "ts", ["event_type"], "1 hour", None, "value")
    return made.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("Q2", """
WITH s AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours' AS gap FROM events), g AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(t: Tables) -> DataFrame:
    made = jobs.sessions(_events(t), "ts", ["user_id"], "6 hours")
    return made.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
