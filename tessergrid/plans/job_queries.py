"""Replaying a job store, deciding requests under limits, and two-phase processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..registry import query
from ..session import Tables
from .fixtures import Fixture

COMMANDS = Fixture(
    "commands",
    "job string, seq int, at double, command string, worker string, seconds double, value string",
    (
        ("a", 1, 0.0, "enqueue", None, None, None), ("a", 2, 1.0, "enqueue", None, None, None), ("a", 3, 2.0, "claim", "w1", 10.0, None), ("a", 4, 3.0, "checkpoint", "w1", 20.0, "half"), ("a", 5, 22.0, "complete", "w1", None, None), ("a", 6, 30.0, "cancel", None, None, None),
        ("b", 1, 0.0, "enqueue", None, None, None), ("b", 2, 1.0, "claim", "w1", 5.0, None), ("b", 3, 2.0, "claim", "w2", 5.0, None), ("b", 4, 3.0, "fail", "w2", None, None), ("b", 5, 6.0, "complete", "w1", None, None), ("b", 6, 7.0, "claim", "w2", 5.0, None), ("b", 7, 8.0, "retry", None, None, None), ("b", 8, 9.0, "claim", "w2", 5.0, None),
        ("c", 1, 0.0, "enqueue", None, None, None), ("c", 2, 1.0, "claim", "w1", 5.0, None), ("c", 3, 2.0, "defer", "w1", 50.0, None), ("c", 4, 10.0, "claim", "w1", 5.0, None), ("c", 5, 50.0, "claim", "w3", 5.0, None), ("c", 6, 51.0, "fail", "w3", None, None),
        ("d", 1, 5.0, "claim", "w1", 5.0, None), ("d", 2, 6.0, "enqueue", None, None, None), ("d", 3, 7.0, "cancel", None, None, None), ("d", 4, 8.0, "retry", None, None, None), ("d", 5, 9.0, "claim", "w1", 1.0, None),
        ("e", 1, 0.0, "enqueue", None, None, None), ("e", 2, 1.0, "claim", "w1", 5.0, None), ("e", 3, 2.0, "review", "w1", None, None), ("e", 4, 3.0, "retry", None, None, None), ("f", 1, 4.0, "enqueue", None, None, None),
    ),
)


@query("Q1 Q6", """
SELECT * FROM (VALUES
  ('a', 'completed', NULL, NULL::DOUBLE, 0.0::DOUBLE, 'half', 0.0::DOUBLE, 1::INTEGER), ('b', 'running', 'w2', 14.0, 0.0, NULL, 0.0, 4), ('c', 'failed', NULL, NULL, 50.0, NULL, 0.0, 1),
  ('d', 'cancelled', NULL, NULL, 0.0, NULL, 6.0, 3), ('e', 'pending', NULL, NULL, 0.0, NULL, 0.0, 0), ('f', 'pending', NULL, NULL, 0.0, NULL, 4.0, 0)) v(job, state, worker, lease_until, next_attempt_at, checkpoint, created_at, rejected)""")
def job_replay(t: Tables) -> DataFrame:
    return J.replay(COMMANDS.frame(t.spark))


REQUESTS = Fixture(
    "requests",
    "call string, scope string, model string, at double, day string, reset double, tokens int, cost double",
    (
        ("done", "s", "m", 100.0, "d1", 900.0, 10, 0.1), ("cool", "s", "hot", 100.0, "d1", 900.0, 10, 0.1), ("doneCool", "s", "hot", 100.0, "d1", 900.0, 10, 0.1), ("bad", "s", "m", 100.0, "d1", 900.0, 10, 0.1), ("torn", "s", "m", 100.0, "d1", 900.0, 10, 0.1), ("held", "s", "m", 100.0, "d1", 900.0, 10, 0.1),
        ("wait", "s", "m", 100.0, "d1", 900.0, 10, 0.1), ("worn", "s", "m", 100.0, "d1", 900.0, 10, 0.1), ("old", "s", "m", 1000.0, "d1", 900.0, 10, 0.1), ("again", "s", "m", 1000.0, "d1", 900.0, 10, 0.1), ("huge", "s", "m", 100.0, "d1", 900.0, 5001, 0.1), ("fine", "s", "m", 100.0, "d1", 900.0, 10, 0.1),
        ("fast", "t", "m", 100.0, "d1", 900.0, 10, 0.1), ("later", "t", "m", 130.5, "d1", 900.0, 10, 0.1), ("fat", "s", "m", 100.0, "d1", 900.0, 4990, 0.1), ("day", "u", "m", 500.0, "d1", 900.0, 10, 0.1), ("dear", "s", "m", 100.0, "d1", 900.0, 10, 9.9), ("next", "u", "m", 1000.0, "d2", 1900.0, 10, 0.1), ("new", "z", "m", 1.0, "d1", 9.0, 1, 0.0),
    ),
)
CALLS = Fixture(
    "calls",
    "call string, state string, attempts int, started_at double, next_attempt_at double, lease_until double, why string",
    (
        ("done", "completed", 1, 0.0, 0.0, None, None), ("doneCool", "completed", 1, 0.0, 0.0, None, None), ("bad", "failed", 1, 0.0, 0.0, None, "no"), ("torn", "running", 1, 0.0, 0.0, 100.0, None), ("held", "running", 1, 0.0, 0.0, 101.0, None), ("wait", "deferred", 1, 0.0, 150.0, None, "slow down"),
        ("worn", "deferred", 5, 90.0, 0.0, None, "Provider HTTP 429"), ("old", "deferred", 1, 0.0, 0.0, None, "Provider HTTP 500"), ("again", "deferred", 5, 0.0, 0.0, None, "Provider HTTP 429: quota"), ("fine", "pending", 0, 0.0, 0.0, None, None),
    ),
)
COOLDOWNS = Fixture("cooldowns", "scope string, model string, until double", (("s", "hot", 160.0), ("t", "hot", 1.0), ("s", "m", 90.0)))
ATTEMPTS = Fixture(
    "attempts",
    "scope string, at double, day string, tokens int, cost double",
    (("s", 60.0, "d1", 11, 0.2), ("s", 40.0, "d1", 9, 0.2), ("t", 45.0, "d1", 10, 0.0), ("t", 70.0, "d1", 10, 0.0), ("t", 99.0, "d1", 10, 0.0), ("u", 1.0, "d1", 1, 0.0), ("u", 2.0, "d1", 1, 0.0), ("u", 3.0, "d1", 1, 0.0), ("u", 4.0, "d1", 1, 0.0), ("u", 5.0, "d0", 1, 0.0)),
)
LIMITS = J.Limits(attempts=5, seconds=600, rpm=3, tpm=5000, rpd=4, day_cost=10)


@query("Q2 Q4", f"""
WITH {REQUESTS.sql}, {CALLS.sql}, {COOLDOWNS.sql}, {ATTEMPTS.sql}, j AS (
  SELECT r.*, c.state, c.attempts AS tries, c.started_at, c.next_attempt_at AS nxt, c.lease_until, c.why, k.until,
    (SELECT count(*) FROM attempts a WHERE a.scope = r.scope AND a.day = r.day) AS dn, (SELECT coalesce(sum(cost), 0) FROM attempts a WHERE a.scope = r.scope AND a.day = r.day) AS dc,
    (SELECT count(*) FROM attempts a WHERE a.scope = r.scope AND a."at" > r."at" - 60 AND a."at" <= r."at") AS mn, (SELECT coalesce(sum(tokens), 0) FROM attempts a WHERE a.scope = r.scope AND a."at" > r."at" - 60 AND a."at" <= r."at") AS mt,
    (SELECT min(a."at") FROM attempts a WHERE a.scope = r.scope AND a."at" > r."at" - 60 AND a."at" <= r."at") AS mf
  FROM requests r LEFT JOIN calls c ON c.call = r.call LEFT JOIN cooldowns k ON k.scope = r.scope AND k.model = r.model
), o AS (
  SELECT *, CASE WHEN state = 'completed' THEN 1 WHEN until > "at" THEN 2 WHEN state IN ('failed', 'review-needed') THEN 3 WHEN state = 'running' AND lease_until <= "at" THEN 4 WHEN state = 'running' THEN 5 WHEN nxt > "at" THEN 6
    WHEN (tries >= 5 OR tries > 0 AND "at" - started_at >= 600) AND NOT coalesce(state = 'deferred' AND why LIKE 'Provider HTTP 429%' AND "at" - started_at >= 600, false) THEN 7 WHEN tokens > 5000 THEN 8 WHEN dn >= 4 THEN 9 WHEN dc + cost > 10 THEN 10 WHEN mn >= 3 OR mt + tokens > 5000 THEN 11 ELSE 12 END AS n FROM j
)
SELECT call, CASE WHEN n = 1 THEN 'cached' WHEN n IN (3, 4, 7, 8) THEN 'failed' WHEN n = 12 THEN 'run' ELSE 'deferred' END AS outcome,
  CASE n WHEN 2 THEN until WHEN 5 THEN lease_until WHEN 6 THEN nxt WHEN 9 THEN reset WHEN 10 THEN reset WHEN 11 THEN mf + 60.001 END AS next_attempt_at,
  CASE n WHEN 2 THEN 'cooldown' WHEN 3 THEN why WHEN 4 THEN 'interrupted request' WHEN 5 THEN 'another worker owns it' WHEN 6 THEN coalesce(why, 'request deferred') WHEN 7 THEN 'retry budget exhausted' WHEN 8 THEN 'one request exceeds the minute' WHEN 9 THEN 'daily budget' WHEN 10 THEN 'daily cost' WHEN 11 THEN 'pacing' END AS reason FROM o""")
def call_decisions(t: Tables) -> DataFrame:
    return J.decide(*[x.frame(t.spark) for x in (REQUESTS, CALLS, COOLDOWNS, ATTEMPTS)], LIMITS)


_KEYS = Fixture(
    "outcomes",
    "call string, key_order int, outcome string, next_attempt_at double, reason string",
    (
        ("a", 1, "deferred", 50.0, "Provider HTTP 429"), ("a", 2, "cached", None, None), ("b", 1, "deferred", 50.0, "Provider HTTP 429"), ("b", 2, "run", None, None), ("b", 3, "run", None, None), ("c", 1, "deferred", 50.0, "Provider HTTP 429 x"), ("c", 2, "deferred", 40.0, "Provider HTTP 429"),
        ("d", 1, "deferred", 50.0, "Provider HTTP 429"), ("d", 2, "deferred", 90.0, "cooldown"), ("d", 3, "run", None, None), ("e", 1, "failed", None, "no"), ("e", 2, "run", None, None),
    ),
)


@query("Q5", "SELECT * FROM (VALUES ('a', 2, 'cached', NULL::DOUBLE), ('b', 2, 'run', NULL), ('c', 2, 'deferred', 40.0), ('d', 2, 'deferred', 90.0), ('e', 1, 'failed', NULL)) v(call, key_order, outcome, next_attempt_at)")
def key_failover(t: Tables) -> DataFrame:
    return J.failover(_KEYS.frame(t.spark))


@query("Q9 Q10", """
WITH s AS (SELECT conv_id AS source, conv_id * 100000 + turn AS region, sha256(text) AS fingerprint, role, text FROM conversations),
j AS (SELECT source, length(text) > 40 AS m, length(text) > 40 AND role <> 'user' AS r, length(text) > 40 AND contains(text, 'q') AS changed FROM s),
n AS (SELECT source, count(*) FILTER (WHERE NOT m OR changed) AS a, count(*) FILTER (WHERE NOT r) AS b FROM j GROUP BY source)
SELECT source, CASE WHEN a > 0 THEN 'map' WHEN b > 0 THEN 'refine' ELSE 'complete' END AS phase, CASE WHEN a > 0 THEN a ELSE b END AS pending FROM n""")
def resumable_pending(t: Tables) -> DataFrame:
    """Regions are turns; what was mapped from an older text, here those with a q, is pending again."""
    regions = t.conversations.select(F.col("conv_id").alias("source"), (F.col("conv_id") * 100000 + F.col("turn")).alias("region"), F.sha2("text", 256).alias("fingerprint"), "role", "text")
    long_ = regions.where(F.char_length("text") > 40)
    mapped = long_.withColumn("fingerprint", F.when(F.contains("text", F.lit("q")), F.sha2(F.upper("text"), 256)).otherwise(F.col("fingerprint")))
    return J.two_phase(mapped, long_.where("role <> 'user'"), regions)
