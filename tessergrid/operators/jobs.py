"""A durable job store and call limits as tables: replaying commands, deciding requests, falling back to other keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<state:string,worker:string,lease_until:double,next_attempt_at:double,checkpoint:string,created_at:double,rejected:int>"


def _step(s: Column, c: Column) -> Column:
    """What a job is after one command; commands that it does not allow are counted and change nothing."""
    late = (s["state"] == "running") & (s["lease_until"] <= c["at"]) & (c["command"] == "claim")
    state = F.when(late, "review-needed").otherwise(s["state"])
    worker = F.when(~late, s["worker"])
    lease = F.when(~late, s["lease_until"])
    is_ = lambda *names: c["command"].isin(*names)
    owned = (state == "running") & (worker == c["worker"]) & (lease > c["at"])
    allowed = F.coalesce(
        F.when(is_("enqueue"), s["state"].isNull())
        .when(is_("claim"), state.isin("pending", "deferred") & (s["next_attempt_at"] <= c["at"]))
        .when(is_("checkpoint", "defer", "complete", "review", "fail"), owned)
        .when(is_("cancel"), ~state.isin("completed", "cancelled"))
        .when(is_("retry"), state.isin("review-needed", "failed")),
        F.lit(False),
    )
    repeated = is_("enqueue") & s["state"].isNotNull()
    names = {"enqueue": "pending", "claim": "running", "checkpoint": "running", "defer": "deferred", "complete": "completed", "review": "review-needed", "fail": "failed", "cancel": "cancelled", "retry": "pending"}
    after = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), c["command"])
    held = allowed & is_("claim", "checkpoint")
    none, double = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.struct(
        F.when(allowed, after).otherwise(state).alias("state"),
        F.when(held, c["worker"]).when(allowed, none).otherwise(worker).alias("worker"),
        F.when(held, c["at"] + c["seconds"]).when(allowed, double).otherwise(lease).alias("lease_until"),
        F.when(allowed & is_("defer"), c["seconds"]).when(allowed & is_("retry", "enqueue"), 0.0).otherwise(s["next_attempt_at"]).alias("next_attempt_at"),
        F.when(allowed & is_("checkpoint"), c["value"]).otherwise(s["checkpoint"]).alias("checkpoint"),
        F.when(allowed & is_("enqueue"), c["at"]).otherwise(s["created_at"]).alias("created_at"),
        (s["rejected"] + F.when(allowed | repeated, 0).otherwise(1)).cast("int").alias("rejected"),
    )


def replay(commands: DataFrame) -> DataFrame:
    """(job, state, worker, lease_until, next_attempt_at, checkpoint, created_at, rejected) after all of a job's commands.

    ``commands`` is (job, seq, at, command, worker, seconds, value): enqueue, claim (lease of ``seconds``), checkpoint, defer (to
    the time ``seconds``), complete, review, fail, cancel, retry. A running job whose lease is over needs review once someone
    claims it; a job is kept by the worker that claimed it. A job's commands are few; they are folded in order.
    """
    start = F.lit(None).cast(STATE)
    begin = F.struct(*[start[n].alias(n) for n in ("state", "worker", "lease_until", "next_attempt_at", "checkpoint", "created_at")], F.lit(0).alias("rejected"))
    listed = F.array_sort(F.collect_list(F.struct("seq", "at", "command", "worker", "seconds", "value")))
    return commands.groupBy("job").agg(listed.alias("c")).select("job", F.aggregate("c", begin, _step).alias("s")).select("job", "s.*")


@dataclass(frozen=True)
class Limits:
    """What a provider allows: attempts and seconds for one call, requests and tokens a minute, requests, tokens and cost a day."""

    attempts: int = 5
    seconds: float = 600.0
    rpm: int = 10
    tpm: int = 10_000
    rpd: int = 100
    day_tokens: float = float("inf")
    day_cost: float = float("inf")


def decide(requests: DataFrame, calls: DataFrame, cooldowns: DataFrame, attempts: DataFrame, limits: Limits) -> DataFrame:
    """(call, outcome, next_attempt_at, reason) of each request: cached, run, deferred or failed.

    ``requests`` is (call, scope, model, at, day, reset, tokens, cost), ``calls`` (call, state, attempts, started_at, next_attempt_at,
    lease_until, why), ``cooldowns`` (scope, model, until), ``attempts`` (scope, at, day, tokens, cost). Rules go from the top:
    what is done is never asked again, then cooldowns, then the call's own state, then the day's and the minute's limits.
    """
    known = calls.select("call", "state", F.col("attempts").alias("tries"), "started_at", "next_attempt_at", "lease_until", "why")
    day = attempts.groupBy("scope", "day").agg(F.count("*").alias("day_n"), F.sum("tokens").alias("day_tokens"), F.sum("cost").alias("day_cost"))
    near = requests.select("call", "scope", "at").join(attempts.select("scope", F.col("at").alias("was"), F.col("tokens").alias("its")), "scope").where((F.col("was") > F.col("at") - 60) & (F.col("was") <= F.col("at")))
    minute = near.groupBy("call").agg(F.count("*").alias("min_n"), F.sum("its").alias("min_tokens"), F.min("was").alias("min_first"))
    both = requests.join(known, "call", "left").join(cooldowns, ["scope", "model"], "left").join(day, ["scope", "day"], "left").join(minute, "call", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    state, at = F.col("state"), F.col("at")
    fresh = (state == "deferred") & F.col("why").startswith("Provider HTTP 429") & (at - F.col("started_at") >= limits.seconds)
    spent = ~F.coalesce(fresh, F.lit(False)) & ((F.col("tries") >= limits.attempts) | ((F.col("tries") > 0) & (at - F.col("started_at") >= limits.seconds)))
    over_day = (z("day_n") >= limits.rpd) | (z("day_tokens") + F.col("tokens") > limits.day_tokens)
    over_minute = (z("min_n") >= limits.rpm) | (z("min_tokens") + F.col("tokens") > limits.tpm)
    made = lambda outcome, why, then=None: F.struct(F.lit(outcome).alias("outcome"), (F.lit(None).cast("double") if then is None else then.cast("double")).alias("next_attempt_at"), (why if isinstance(why, Column) else F.lit(why).cast("string")).alias("reason"))
    verdict = (
        F.when(state == "completed", made("cached", None))
        .when(F.col("until") > at, made("deferred", "cooldown", F.col("until")))
        .when(state.isin("failed", "review-needed"), made("failed", F.col("why")))
        .when((state == "running") & (F.col("lease_until") <= at), made("failed", "interrupted request"))
        .when(state == "running", made("deferred", "another worker owns it", F.col("lease_until")))
        .when(F.col("next_attempt_at") > at, made("deferred", F.coalesce("why", F.lit("request deferred")), F.col("next_attempt_at")))
        .when(spent, made("failed", "retry budget exhausted"))
        .when(F.col("tokens") > limits.tpm, made("failed", "one request exceeds the minute"))
        .when(over_day, made("deferred", "daily budget", F.col("reset")))
        .when(z("day_cost") + F.col("cost") > limits.day_cost, made("deferred", "daily cost", F.col("reset")))
        .when(over_minute, made("deferred", "pacing", F.col("min_first") + 60.001))
        .otherwise(made("run", None))
    )
    return both.select("call", verdict.alias("v")).select("call", "v.*")


def failover(outcomes: DataFrame) -> DataFrame:
    """(call, key_order, outcome, next_attempt_at): what a call comes to over several keys.

    ``outcomes`` is (call, key_order, outcome, next_attempt_at, reason). A result that any key has is taken; else keys are
    tried in order as long as they only wait for their quota; the soonest of those waits counts.
    """
    quota = (F.col("outcome") == "deferred") & F.coalesce(F.col("reason").startswith("Provider HTTP 429"), F.lit(False))
    per = outcomes.groupBy("call").agg(
        F.min_by(F.struct("key_order", "outcome", "next_attempt_at"), F.when(F.col("outcome") == "cached", F.col("key_order"))).alias("cached"),
        F.min_by(F.struct("key_order", "outcome", "next_attempt_at"), F.when(~quota, F.col("key_order"))).alias("settled"),
        F.min_by(F.struct("key_order", "outcome", "next_attempt_at"), F.when(quota, F.struct("next_attempt_at", "key_order"))).alias("waits"),
    )
    return per.select("call", F.coalesce("cached", "settled", "waits").alias("x")).select("call", "x.*")


def two_phase(mapped: DataFrame, refined: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, phase, pending): sources whose every region is mapped go on to be refined; a source is complete once all are refined.

    ``sources`` is (source, region), ``mapped`` and ``refined`` (region, fingerprint) with the fingerprint they were made with
    equal to the region's (``sources.fingerprint``); what was made of an older text is pending again.
    """
    done = lambda df, n: df.select("region", "fingerprint").distinct().withColumn(n, F.lit(True))
    both = sources.join(done(mapped, "m"), ["region", "fingerprint"], "left").join(done(refined, "r"), ["region", "fingerprint"], "left")
    n = both.groupBy("source").agg(F.count_if(F.col("m").isNull()).alias("to_map"), F.count_if(F.col("r").isNull()).alias("to_refine"))
    phase = F.when(F.col("to_map") > 0, "map").when(F.col("to_refine") > 0, "refine").otherwise("complete")
    return n.select("source", phase.alias("phase"), F.when(F.col("to_map") > 0, F.col("to_map")).otherwise(F.col("to_refine")).alias("pending"))
