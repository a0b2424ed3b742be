"""Durable job state, rate windows and event-time aggregates, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def latest_state(events: DataFrame, job: str, time: str, tie: str, state: str) -> DataFrame:
    """(job, state, at): the state each job was last put in; one pre-aggregated shuffle."""
    last = events.groupBy(job).agg(F.max(F.struct(time, tie, state)).alias("m"), F.count("*").alias("n_events"))
    return last.select(job, F.col(f"m.{state}").alias("state"), F.col(f"m.{time}").alias("at"), "n_events")


def claimable(jobs: DataFrame, now: str, k: int) -> DataFrame:
    """The k oldest jobs that are pending, or deferred to a time that has come; by (created_at, id)."""
    due = (F.col("state") == "pending") | ((F.col("state") == "deferred") & (F.col("next_attempt_at") <= F.lit(now).cast("timestamp")))
    return jobs.where(due).orderBy("created_at", "id").limit(k)


def expire_leases(jobs: DataFrame, now: str) -> DataFrame:
    """Running jobs whose lease has run out need review."""
    late = (F.col("state") == "running") & (F.col("lease_until") < F.lit(now).cast("timestamp"))
    return jobs.withColumn("state", F.when(late, "review-needed").otherwise(F.col("state")))


def backoff(attempt, jitter=0.0):
    """Seconds to wait after the nth failure: doubling from 1, at most 30, stretched by the jitter."""
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt.cast("double") - 1)) * (1 + jitter)


def windowed(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None, value: str, late: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; a watermark lets a stream forget what can no longer change."""
    if late is not None:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    if late is not None:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


class JobStates(StatefulProcessor):
    """Streaming form of ``latest_state``: one value of state per job, updated by event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("state", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get()) if self.last.exists() else None
        for pdf in rows:
            for at, tie, state in zip(pdf["at"], pdf["tie"], pdf["state"], strict=True):
                if best is None or (at, tie) > best[:2]:
                    best = (int(at), int(tie), state)
        self.last.update(best)
        yield pd.DataFrame({"job": [key[0]], "state": [best[2]], "at": [best[0]]})

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame) -> DataFrame:
    """A stream of (job, at, tie, state) events to a stream of each job's state as it changes (update mode)."""
    return events.groupBy("job").transformWithStateInPandas(JobStates(), "job bigint, state string, at bigint", "Update", "None")
