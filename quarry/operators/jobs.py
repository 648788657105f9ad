"""A leased, retried job queue as batch transitions over tables; the stream in ``quarry.streaming.jobs`` agrees with it."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry._session import workers_see_package
from quarry.config import QueueSettings
from quarry.functions import text as X

PERMANENT = ("ingestion_error", "unprocessable_document")


#: Buckets of keys that are numbered apart when new jobs get their ids.
ID_BUCKETS = 64


def due(jobs: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """Queued jobs whose time has come."""
    return jobs.where((F.col("status") == "queued") & (F.col("next_run_at") <= F.lit(now)))


def claim(jobs: DataFrame, now, worker: str, settings: QueueSettings | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """The next ``n`` due jobs by (priority descending, id), leased to a worker, and the table with them in it.

    One owner applies transitions, so no job goes to two workers.
    """
    s = settings or QueueSettings()
    picked = due(jobs, now).orderBy(F.desc("priority"), "job_id").limit(n or s.batch_size)
    leased = picked.withColumns({
        "status": F.lit("running"), "attempt": F.col("attempt") + 1, "locked_by": F.lit(worker),
        "locked_until": F.lit(now) + F.make_dt_interval(secs=F.lit(float(s.lease_seconds)).cast("decimal(18,6)")), "started_at": F.coalesce("started_at", F.lit(now)),
    })
    return leased, jobs.join(leased.select("job_id"), "job_id", "left_anti").select(*jobs.columns).unionByName(leased.select(*jobs.columns))


def finish(jobs: DataFrame, results: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """The table after results (job_id, error_code or null, error, document_id or null).

    Success ends a job; a permanent error, or the last attempt, fails it; other errors put it back with a
    delay. Leases end; a null document_id never replaces one.
    """
    r = results.select("job_id", F.col("error_code").alias("__code"), F.col("error").alias("__error"), F.col("document_id").alias("__document"), F.lit(True).alias("__done"))
    j = jobs.join(r, "job_id", "left")
    done = F.coalesce("__done", F.lit(False))
    status = F.when(~done, F.col("status")).when(F.col("__code").isNull(), "succeeded").when(F.col("__code").isin(*PERMANENT) | (F.col("attempt") >= F.col("max_attempts")), "failed").otherwise("queued")
    later = F.lit(now) + F.make_dt_interval(secs=X.backoff_seconds(F.col("attempt")).cast("decimal(18,6)"))
    return j.withColumn("__status", status).select(*(
        {
            "status": F.col("__status"),
            "last_error": F.when(done, F.substring("__error", 1, 2000)).otherwise(F.col("last_error")),
            "document_id": F.coalesce("__document", "document_id"),
            "locked_by": F.when(~done, F.col("locked_by")),
            "locked_until": F.when(~done, F.col("locked_until")),
            "next_run_at": F.when(done & (F.col("__status") == "queued"), later).otherwise(F.col("next_run_at")),
        }.get(c, F.col(c)).alias(c)
        for c in jobs.columns
    ))


def reap(jobs: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """The table with running jobs whose lease is over queued again."""
    over = (F.col("status") == "running") & F.col("locked_until").isNotNull() & (F.col("locked_until") < F.lit(now))
    over = F.coalesce(over, F.lit(False))
    return jobs.withColumns({"status": F.when(over, "queued").otherwise(F.col("status")), "locked_by": F.when(~over, F.col("locked_by")), "locked_until": F.when(~over, F.col("locked_until"))})


def enqueue(jobs: DataFrame, new: DataFrame, alive: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """The table after requests (idempotency_key, payload), one for each key.

    A waiting or running job of the key stays; so does one that succeeded and whose document (document_id in
    ``alive``) still exists; any other starts anew in its own row; an unknown key gets a new row.
    """
    live = alive.select("document_id").distinct().withColumn("__alive", F.lit(True))
    asked = new.dropDuplicates(["idempotency_key"]).select("idempotency_key", F.col("payload").alias("__payload"), F.lit(True).alias("__asked"))
    j = jobs.join(asked, "idempotency_key", "left").join(live, "document_id", "left")
    stays = F.col("status").isin("queued", "running") | ((F.col("status") == "succeeded") & F.coalesce("__alive", F.lit(False)))
    again = F.coalesce("__asked", F.lit(False)) & ~stays
    reset = {"status": F.lit("queued"), "attempt": F.lit(0), "last_error": F.lit(None).cast("string"), "locked_by": F.lit(None).cast("string"), "locked_until": F.lit(None).cast("timestamp"), "next_run_at": F.lit(now), "payload": F.coalesce("__payload", "payload")}
    kept = j.select(*(F.when(again, reset[c]).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in jobs.columns))
    base = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("__last"))
    fresh = asked.join(jobs.select("idempotency_key"), "idempotency_key", "left_anti").crossJoin(F.broadcast(base))
    # ranks within a bucket of keys, interleaved: new, without collisions, and no task orders all requests
    bucket = F.pmod(F.xxhash64("idempotency_key"), F.lit(ID_BUCKETS))
    fresh = fresh.withColumn("__bucket", bucket).withColumn("__n", F.row_number().over(Window.partitionBy("__bucket").orderBy("idempotency_key")))
    fresh = fresh.withColumn("job_id", F.col("__last") + 1 + (F.col("__n") - 1) * ID_BUCKETS + F.col("__bucket"))
    defaults = {"status": F.lit("queued"), "attempt": F.lit(0), "max_attempts": F.lit(QueueSettings().max_attempts), "priority": F.lit(0), "next_run_at": F.lit(now), "payload": F.col("__payload"), "job_id": F.col("job_id"), "idempotency_key": F.col("idempotency_key")}
    return kept.unionByName(fresh.select(*(defaults.get(c, F.lit(None)).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns)))


# --- fold of a log of events ----------------------------------------------------------------------

#: Events of a job and what they do: enqueue, claim, success, error, permanent_error, lease_over.
START = ("none", 0, 0.0)


def step(state: tuple[str, int, float], event: str, seconds: float, settings: QueueSettings | None = None) -> tuple[str, int, float]:
    """(status, attempt, time of next run or end of lease) after an event at a time in seconds; events that do not apply change nothing."""
    s = settings or QueueSettings()
    status, attempt, at = state
    if event == "enqueue" and status in ("none", "succeeded", "failed"):
        return "queued", 0, seconds
    if event == "claim" and status == "queued" and seconds >= at:
        return "running", attempt + 1, seconds + s.lease_seconds
    if status == "running":
        if event == "success":
            return "succeeded", attempt, seconds
        if event == "permanent_error" or event == "error" and attempt >= s.max_attempts:
            return "failed", attempt, seconds
        if event == "error":
            return "queued", attempt, seconds + min(5.0 * 2 ** max(attempt - 1, 0), 300.0)
        if event == "lease_over" and seconds > at:
            return "queued", attempt, seconds
    return state


def fold(events: Iterable[tuple[str, float]], state: tuple[str, int, float] = START) -> tuple[str, int, float]:
    for event, seconds in events:
        state = step(state, event, seconds)
    return state


def fold_events(events: DataFrame) -> DataFrame:
    """job_id, status, attempt and next_at after each job's events (job_id, event_id, event, seconds), by (seconds, event_id)."""
    workers_see_package(events.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seconds", "event_id"])
        status, attempt, at = fold(zip(rows["event"], rows["seconds"], strict=True))
        return pd.DataFrame({"job_id": [rows["job_id"].iloc[0]], "status": [status], "attempt": [attempt], "next_at": [at]})

    return events.where("job_id is not null").select("job_id", "event_id", "event", "seconds").groupBy("job_id").applyInPandas(run, "job_id long, status string, attempt int, next_at double")
