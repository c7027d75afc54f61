"""Analytics of a job-event log (job_id, ts, state, worker, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a job's state is called.
STATUS = {"PENDING": "pending", "STARTED": "running", "PROGRESS": "running", "RETRY": "running", "SUCCESS": "completed", "FAILURE": "error", "REVOKED": "error"}
NO_ERROR_TEXT = "Task failed with unknown error"


def latest_job_status(events: DataFrame, order: list[str] = ["ts"]) -> DataFrame:
    """One row per job: its newest state and status, when it was created and last updated, and the error text of a failed one.

    A job was created when its newest event says that it started, or else at its first STARTED event, and updated when that says that it was completed,
    or else at the event itself.
    """
    told = [F.col(c).cast("timestamp").alias(c) if c in events.columns else F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "completed_at")]
    last = F.max_by(F.struct("state", "error", "ts", *told), F.struct(*order))
    rows = events.groupBy("job_id").agg(last.alias("e"), F.min(F.when(F.col("state") == "STARTED", F.col("ts"))).alias("created_at"))
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("e.state")), F.lit("unknown"))
    rows = rows.select("job_id", F.col("e.state").alias("state"), name.alias("status"), F.coalesce("e.started_at", "created_at").alias("created_at"), F.coalesce("e.completed_at", "e.ts").alias("updated_at"), F.col("e.error").alias("error"))
    return rows.withColumn("error", F.when(F.col("status") == "error", F.coalesce("error", F.lit(NO_ERROR_TEXT))))


def job_stats(events: DataFrame, order: list[str] = ["ts"]) -> DataFrame:
    """How many jobs are active, scheduled and reserved by their newest state, and how many workers there are."""
    last = events.groupBy("job_id").agg(F.max_by("state", F.struct(*order)).alias("state"))
    active, scheduled, reserved = (F.count_if(F.col("state").isin(*x)) for x in (("STARTED", "PROGRESS"), ("RETRY",), ("PENDING",)))
    workers = events.agg(F.countDistinct("worker").alias("workers"))
    return last.agg(active.alias("active"), scheduled.alias("scheduled"), reserved.alias("reserved"), (active + scheduled + reserved).alias("total")).join(F.broadcast(workers.limit(1)))


def expire_results(df: DataFrame, now: Column, ttl_seconds: int = 7200, ts: str = "updated_at") -> DataFrame:
    """Rows that are younger than ``ttl_seconds``."""
    return df.where(F.col(ts) >= now - F.make_interval(secs=F.lit(ttl_seconds)))
