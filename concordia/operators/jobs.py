"""Job and review queues as state tables: every operator takes an explicit time and returns the new state of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE = "INTERVAL 15 MINUTES"
MAX_REOPENS = 3


def claim(jobs: DataFrame, as_of: Column, owner: str, limit: int) -> DataFrame:
    """Lease the limit oldest jobs that are pending and due: running, with an owner and 15 minutes."""
    due = jobs.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of)).orderBy("created_at", "job_id").limit(limit)
    return due.withColumns({"status": F.lit("running"), "lease_owner": F.lit(owner), "lease_expires_at": as_of + F.expr(LEASE), "attempt": F.col("attempt") + 1, "updated_at": as_of})


def sweep(jobs: DataFrame, as_of: Column) -> DataFrame:
    """All jobs, those whose lease has run out back to pending, or quarantined after their last attempt."""
    late = (F.col("status") == "running") & (F.col("lease_expires_at") < as_of)
    back = F.when(F.col("attempt") >= F.col("max_attempts"), "quarantined").otherwise("pending")
    return jobs.withColumns({"status": F.when(late, back).otherwise(F.col("status")), "lease_owner": F.when(~late, F.col("lease_owner")), "lease_expires_at": F.when(~late, F.col("lease_expires_at")), "updated_at": F.when(late, as_of).otherwise(F.col("updated_at"))})


def enqueue(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming jobs whose idempotency_key is new, the first job_id of each."""
    rest = [c for c in incoming.columns if c != "idempotency_key"]
    first = incoming.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), "job_id").alias("j")).select("idempotency_key", "j.*")
    return first.join(jobs.select("idempotency_key"), "idempotency_key", "left_anti").select(*incoming.columns)


def failed(jobs: DataFrame, as_of: Column, error: str, base_seconds: int = 60) -> DataFrame:
    """Jobs after a failed attempt: pending again after a delay that doubles with each attempt, or quarantined after the last."""
    done = F.col("attempt") >= F.col("max_attempts")
    delay = F.make_dt_interval(secs=(F.lit(base_seconds) * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("decimal(18,6)"))
    return jobs.withColumns({"status": F.when(done, "quarantined").otherwise("pending"), "next_attempt_at": F.when(~done, as_of + delay), "lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp"), "last_error": F.lit(error), "updated_at": as_of})


def inconsistent(jobs: DataFrame) -> DataFrame:
    """Rows whose lease columns don't fit their status; must be empty."""
    leased = F.col("lease_owner").isNotNull() & F.col("lease_expires_at").isNotNull()
    free = F.col("lease_owner").isNull() & F.col("lease_expires_at").isNull()
    return jobs.where(~F.when(F.col("status") == "running", leased).otherwise(free))


def reopen(conflicts: DataFrame) -> DataFrame:
    """Conflicts reopened once more; those at the cap stay as they are."""
    can = F.col("reopen_count") < MAX_REOPENS
    return conflicts.withColumns({"queue_status": F.when(can, "pending").otherwise(F.col("queue_status")), "reopen_count": F.when(can, F.col("reopen_count") + 1).otherwise(F.col("reopen_count"))})
