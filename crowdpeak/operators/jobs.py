"""Job history as tables: current state, stale jobs after a restart, retention of jobs and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv
from crowdpeak.settings import Settings

DEFAULT = Settings()


def current_states(events: DataFrame) -> DataFrame:
    """Latest event of each job; once cancelled, a job stays cancelled. `events(video_id, status, updated_at, ...)`"""
    rest = [c for c in events.columns if c != "video_id"]
    order = F.struct((F.col("status") == "cancelled").alias("final"), F.col("updated_at").alias("at"))
    return events.groupBy("video_id").agg(F.max_by(F.struct(*rest), order).alias("_e")).select(
        "video_id", *[F.col(f"_e.{c}").alias(c) for c in rest])


def fail_stale(jobs: DataFrame, host: str | Column, now: Column) -> DataFrame:
    """Jobs of this host that were still running become failed with a message; all other rows stay as they are."""
    stale = (F.col("host") == host) & F.col("status").isin(fv.ACTIVE_STATES)
    return (
        jobs.withColumn("_stale", F.coalesce(stale, F.lit(False)))
        .withColumn("error", F.when(F.col("_stale"), F.lit(fv.RESTART_MESSAGE)).otherwise(F.col("error")))
        .withColumn("updated_at", F.when(F.col("_stale"), now).otherwise(F.col("updated_at")))
        .withColumn("status", F.when(F.col("_stale"), F.lit("failed")).otherwise(F.col("status")))
        .drop("_stale")
    )


def expired_jobs(jobs: DataFrame, now: Column, s: Settings = DEFAULT) -> DataFrame:
    return jobs.filter(F.col("created_at") < now - F.make_dt_interval(hours=F.lit(s.retention_hours)))


def expired_files(files: DataFrame, jobs: DataFrame, now: Column, s: Settings = DEFAULT) -> DataFrame:
    """Files to delete from `files(name, modified_at)`: those of an expired job by name, and any that are too old.

    The job id is taken out of the name, so files and jobs meet in an equi join.
    """
    cutoff = now - F.make_dt_interval(hours=F.lit(s.retention_hours))
    owner = F.regexp_extract("name", r"^(.+)_highlight[^/]*\.mp4$", 1)
    gone = expired_jobs(jobs, now, s).select(F.col("video_id").cast("string").alias("_owner")).distinct().withColumn(
        "_expired", F.lit(True))
    return (
        files.withColumn("_owner", owner).join(gone, "_owner", "left")
        .withColumn("reason", F.when(F.col("_expired"), F.lit("job")).when(
            F.col("name").endswith(".mp4") & (F.col("modified_at") < cutoff), F.lit("age")))
        .filter(F.col("reason").isNotNull()).drop("_owner", "_expired")
    )
