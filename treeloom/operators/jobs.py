"""Analysis jobs: allowed transitions, runs, and an audit of logged transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states a job passes, their progress, and which state may follow which.
STEPS = (("QUEUED", 0), ("DISCOVERING", 10), ("PROCESSING", 30), ("READY", 100))
FOLLOWS = {"QUEUED": ("DISCOVERING", "FAILED"), "DISCOVERING": ("PROCESSING", "FAILED"), "PROCESSING": ("READY", "FAILED"), "READY": (), "FAILED": ("FAILED",)}
TERMINAL = ("READY", "FAILED")


def problem(before: Column, status: Column, progress_before: Column, progress: Column, message: Column) -> Column:
    """What is wrong with a transition, null if nothing: a finished job moves, progress falls or leaves 0..100, a failure lacks
    its message or comes after READY."""
    return (
        F.when((progress < 0) | (progress > 100), "progress out of range")
        .when((status == "FAILED") & (F.trim(F.coalesce(message, F.lit(""))) == ""), "failure without message")
        .when((before == "READY") & (status == "FAILED"), "ready job failed")
        .when(before.isin(*TERMINAL) & (status != before), "terminal state left")
        .when(progress < progress_before, "progress fell")
    )


def audit(log: DataFrame, job: str = "job_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    """Every logged transition with the state before it and its problem, in the order of time per job."""
    w = Window.partitionBy(job).orderBy(at, tie)
    r = log.withColumns({"previous_status": F.lag("status").over(w), "_before": F.lag("progress").over(w)})
    return r.withColumn("problem", problem(F.col("previous_status"), F.col("status"), F.col("_before"), F.col("progress"), F.col("error_message"))).drop("_before")


def may_start(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, allowed): a job may start for a snapshot with a row whose newest job, if any, has ended."""
    from treeloom.operators.store import newest

    last = newest(jobs, "snapshot_id").select(F.col("snapshot_id").alias("_s"), F.col("status").alias("_status"))
    j = snapshots.select(F.col("id").alias("snapshot_id")).join(last, F.col("snapshot_id") == F.col("_s"), "left")
    return j.select("snapshot_id", (F.col("_status").isNull() | F.col("_status").isin(*TERMINAL)).alias("allowed"))


def run(job: dict, discover: Callable[[str], None], process: Callable[[str], None], save: Callable[[dict], None]) -> dict:
    """Run one job through its states; any error ends it as FAILED with the message and the progress it had.

    A driver-side state machine: the work itself is what ``discover`` and ``process`` do, each state is saved as it is reached.
    """
    if job["status"] != "QUEUED":
        raise ValueError(f"a job in state {job['status']} can't be run")
    try:
        for (status, progress), work in zip(STEPS[1:3], (discover, process), strict=True):
            job = job | {"status": status, "progress": progress}
            save(job)
            work(job["snapshot_id"])
        job = job | {"status": "READY", "progress": 100}
    except Exception as e:
        job = job | {"status": "FAILED", "error_message": str(e).strip() or type(e).__name__}
    save(job)
    return job
