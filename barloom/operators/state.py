"""Saved fold states: an append-only table of snapshots, of which the newest per job counts.

A state holds everything that makes the continued run equal to an uninterrupted one: portfolio,
trade counters, moments of the returns, peak and drawdown, and the crossover state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOMENTS = {
    "saved_value": "BIGINT",
    "saved_n": "DOUBLE",
    "saved_mean": "DOUBLE",
    "saved_m2": "DOUBLE",
    "saved_peak": "DOUBLE",
    "saved_drawdown": "DOUBLE",
}


# Fixed value: bars between two progress snapshots.
SNAPSHOT_BARS = 100


def progress(curve: DataFrame) -> DataFrame:
    """Portfolio of every job at the bars of a curve made with `equity(SNAPSHOT_BARS)`, but its first."""
    position = F.col("idx") - F.col("i0")
    return curve.filter(position > 0).select(
        "job_id",
        "symbol",
        position.alias("last_processed_index"),
        F.col("date").alias("last_date"),
        "cash",
        "shares",
        F.col("equity").alias("portfolio_value"),
    )


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest valid snapshot per job (an upsert table read from its appends)."""
    columns = [c for c in snapshots.columns if c != "job_id"]
    return (
        snapshots.filter("valid")
        .groupBy("job_id")
        .agg(F.max_by(F.struct(*columns), "bars_processed").alias("s"))
        .select("job_id", "s.*")
    )


def usable(snapshots: DataFrame) -> DataFrame:
    """What a run needs of the newest snapshots."""
    return latest(snapshots).drop("symbol", "valid", "last_date")


def existing(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    return jobs.join(latest(snapshots), "job_id", "left_semi")


def without(snapshots: DataFrame, finished: DataFrame) -> DataFrame:
    """Snapshots of jobs that are not finished; those of finished jobs are deleted."""
    return snapshots.join(finished.select("job_id"), "job_id", "left_anti")


def open_jobs(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("job_id").distinct()
