"""Outcome of a job list: status rules, lookups, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load_error(folder: str) -> Column:
    """Why a job has no series: its file is missing, or holds no valid row.

    Needs `listed` (the symbol has a file) and `has_bars` (some row of it was valid).
    """
    path = F.concat(F.lit(f"{folder}/"), F.col("symbol"), F.lit(".csv"))
    return F.when(
        F.col("listed").isNull(), F.concat(F.lit("Exception: Failed to open file: "), path)
    ).when(F.col("has_bars").isNull(), F.concat(F.lit("Exception: No valid data loaded from "), path))


def with_load_errors(placed: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Fill `invalid` for jobs whose symbol could not be loaded. `files`: one row per symbol file."""
    listed = files.select("symbol").distinct().withColumn("listed", F.lit(True))
    return placed.join(listed, "symbol", "left").withColumn(
        "invalid", F.coalesce("invalid", load_error(folder))
    ).drop("listed")


def lookup(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with their results; unanswered jobs are absent."""
    return jobs.join(results.drop("symbol"), "job_id")


def unanswered(jobs: DataFrame, results: DataFrame) -> DataFrame:
    return jobs.join(results.select("job_id"), "job_id", "left_anti")


def run_summary(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: submitted, successful, failed, and the rate if a duration is given.

    The rate counts whole seconds; below one second there is none.
    """
    totals = results.agg(
        F.count(F.lit(1)).alias("submitted"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    if seconds is None:
        return totals
    return totals.withColumn("total_seconds", F.lit(float(seconds))).withColumn(
        "jobs_per_second", F.try_divide(F.col("submitted").cast("double"), F.lit(float(int(seconds))))
    )
