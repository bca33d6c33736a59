"""Scalability report over a table of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _truncate(value: Column, digits: int) -> Column:
    """Fixed-point truncation toward zero; exact on DECIMAL."""
    scale = 10**digits
    return (F.floor(value * scale) / scale).cast(f"decimal(38,{digits})")


def scalability(runs: DataFrame) -> DataFrame:
    """Throughput, mean job time, speed-up and efficiency per (run, num_workers).

    Speed-up is relative to the one-worker row of the same run and is truncated to two digits;
    efficiency derives from the truncated speed-up. NULL without a baseline.
    """
    jobs = F.col("jobs_completed").cast("decimal(18,0)")
    elapsed = F.col("total_time_sec")
    workers = F.col("num_workers").cast("decimal(9,0)")
    baseline = F.max(F.when(F.col("num_workers") == 1, elapsed)).over(Window.partitionBy("run"))
    return (
        runs.withColumn("baseline", baseline)
        .withColumn("speedup", _truncate(F.try_divide(F.col("baseline"), elapsed), 2))
        .select(
            "run",
            "num_workers",
            "jobs_completed",
            "total_time_sec",
            _truncate(F.try_divide(jobs, elapsed), 4).alias("throughput"),
            _truncate(F.try_divide(elapsed, jobs), 4).alias("avg_job_time"),
            "speedup",
            (_truncate(F.col("speedup") / workers, 2) * 100).cast("decimal(38,2)").alias("efficiency"),
        )
    )
