from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from barloom.schemas import BARS, JOBS

EPOCH = dt.date(2000, 1, 1)


def day(i: int) -> dt.date:
    return EPOCH + dt.timedelta(days=i)


def bars_of(spark: SparkSession, series: dict[str, list[int]], step: int = 1) -> DataFrame:
    """Bars in cents, one every `step` days; open, high and low surround the close."""
    rows = [
        (symbol, day(i * step), c - 50, c + 50, c - 100, c, 1_000_000)
        for symbol, closes in series.items()
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, BARS)


def jobs_of(spark: SparkSession, jobs: list[tuple]) -> DataFrame:
    """(symbol, strategy, first day, last day, short, long, capital), numbered from 1."""
    rows = [
        (k, symbol, strategy, day(a), day(b), short, long, float(capital))
        for k, (symbol, strategy, a, b, short, long, capital) in enumerate(jobs, start=1)
    ]
    return spark.createDataFrame(rows, JOBS)


def by_job(df: DataFrame) -> dict[int, dict]:
    return {r["job_id"]: r.asDict() for r in df.collect()}
