"""Result tables to storage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.operators.status import run_summary
from barloom.schemas import RESULT_COLUMNS


def write_results(results: DataFrame, folder: str, seconds: float, fmt: str = "csv") -> None:
    """Results in job order under `folder/results`, the one-row summary under `folder/summary`.

    `results` should be a written table: both sinks read it.
    """
    ordered = results.select(*RESULT_COLUMNS).orderBy("job_id")
    writer = ordered.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(f"{folder}/results")
    run_summary(results, seconds).write.mode("overwrite").json(f"{folder}/summary")


def write_report(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(folder)
