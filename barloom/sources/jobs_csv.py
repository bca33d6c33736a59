"""Job lists as text: symbol, strategy, start, end, short window, long window, capital."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.scan import running


def load(spark: SparkSession, path: str, dates_as_text: bool = False) -> DataFrame:
    """Jobs numbered 1, 2, 3, … in line order; the first line of a file is its header.

    Lines with fewer than seven fields are dropped, further fields are ignored. A number that
    cannot be read becomes NULL, which the sweep reports as an invalid job.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    )
    # a split is read in line order by one task, so `place` orders its lines
    numbered = running(raw, ["file"], "split", ["place"], {"line_no": ("count", F.lit(1))})
    f = F.split(F.rtrim("line", F.lit("\r")), ",")
    day = (lambda c: c) if dates_as_text else (lambda c: c.try_cast("date"))
    jobs = (
        numbered.filter(F.col("line_no") > 1)
        .withColumn("f", f)
        .filter(F.size("f") >= 7)
        .select(
            F.struct("file", "split").alias("part"),
            "line_no",
            F.get("f", F.lit(0)).alias("symbol"),
            F.get("f", F.lit(1)).alias("strategy"),
            day(F.get("f", F.lit(2))).alias("start_date"),
            day(F.get("f", F.lit(3))).alias("end_date"),
            F.get("f", F.lit(4)).try_cast("int").alias("short_window"),
            F.get("f", F.lit(5)).try_cast("int").alias("long_window"),
            F.get("f", F.lit(6)).try_cast("double").alias("initial_capital"),
        )
    )
    return running(jobs, [], "part", ["line_no"], {"job_id": ("count", F.lit(1))}).drop("part", "line_no")
