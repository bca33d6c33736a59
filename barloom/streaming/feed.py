"""Driving a streaming query over stored rows that arrive step by step."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.storage import shared_folder


def run_in_steps(
    df: DataFrame, date: str, cuts: list[str], transform: Callable[[DataFrame], DataFrame], mode: str
) -> DataFrame:
    """Rows arrive in order of `date`, those between two cuts together; the rows that `transform` puts
    out, with the number of the micro-batch that did.

    Each step's files are added by as many tasks as hold rows, and the query is resumed from its checkpoint
    until they are used up.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(date) >= F.lit(low).cast("date"))
        if high is not None:
            part = part.filter(F.col(date) < F.lit(high).cast("date"))
        part.write.mode("append").parquet(f"{folder}/in")
        query = (
            transform(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
            .writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .foreachBatch(store)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("n")
