"""Bars, jobs, heartbeats and ledgers derived from the star-schema test tables.

This is test input. The price band 100.00-119.99 keeps compounding within BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One priced row per line item: symbol, date, px (cents), seq, volume.

    seq = ((l_orderkey * 8 + l_linenumber) * 2048 + px - 10000) orders the ticks of a day and
    carries the price, so first and last price are plain MIN/MAX of a BIGINT.
    """
    items = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    px = F.pmod(F.floor(F.col("l_extendedprice") * 100).cast("bigint"), F.lit(2000).cast("bigint"))
    return items.join(part, items.l_partkey == part.p_partkey).select(
        "symbol",
        F.col("l_shipdate").cast("date").alias("date"),
        "l_linenumber",
        (px + 10000).alias("px"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2048 + px).alias("seq"),
        F.col("l_quantity").cast("bigint").alias("qty"),
    )


def _ohlcv(rows: DataFrame, keys: list[str]) -> DataFrame:
    def price(seq):
        return F.pmod(seq, F.lit(2048).cast("bigint")) + 10000

    return rows.groupBy(*keys).agg(
        price(F.min("seq")).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        price(F.max("seq")).alias("close"),
        F.sum("qty").alias("volume"),
    )


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars, one per symbol and date."""
    return _ohlcv(ticks(spark, folder), ["symbol", "date"])


def split_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with repeated dates: one per symbol, date and line number."""
    return _ohlcv(ticks(spark, folder), ["symbol", "date", "l_linenumber"]).drop("l_linenumber")


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_brand").alias("symbol")).distinct()


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Events as heartbeats: entity = user, with two payload numbers."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("entity"),
        "ts",
        F.pmod("event_id", F.lit(5)).cast("int").alias("active_jobs"),
        F.floor("value").cast("int").alias("completed_jobs"),
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as jobs, assigned to the user their customer key names; status P is unassigned."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("entity"),
    )


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with status F have an answer; it is a success unless the priority is 5-LOW."""
    return (
        table(spark, folder, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderpriority") != "5-LOW").alias("success"))
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as measured runs: one per event type and worker count 1, 2, 4, 8."""
    events = table(spark, folder, "events")
    cents = F.sum(F.floor(F.col("value") * 100).cast("bigint"))
    return events.groupBy(
        F.col("event_type").alias("run"),
        F.pow(F.lit(2), F.pmod("event_id", F.lit(4))).cast("int").alias("num_workers"),
    ).agg(
        F.count(F.lit(1)).alias("jobs_completed"),
        (cents.cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("total_time_sec"),
    )
