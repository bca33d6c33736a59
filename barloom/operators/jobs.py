"""Job lists: parameter grids, ids, validation, and their place in the packed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.blocks import block_of, own
from barloom.operators.scan import dealt, numbered, running
from barloom.schemas import MINOR_UNITS

JOBS_PER_CELL = 16


def grid(symbols: DataFrame, params: list[dict]) -> DataFrame:
    """Every symbol with every parameter set (a short list in the caller's code)."""
    sets = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params])
    return symbols.select("symbol", F.explode(sets).alias("p")).select(
        "symbol",
        F.lit("SMA").alias("strategy") if "strategy" not in params[0] else "p.strategy",
        F.col("p.start_date").cast("date").alias("start_date"),
        F.col("p.end_date").cast("date").alias("end_date"),
        F.col("p.short_window").cast("int").alias("short_window"),
        F.col("p.long_window").cast("int").alias("long_window"),
        F.col("p.initial_capital").cast("double").alias("initial_capital"),
        *[F.col(f"p.{k}").alias(k) for k in params[0] if k.startswith("_")],
    )


def number(jobs: DataFrame, order: list[str]) -> DataFrame:
    """job_id = 1, 2, 3, … along `order`."""
    return numbered(jobs, order, "job_id")


def invalid_reason(strategies: list[str], units: int = MINOR_UNITS) -> Column:
    """NULL for a job that can run, otherwise why it cannot."""
    return (
        F.when(
            ~F.coalesce(F.col("strategy"), F.lit("")).isin(*strategies),
            F.concat(F.lit("Invalid job: unknown strategy "), F.coalesce("strategy", F.lit("NULL"))),
        )
        .when(
            F.least("short_window", "long_window").isNull() | (F.least("short_window", "long_window") <= 0),
            F.lit("Invalid job: window must be positive"),
        )
        .when(
            F.col("initial_capital").isNull()
            | F.isnan("initial_capital")
            | (F.col("initial_capital") <= 0),
            F.lit("Invalid job: capital must be positive"),
        )
        .when(
            F.col("initial_capital") * units >= float(2**63),
            F.lit("Invalid job: capital too large"),
        )
    )


def cuts(packed: DataFrame, ranges: DataFrame) -> DataFrame:
    """(symbol, start_date, end_date, i0, i1, last_date, lookback): the positions each date range covers.

    An as-of merge: the first dates of all blocks and both ends of all ranges are sorted together, and each
    end takes the last block before it from a running maximum. Rows are thin and parts even, whatever
    the number of blocks and ranges of a symbol, and no block meets a range but the two that it cuts; only
    those open their dates.
    """
    known = ranges.select("symbol", "start_date", "end_date").distinct().dropna()
    sides = F.array(  # a start comes before blocks that begin on its date, an end after them
        F.struct(F.col("start_date").alias("date"), F.lit(0).alias("side")), F.struct(F.col("end_date").alias("date"), F.lit(2).alias("side"))
    )
    ends = known.withColumn("__end", F.explode(sides)).select("symbol", "__end.date", "__end.side", "start_date", "end_date")
    begins = packed.select("symbol", F.col("first_date").alias("date"), F.lit(1).alias("side"), "iblock")
    events = dealt(begins.unionByName(ends, allowMissingColumns=True), ["symbol", "date", "side", "iblock"], "range-ends")
    merged = running(events, ["symbol"], "__part", ["__at"], {"__cut": ("max", F.col("iblock"))}).filter("side <> 1")
    opened = merged.select("symbol", "side", F.col("date").alias("__end"), "start_date", "end_date", F.col("__cut").alias("iblock")).join(
        packed.select("symbol", "iblock", "own_from", "lookback", own("dates").alias("dates")), ["symbol", "iblock"]
    )
    before = F.size(F.filter("dates", lambda d: F.when(F.col("side") == 0, d < F.col("__end")).otherwise(d <= F.col("__end"))))
    is_end = F.col("side") == 2
    return (
        opened.withColumn("before", before)
        .withColumn("upto", F.col("own_from") + F.col("before"))
        .groupBy("symbol", "start_date", "end_date")
        .agg(
            F.coalesce(F.max(F.when(~is_end, F.col("upto"))), F.lit(0)).cast("bigint").alias("i0"),
            F.max(F.when(is_end, F.col("upto") - 1)).cast("bigint").alias("i1"),
            F.max(F.when(is_end, F.get("dates", F.col("before") - 1))).alias("last_date"),
            F.max("lookback").alias("lookback"),
        )
        .filter("i0 <= i1")
    )


def place(
    packed: DataFrame, jobs: DataFrame, strategies: list[str], presence: bool = False, units: int = MINOR_UNITS
) -> DataFrame:
    """Add the slice of positions `i0`..`i1` each job covers, and what is wrong with the job.

    Many jobs share a range, so the positions are looked up once per distinct range.
    `presence` adds whether the symbol has any bars (`has_bars`, NULL if not).
    """
    load = jobs.groupBy("symbol").agg(
        F.ceil(F.count(F.lit(1)) / JOBS_PER_CELL).cast("int").alias("salts")
    )
    hits = cuts(packed, jobs)
    if presence:
        stored = packed.filter("iblock = 0").select("symbol", F.lit(True).alias("has_bars"))
        jobs = jobs.join(stored, "symbol", "left")
    return (
        jobs.join(hits, ["symbol", "start_date", "end_date"], "left")
        .join(load, "symbol", "left")
        .withColumn("salt", F.pmod(F.xxhash64("job_id"), F.col("salts")).cast("int"))
        .withColumn("invalid", invalid_reason(strategies, units))
        .withColumn("capital", F.round(F.col("initial_capital") * units).try_cast("bigint"))
    )


def runnable(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("invalid").isNull() & F.col("i0").isNotNull())


def spread(packed: DataFrame, spans: DataFrame) -> DataFrame:
    """The packed blocks that some job covers, once for each group of about JOBS_PER_CELL of its jobs.

    A symbol named by a third of all jobs is worked on by as many tasks as it has cells; a block that no
    job covers goes nowhere.
    """
    needed = cells(spans, "r0", "i1").select("symbol", "iblock", "salt").distinct()
    return packed.join(needed, ["symbol", "iblock"]).repartition("symbol", "iblock", "salt")


def cells(spans: DataFrame, start: str, end: str) -> DataFrame:
    """One thin row per job (or piece of a job) and block between positions `start` and `end`."""
    return (
        spans.filter(F.col(start) <= F.col(end))
        .withColumn("iblock", F.explode(F.sequence(block_of(F.col(start)), block_of(F.col(end)))))
    )
