"""Operators on the bars of single symbols: validity, slices, lookups, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.metrics import simple_return
from barloom.operators.blocks import EXACT, period
from barloom.operators.scan import previous
from barloom.schemas import BAR_ORDER, MINOR_UNITS


def is_valid(bars: DataFrame) -> Column:
    """High is not below, low not above any other price; volume is not negative; nothing is NaN.

    Spark orders NaN above every number, so NaN needs its own test.
    """
    ordered = (
        (F.col("high") >= F.col("low"))
        & (F.col("high") >= F.col("open"))
        & (F.col("high") >= F.col("close"))
        & (F.col("low") <= F.col("open"))
        & (F.col("low") <= F.col("close"))
        & (F.col("volume") >= 0)
    )
    floating = [
        c for c, kind in bars.dtypes
        if c in ("open", "high", "low", "close") and kind in ("double", "float")
    ]
    for c in floating:
        ordered = ordered & ~F.isnan(c)
    return F.coalesce(ordered, F.lit(False))


def valid_bars(bars: DataFrame) -> DataFrame:
    return bars.filter(is_valid(bars))


def in_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Closed date range (of text, where dates are text); on a stored table it reaches the Parquet scan."""
    kind = dict(bars.dtypes)["date"]
    return bars.filter(F.col("date").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def date_index(ranked_bars: DataFrame) -> DataFrame:
    """date -> position; of equal dates the last position counts."""
    return ranked_bars.groupBy("symbol", "date").agg(F.max("idx").alias("idx"))


def find_date(ranked_bars: DataFrame, date: str) -> DataFrame:
    """Position of a date per symbol, or the size of the series where it is absent."""
    kind = dict(ranked_bars.dtypes)["date"]
    hit = F.max(F.when(F.col("date") == F.lit(date).cast(kind), F.col("idx")))
    return ranked_bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(hit, F.count(F.lit(1))).alias("position")
    )


def bar_at(ranked_bars: DataFrame, position: int) -> DataFrame:
    """The bar at a position; symbols with fewer bars have no row."""
    return ranked_bars.filter(F.col("idx") == position)


def last_per_date(bars: DataFrame) -> DataFrame:
    """Of equal dates the last bar in the total order."""
    rest = [c for c in BAR_ORDER if c != "date"]
    return (
        bars.groupBy("symbol", "date")
        .agg(F.max(F.struct(*rest)).alias("last"))
        .select("symbol", "date", "last.*")
    )


def bar_count(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


def mean_close(bars: DataFrame, units: int = MINOR_UNITS) -> DataFrame:
    """Mean close in currency units, exact up to the final division; `units` minor units make one."""
    total = F.sum(F.col("close").cast(EXACT)).cast("double")
    return bars.groupBy("symbol").agg(
        F.coalesce(total / F.count("close") / float(units), F.lit(0.0)).alias("mean_close")
    )


def volatility(bars: DataFrame) -> DataFrame:
    """Population deviation of the simple returns; each period carries the close before it."""
    order = F.struct(*[c for c in BAR_ORDER if c in bars.columns])
    blocked = bars.select("symbol", "close", period(bars).alias("block"), order.alias("at"))
    rows = previous(blocked, ["symbol"], "block", "at", "close", "prev_close").withColumn(
        "r", simple_return(F.col("close"), F.col("prev_close"))
    )
    return rows.groupBy("symbol").agg(F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("volatility"))
