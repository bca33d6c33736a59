"""Trading calendar and price paths: the deterministic half of sample data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import running


def trading_days(symbols: DataFrame, start: Column, end: Column) -> DataFrame:
    """Weekdays between two inclusive dates for every symbol; no holidays.

    `start` and `end` are columns of `symbols`, so the days are generated where the symbols are.
    """
    return (
        symbols.select("symbol", F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("date"))
        .filter(F.weekday("date") < 5)
    )


def price_path(returns: DataFrame, key: str, block: str, order: list[str], initial: float) -> DataFrame:
    """p_t = p_(t-1) * (1 + r_t), as the exponential of a running sum; needs r > -1."""
    summed = running(returns, [key], block, order, {"log_growth": ("sum", F.log1p("r"))})
    return summed.withColumn("price", F.lit(initial) * F.exp("log_growth")).drop("log_growth")
