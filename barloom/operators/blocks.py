"""Series of bars packed into blocks of fixed length.

`ranked` numbers the bars of every symbol. `pack` then cuts each series at multiples of 4096 positions and stores every
block as one row of arrays, preceded by the `lookback` bars before it, a block's length at most. Windows up to the
look-back are answered from the row itself. Longer ones, of any length, take the sum up to their far end from the block it lies
in: `directory` has the exact sum of the closes before each block, in two levels (blocks, and groups of 1024
of them), and an equi-join on (symbol, block) brings the block's closes. What is stored does not depend on the
windows that are asked for, and a window longer than its series costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.scan import period_block, running
from barloom.schemas import BAR_ORDER

BLOCK_BITS = 12
BLOCK_DAYS = 1024
GROUP_BITS = 10  # blocks of a group of the directory
EXACT = "decimal(38,0)"  # sums of any number of BIGINTs


def block_of(position):
    return F.shiftright(position, BLOCK_BITS)


def period(bars: DataFrame) -> Column:
    """Consecutive stretches of dates: calendar periods, or the first characters of text dates."""
    text = dict(bars.dtypes)["date"] == "string"
    return F.substring("date", 1, 4) if text else period_block(F.col("date"), BLOCK_DAYS)


def ranked(bars: DataFrame, unique_dates: bool = False) -> DataFrame:
    """Bars with `idx` (0-based position in the symbol's series) and `cs` (prefix sum of close, exact).

    Bars are scanned within their date, dates within their period, periods within their symbol, so
    no task holds more than the bars of one date. Where dates are unique the first step falls away, the order
    is the date alone, and the other columns can be pruned.
    """
    if unique_dates:
        blocked = bars.withColumn("block", period(bars))
        totals = {"idx": ("count", F.lit(1)), "cs": ("sum", F.col("close").cast(EXACT))}
        numbered = running(blocked, ["symbol"], "block", ["date"], totals)
        return numbered.withColumn("idx", (F.col("idx") - 1).cast("bigint")).drop("block")
    days = bars.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(F.col("close").cast(EXACT)), F.lit(0)).alias("__sum")
    )
    upto = running(
        days.withColumn("block", period(bars)),
        ["symbol"],
        "block",
        ["date"],
        {"__all_n": ("sum", F.col("__n")), "__all_sum": ("sum", F.col("__sum"))},
    ).select(
        "symbol",
        "date",
        (F.col("__all_n") - F.col("__n")).alias("__before_n"),
        (F.col("__all_sum") - F.col("__sum")).alias("__before_sum"),
    )
    rest = [c for c in BAR_ORDER if c in bars.columns and c != "date"]
    inside = Window.partitionBy("symbol", "date").orderBy(*rest)
    here = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        bars.withColumn("__rank", F.row_number().over(inside))
        .withColumn("__here", F.sum(F.col("close").cast(EXACT)).over(here))
        .join(upto, ["symbol", "date"])
        .select(
            *bars.columns,
            (F.col("__before_n") + F.col("__rank") - 1).cast("bigint").alias("idx"),
            (F.col("__before_sum") + F.col("__here")).alias("cs"),
        )
    )


def pack(ranked_bars: DataFrame, lookback: int) -> DataFrame:
    """One row per (symbol, iblock) with the arrays `dates` and `closes`.

    `first_idx` is the position of the first array element, `own_from`..`own_to` the positions that
    belong to the block itself; before them come the `lookback` bars before the block.
    """
    lookback = min(lookback, 1 << BLOCK_BITS)
    own = block_of(F.col("idx"))
    blocks = (
        ranked_bars.select(
            "symbol",
            F.explode(F.sequence(own, block_of(F.col("idx") + F.lit(lookback)))).alias("iblock"),
            F.struct("idx", "date", "close").alias("bar"),
        )
        .groupBy("symbol", "iblock")
        .agg(F.sort_array(F.collect_list("bar")).alias("bars"))
    )
    return (
        blocks.withColumn("first_idx", F.get("bars.idx", F.lit(0)))
        .select(
            "symbol",
            "iblock",
            "first_idx",
            F.shiftleft(F.col("iblock"), BLOCK_BITS).alias("own_from"),
            F.element_at("bars.idx", -1).alias("own_to"),
            F.lit(lookback).cast("bigint").alias("lookback"),
            F.get("bars.date", (F.shiftleft(F.col("iblock"), BLOCK_BITS) - F.col("first_idx")).cast("int")).alias("first_date"),
            F.element_at("bars.date", -1).alias("last_date"),
            F.col("bars.date").alias("dates"),
            F.col("bars.close").alias("closes"),
        )
        .filter(F.col("own_to") >= F.col("own_from"))
    )


def own(array: str) -> Column:
    """The elements of an array column of a packed block that belong to the block itself."""
    return F.slice(
        array,
        (F.col("own_from") - F.col("first_idx") + 1).cast("int"),
        (F.col("own_to") - F.col("own_from") + 1).cast("int"),
    )


def directory(packed: DataFrame) -> DataFrame:
    """(symbol, iblock, before): the exact sum of the closes before each block; thin rows."""
    add = lambda total, close: (total + close.cast(EXACT)).cast(EXACT)
    totals = packed.select(
        "symbol",
        "iblock",
        F.shiftright("iblock", GROUP_BITS).alias("__group"),
        F.aggregate(own("closes"), F.lit(0).cast(EXACT), add).alias("__total"),
    )
    upto = running(totals, ["symbol"], "__group", ["iblock"], {"__upto": ("sum", F.col("__total"))})
    return upto.select("symbol", "iblock", (F.col("__upto") - F.col("__total")).cast(EXACT).alias("before"))
