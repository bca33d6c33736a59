"""OHLCV text files, one per symbol: scan, cleaning, quarantine, writer.

Fields are taken by position (date, open, high, low, close, volume); further fields are ignored.
A row is rejected if one of the six is missing or no value, if the bar is not valid, or if a price is
no whole number of minor units (`units` per currency unit): nothing is rounded and no accepted price is
NULL. Lines are read as text, so that neither a missing header nor an extra field confuses the reader; a
header is recognised wherever it stands, as files may be concatenations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.parsing import is_whole, to_bigint, to_double, to_minor, trimmed
from barloom.operators.bars import is_valid
from barloom.schemas import MINOR_UNITS

PRICES = ["open", "high", "low", "close"]
COLUMNS = ["date", *PRICES, "volume"]


def _decoded(text: Column) -> Column:
    """Percent-encoding undone; a plus sign stays one."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def symbol_of(file_path: Column) -> Column:
    """The symbol a file belongs to: `<SYMBOL>.csv`, or any file in a folder `symbol=<SYMBOL>`.

    Paths are encoded once by Spark, the names of such folders once more by the writer.
    """
    folder = F.regexp_extract(file_path, r"/symbol=([^/]*)/[^/]*$", 1)
    name = F.regexp_extract(file_path, r"([^/]*)\.csv$", 1)
    return F.when(folder != "", _decoded(_decoded(folder))).otherwise(_decoded(name))


def lines(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Non-blank lines with their symbol (from the path unless given). Reads both layouts."""
    name = F.lit(symbol) if symbol else symbol_of(F.col("_metadata.file_path"))
    return (
        spark.read.option("pathGlobFilter", "*.csv").text(path)
        .select(name.alias("symbol"), F.col("value").alias("line"))
        .filter(F.length(trimmed(F.col("line"))) > 0)
    )


def parsed(
    raw: DataFrame, lenient: bool = False, dates_as_text: bool = False, units: int = MINOR_UNITS
) -> DataFrame:
    """Typed fields, prices in minor units, and why a line is rejected (NULL if it is not).

    A line without any number in the five numeric fields that mentions "date" or "open" is the
    header and disappears. `dates_as_text` keeps dates as written; they then order as text.
    """
    fields = F.transform(F.split("line", ","), trimmed)
    typed = raw.withColumn("f", fields).select(
        "symbol",
        "line",
        F.size("f").alias("fields"),
        (F.get("f", F.lit(0)) if dates_as_text else F.get("f", F.lit(0)).try_cast("date")).alias("date"),
        *[to_double(F.get("f", F.lit(i)), lenient).alias(c) for i, c in enumerate(PRICES, start=1)],
        to_bigint(F.get("f", F.lit(5)), lenient).alias("volume"),
    )
    no_number = F.coalesce(*PRICES, F.col("volume").cast("double")).isNull()
    lowered = F.lower("line")
    header = no_number & (F.contains(lowered, F.lit("date")) | F.contains(lowered, F.lit("open")))
    missing = F.col("date").isNull() | F.col("volume").isNull()
    for c in PRICES:
        missing = missing | F.col(c).isNull()
    inexact = F.lit(False)
    for c in PRICES:
        inexact = inexact | F.coalesce(~is_whole(F.col(c), units), F.lit(True))
    checked = typed.filter(~header).withColumn(
        "reason",
        F.when(F.col("fields") < 6, "insufficient columns")
        .when(missing, "unparseable value")
        .when(~is_valid(typed), "invalid bar")
        .when(inexact, "price out of range or finer than the unit"),
    )
    return checked.withColumns({c: to_minor(F.col(c), units) for c in PRICES})


def bars(typed: DataFrame) -> DataFrame:
    """Accepted rows with prices in minor units."""
    return typed.filter(F.col("reason").isNull()).select("symbol", "date", *PRICES, "volume")


def quarantine(typed: DataFrame) -> DataFrame:
    return typed.filter(F.col("reason").isNotNull()).select("symbol", "line", "reason")


def load(spark: SparkSession, path: str, symbol: str | None = None, **options) -> DataFrame:
    return bars(parsed(lines(spark, path, symbol), **options))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per symbol file, found by listing: empty files count too."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return listing.select(
        symbol_of(F.col("_metadata.file_path")).alias("symbol"), "path", "length"
    )


def printed(bars_in_minor_units: DataFrame, units: int = MINOR_UNITS) -> DataFrame:
    """Bars as they stand in a file: symbol, Date, Open, High, Low, Close, Volume."""
    digits = len(str(units)) - 1
    day = F.col("date") if dict(bars_in_minor_units.dtypes)["date"] == "string" else F.date_format("date", "yyyy-MM-dd")
    return bars_in_minor_units.select(
        "symbol",
        day.alias("Date"),
        *[F.format_string(f"%.{digits}f", F.col(c) / units).alias(c.capitalize()) for c in PRICES],
        F.col("volume").alias("Volume"),
    )


def save(bars_in_minor_units: DataFrame, folder: str, units: int = MINOR_UNITS) -> None:
    """Write bars as text, one folder per symbol (`symbol=<SYMBOL>/`), replacing what is there.

    Every symbol is sorted within its files; a very large symbol may be split over several.
    """
    (
        printed(bars_in_minor_units, units).sort("symbol", "Date").write.mode("overwrite").option("header", True)
        .partitionBy("symbol").csv(folder)
    )
