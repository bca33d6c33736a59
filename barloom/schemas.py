"""Column layouts of the tables the library reads and writes.

Prices and cash are BIGINT minor units (cents by default), so sums and comparisons are exact
and do not depend on the order of evaluation.
"""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("open", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("close", T.LongType()),
        T.StructField("volume", T.LongType()),
    ]
)

# Equal dates are legal; this order makes the series total.
BAR_ORDER = ["date", "open", "high", "low", "close", "volume"]

JOBS = T.StructType(
    [
        T.StructField("job_id", T.LongType(), False),
        T.StructField("symbol", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("short_window", T.IntegerType()),
        T.StructField("long_window", T.IntegerType()),
        T.StructField("initial_capital", T.DoubleType()),
    ]
)

# Minor units of a currency unit, where nothing else is said.
MINOR_UNITS = 100

# Signal codes.
BUY, HOLD, SELL = 1, 0, -1

RESULT_COLUMNS = [
    "job_id",
    "symbol",
    "total_return",
    "sharpe_ratio",
    "max_drawdown",
    "final_value",
    "num_trades",
    "winning",
    "losing",
    "success",
    "error_message",
]
