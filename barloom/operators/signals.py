"""Signals bar by bar: the crossover's own, and those of user strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import previous
from barloom.schemas import HOLD


def actionable(signals: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Rows whose signal is not HOLD and differs from the bar before.

    The first bar follows HOLD, or the signal a resumed job was saved with (`seen`: job_id, saved_signal).
    """
    rows = previous(signals, ["job_id"], "iblock", "idx", "signal", "prev_signal")
    before = F.coalesce("prev_signal", F.lit(HOLD))
    if seen is not None:
        rows = rows.join(seen, "job_id", "left")
        before = F.coalesce("prev_signal", "saved_signal", F.lit(HOLD))
    return rows.filter((F.col("signal") != HOLD) & (F.col("signal") != before))


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("symbol", "signal").agg(F.count(F.lit(1)).alias("bars"))
