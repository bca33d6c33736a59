"""Moving-average crossover: per-bar averages, state changes, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import kernels
from barloom.operators import blocks
from barloom.operators.jobs import cells
from barloom.schemas import BUY, SELL
from barloom.storage import written


def series_rows(placed_blocks: DataFrame) -> DataFrame:
    """Rows (job, bar) with the close of the bar before (NULL at the start of the slice)."""
    at = F.col("at")
    return placed_blocks.withColumn("at", F.explode(F.sequence("low_at", "high_at"))).select(
        "job_id",
        "symbol",
        "iblock",
        (F.col("first_idx") + at).alias("idx"),
        (at + F.col("first_idx") - F.col("i0")).alias("pos"),
        F.get("dates", at).alias("date"),
        F.get("closes", at).alias("close"),
        F.when(at + F.col("first_idx") > F.col("i0"), F.get("closes", at - 1)).alias("prev_close"),
    )


def on_blocks(spread_blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Jobs beside the packed blocks they cover.

    `low_at`..`high_at` are the array offsets to process (positions `r0`..`i1`), `first_at` the
    first offset at which both averages may be compared.
    """
    first_pos = F.greatest("long_window", F.col("short_window") - 1)
    return (
        cells(spans, "r0", "i1")
        .join(spread_blocks, ["symbol", "iblock", "salt"])
        .withColumn("low_at", (F.greatest("own_from", "r0") - F.col("first_idx")).cast("int"))
        .withColumn("high_at", (F.least("own_to", "i1") - F.col("first_idx")).cast("int"))
        .withColumn("first_at", F.col("i0") + first_pos - F.col("first_idx"))
        .filter("low_at <= high_at")
    )


_PIECES = "array<struct<window:int,start:bigint,gap:decimal(38,0),closes:array<bigint>>>"


def pieces(packed: DataFrame, spans: DataFrame) -> DataFrame | None:
    """(symbol, iblock, salt, pieces): what windows beyond the look-back reach back to; None where there are none.

    The far ends of a window over one block lie in two blocks. Those are joined by their number, with the exact
    sum of the closes in between, once for each window of a cell. Windows that are never full ask for nothing.
    """
    uses = (
        spans.select(
            "symbol", "salt", "r0", "i0", "i1", "lookback", F.explode(F.array("short_window", "long_window")).alias("window")
        )
        .withColumn("full", F.greatest(F.col("r0"), F.col("i0") + F.col("window").cast("long") - 1))
        .filter((F.col("window") >= F.col("lookback")) & (F.col("full") <= F.col("i1")) & (F.col("i1") >= F.col("lookback")))
    )
    if uses.isEmpty():
        return None
    own_from = F.shiftleft(F.col("iblock"), blocks.BLOCK_BITS)
    far = blocks.block_of(F.greatest(own_from - 1 - F.col("window").cast("long"), F.lit(0).cast("long")))
    needed = (
        cells(uses, "full", "i1")
        .filter(own_from > F.col("lookback"))
        .select("symbol", "iblock", "salt", "window", F.explode(F.array(far, far + 1)).alias("far"))
        .distinct()
    )
    sums = written(blocks.directory(packed), "directory")
    there = packed.select("symbol", F.col("iblock").alias("far"), F.col("own_from").alias("start"), blocks.own("closes").alias("closes"))
    found = (
        needed.join(there, ["symbol", "far"])
        .join(sums.select("symbol", F.col("iblock").alias("far"), F.col("before").alias("far_before")), ["symbol", "far"])
        .join(sums, ["symbol", "iblock"])
        .withColumn("gap", (F.col("before") - F.col("far_before")).cast(blocks.EXACT))
    )
    grouped = found.groupBy("symbol", "iblock", "salt").agg(F.collect_list(F.struct("window", "start", "gap", "closes")).cast(_PIECES).alias("pieces"))
    return written(grouped, "far-closes")


def _cells_on_blocks(spread_blocks: DataFrame, spans: DataFrame, far: DataFrame | None) -> DataFrame:
    """The jobs of a cell (a bounded number) beside their block."""
    jobs = cells(spans, "r0", "i1").groupBy("symbol", "iblock", "salt").agg(
        F.collect_list(F.struct("job_id", "r0", "i0", "i1", "short_window", "long_window")).alias("jobs")
    )
    met = spread_blocks.join(jobs, ["symbol", "iblock", "salt"])
    columns = ["symbol", "iblock", "salt", "first_idx", "own_from", "own_to", "dates", "closes", "jobs"]
    if far is None:
        return met.select(*columns)
    return met.join(far, ["symbol", "iblock", "salt"], "left").select(*columns, "pieces")


def _date_type(packed: DataFrame) -> str:
    return dict(packed.dtypes)["dates"][len("array<"):-1]


def changes(spread_blocks: DataFrame, spans: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """Bars at which the crossover state differs from the bar before, or that bar took no part.

    Only the changes leave a block. `far` is what `pieces` found.
    """
    met = _cells_on_blocks(spread_blocks, spans, far).drop("salt")
    return met.mapInArrow(kernels.crossover_changes, kernels.CHANGES.format(date=_date_type(spread_blocks)))


def job_series(
    spread_blocks: DataFrame, spans: DataFrame, actions: DataFrame | None = None, far: DataFrame | None = None
) -> DataFrame:
    """Rows (job, bar): position in the slice, averages in minor units (NULL before the window is full),
    crossover state and signal. The actions of a cell are brought to its block; bars are not shuffled."""
    met = _cells_on_blocks(spread_blocks, spans, far)
    if actions is not None:
        acts = (
            actions.join(spans.select("job_id", "salt"), "job_id")
            .groupBy("symbol", "iblock", "salt")
            .agg(F.collect_list(F.struct("job_id", "idx", "signal")).alias("acts"))  # at most the bars of a block for each job
        )
        met = met.join(acts, ["symbol", "iblock", "salt"], "left")
    return met.drop("salt").mapInArrow(kernels.job_series, kernels.SERIES.format(date=_date_type(spread_blocks)))


def averages(packed: DataFrame, short: int, long: int) -> DataFrame:
    """The same rows for one pair of windows over whole series: no jobs, and no shuffle unless a window exceeds the look-back."""
    params = dict(job_id=0, r0=0, i0=0, short_window=short, long_window=long)
    job = F.struct(*[F.lit(v).cast("int" if "window" in k else "long").alias(k) for k, v in params.items()], F.col("own_to").alias("i1"))
    rows = packed.withColumn("jobs", F.array(job)).withColumn("salt", F.lit(0))
    if max(short, long) >= packed.agg(F.min("lookback")).first()[0]:
        whole = packed.groupBy("symbol").agg(F.max("own_to").alias("i1"), F.min("lookback").alias("lookback"))
        spans = whole.select("*", *[F.lit(v).alias(k) for k, v in params.items()], F.lit(0).alias("salt"))
        far = pieces(packed, spans)
        rows = rows if far is None else rows.join(far, ["symbol", "iblock", "salt"], "left")
    return rows.drop("salt").mapInArrow(kernels.job_series, kernels.SERIES.format(date=_date_type(packed)))


def crossings(state_changes: DataFrame, resumed: DataFrame | None = None) -> DataFrame:
    """BUY/SELL rows from state changes.

    Between two rows of `state_changes` the state is constant, so the last known state is that of
    the row before; a job starts as "not above" or with the state it was saved with.
    """
    by_job = Window.partitionBy("job_id").orderBy("idx")
    initial: Column = F.lit(-1)
    if resumed is not None:
        state_changes = state_changes.join(resumed.select("job_id", "saved_dir"), "job_id", "left")
        initial = F.coalesce("saved_dir", F.lit(-1))
    known = F.coalesce("prev_dir", F.lag("dir").over(by_job), initial)
    return (
        state_changes.withColumn("known", known)
        .filter(~F.col("seed") & (F.col("dir") != F.col("known")))
        .select(
            "job_id", "symbol", "iblock", "idx", "date", "close",
            F.when(F.col("dir") > 0, BUY).otherwise(SELL).alias("signal"),
        )
    )
