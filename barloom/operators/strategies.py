"""User strategies: how code outside the library turns bars into signals.

A strategy is named by the `strategy` column of the jobs. A FrameStrategy or PandasStrategy receives the bars of all
its jobs at once (job_id, symbol, iblock, idx, pos, date, close, prev_close); a BlockStrategy works on the arrays of packed
blocks where they lie, so that no bars are shuffled. Each returns actionable rows and the jobs that failed. What a strategy
raises, while it is built or while it runs, is the status of its own jobs and of no others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.kernels import job_rows, lists
from barloom.operators.jobs import cells
from barloom.operators.signals import actionable
from barloom.schemas import HOLD
from barloom.storage import written

MISMATCH = "Signal count mismatch with price data"
LAST = "job_id long, new_signal int, new_memory string"
ACTION_COLUMNS = ["job_id", "symbol", "iblock", "idx", "date", "close", "signal"]
_ACTION_SCHEMA = (
    "job_id long, symbol string, iblock long, idx long, date {date}, close long, signal int, error string, memory string"
)


def _seen(jobs: DataFrame) -> DataFrame | None:
    """The signals resumed jobs were saved with, where there are any."""
    return jobs.select("job_id", "saved_signal") if "saved_signal" in jobs.columns else None


def reason(error: Exception) -> str:
    """One line that says what went wrong: the condition of a Spark error, else the message."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return condition or (str(error).strip().splitlines() or [type(error).__name__])[0]


class Strategy(Protocol):
    def actions(self, bars: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(actionable rows: ACTION_COLUMNS, failures: job_id, error, what a resumed run needs: LAST)."""


class FrameStrategy:
    """Signals as a DataFrame function: `signals(bars, jobs)` returns job_id, idx, signal.

    Exactly one signal for each bar is required; other jobs fail. A resumed job sees only its new bars.
    """

    def __init__(self, signals: Callable[[DataFrame, DataFrame], DataFrame]):
        self.signals = signals

    def actions(self, bars: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        try:
            signals = self.signals(bars, jobs).select("job_id", "idx", F.col("signal").cast("int").alias("signal"))
            made = written(signals, "signals")
        except Exception as error:  # of the strategy, from its function or from the rows it asks for
            failed = jobs.select("job_id", F.lit(f"Signal generation failed: {reason(error)}").alias("error"))
            spark = jobs.sparkSession
            acts = _ACTION_SCHEMA.format(date=dict(bars.dtypes)["date"]).split(", error")[0]
            return spark.createDataFrame([], acts), failed, spark.createDataFrame([], LAST)
        counts = made.groupBy("job_id").agg(
            F.count("signal").alias("made"),
            F.count_distinct("idx").alias("places"),
            F.min("idx").alias("first"),
            F.max("idx").alias("last"),
        )
        expected = F.col("i1") - F.col("r0") + 1
        fits = (F.col("made") == expected) & (F.col("places") == expected)
        within = (F.col("first") >= F.col("r0")) & (F.col("last") <= F.col("i1"))
        failed = (
            jobs.join(counts, "job_id", "left")
            .filter((expected > 0) & ~F.coalesce(fits & within, F.lit(False)))
            .select("job_id", F.lit(MISMATCH).alias("error"))
        )
        rows = bars.join(made, ["job_id", "idx"])
        last = made.groupBy("job_id").agg(F.max_by("signal", "idx").alias("new_signal")).withColumn(
            "new_memory", F.lit(None).cast("string")
        )
        return actionable(rows, _seen(jobs)).select(*ACTION_COLUMNS), failed, last


class PandasStrategy:
    """Signals from Python, stretch by stretch.

    `start(job)` returns a callable for one job; it is called with consecutive stretches of that
    job's bars in order and returns one signal per bar, keeping what it needs between calls. A job
    is never held in memory as a whole. A callable with a method `save()` returning text is given
    that text when its job is resumed: `start(job, text)`.
    """

    def __init__(self, start: Callable[[int], Callable[[pd.DataFrame], Any]]):
        self.start = start

    def actions(self, bars: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        start = self.start

        def ending(job_id, last: int, strategy) -> pd.DataFrame:
            memory = strategy.save() if hasattr(strategy, "save") else None
            return _row(job_id, signal=last, memory=memory)

        def run(stretches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            job, strategy, last, dead = None, None, HOLD, False
            for stretch in stretches:
                for job_id, part in stretch.groupby("job_id", sort=False):
                    if job_id != job:
                        if strategy is not None and not dead:
                            yield ending(job, last, strategy)
                        saved, memory = part["saved_signal"].iloc[0], part["saved_memory"].iloc[0]
                        job, strategy, dead = job_id, None, False
                        last = HOLD if pd.isna(saved) else int(saved)
                    if dead:
                        continue
                    part = part.drop(columns=["saved_signal", "saved_memory"])
                    try:
                        if strategy is None:
                            strategy = start(int(job_id)) if pd.isna(memory) else start(int(job_id), memory)
                        signals = pd.Series(list(strategy(part)), index=None, dtype="int32")
                    except Exception as error:  # a user's error becomes the job's status
                        dead = True
                        yield _row(job_id, error=f"Signal generation failed: {error}")
                        continue
                    if len(signals) != len(part):
                        dead = True
                        yield _row(job_id, error=MISMATCH)
                        continue
                    before = signals.shift(1, fill_value=last)
                    keep = ((signals != HOLD) & (signals != before)).to_numpy()
                    last = int(signals.iloc[-1])
                    out = part[keep].assign(signal=signals[keep].to_numpy(), error=None, memory=None)
                    yield out[[*ACTION_COLUMNS, "error", "memory"]]
            if strategy is not None and not dead:
                yield ending(job, last, strategy)

        none = F.lit(None)
        before = jobs.select(
            "job_id",
            (F.col("saved_signal") if "saved_signal" in jobs.columns else none).cast("int").alias("saved_signal"),
            (F.col("saved_memory") if "saved_memory" in jobs.columns else none).cast("string").alias("saved_memory"),
        )
        ordered = bars.join(before, "job_id").repartition("job_id").sortWithinPartitions("job_id", "idx")
        schema = _ACTION_SCHEMA.format(date=dict(bars.dtypes)["date"])
        made = written(ordered.mapInPandas(run, schema), "signals")
        failed = made.filter(F.col("error").isNotNull()).select("job_id", "error")
        fine = made.filter(F.col("error").isNull())
        last = fine.filter("idx IS NULL").select("job_id", F.col("signal").alias("new_signal"), F.col("memory").alias("new_memory"))
        return fine.filter("idx IS NOT NULL").select(*ACTION_COLUMNS), failed, last


def _row(job_id: int, **values) -> pd.DataFrame:
    """A row about a job as a whole: its failure, or its last signal and memory."""
    row = dict.fromkeys([*ACTION_COLUMNS, "error", "memory"])
    return pd.DataFrame([{**row, "job_id": job_id, **values}]).astype(
        {"iblock": "Int64", "idx": "Int64", "close": "Int64", "signal": "Int32"}
    )


@dataclass(frozen=True)
class Stretch:
    """The bars of one job in one block: their positions `idx` and closes, and the closes `before` them that the block's
    array holds of the job's slice (at least one, unless the slice starts here)."""

    job_id: int
    first: int
    short_window: int
    long_window: int
    idx: np.ndarray
    close: np.ndarray
    before: np.ndarray


class BlockStrategy:
    """Signals from arrays, block by block, in any order and place.

    `signals(stretch, entry)` returns one signal per bar of the stretch. What a strategy knows of the bars before it is a
    `summary(stretch)`, a value that JSON can write; `combine(a, b)` puts the summaries of adjacent
    stretches together and must be associative. `entry` is the combination over all of the job before the stretch,
    None at its start. Two passes visit the blocks where they lie, and between them the summaries, one small row for each
    job and block, are scanned; a resumed job starts from the combination it was saved with.
    """

    def __init__(
        self,
        signals: Callable[[Stretch, Any], Any],
        summary: Callable[[Stretch], Any] | None = None,
        combine: Callable[[Any, Any], Any] | None = None,
    ):
        self.signals, self.summary, self.combine = signals, summary, combine

    def _entries(self, dealt: DataFrame, jobs: DataFrame, memory: DataFrame) -> DataFrame:
        """(job_id, iblock, entry, total, error): JSON of what lies before each stretch, and of that with it."""
        summary, combine = self.summary, self.combine

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for stretch, iblock, _ in stretches(batch):
                    try:
                        out.append((stretch.job_id, iblock, json.dumps(summary(stretch)), None))
                    except Exception as error:
                        out.append((stretch.job_id, iblock, None, f"Signal generation failed: {reason(error)}"))
                yield _batch(out, [("job_id", pa.int64()), ("iblock", pa.int64()), ("summary", pa.string()), ("error", pa.string())])

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            job, total, bad = None, None, None
            for batch in batches:
                out = []
                for job_id, iblock, text, error in zip(*[c.to_pylist() for c in batch.columns]):
                    if job_id != job:
                        job, total, bad = job_id, None, None
                    entry, bad = total, bad or error
                    try:
                        if text is not None and not bad:
                            total = text if total is None else json.dumps(combine(json.loads(total), json.loads(text)))
                    except Exception as raised:
                        bad = f"Signal generation failed: {reason(raised)}"
                    out.append((job_id, iblock, entry, total, bad))
                kinds = [("job_id", pa.int64()), ("iblock", pa.int64()), *[(c, pa.string()) for c in ("entry", "total", "error")]]
                yield _batch(out, kinds)

        made = _beside(dealt, jobs).mapInArrow(summed, "job_id long, iblock long, summary string, error string")
        begun = memory.where("saved_memory IS NOT NULL").selectExpr("job_id", "-1L AS iblock", "saved_memory AS summary", "CAST(NULL AS STRING) AS error")
        ordered = made.unionByName(begun).repartition("job_id").sortWithinPartitions("job_id", "iblock")
        schema = "job_id long, iblock long, entry string, total string, error string"
        return written(ordered.mapInArrow(scanned, schema), "strategy-entries")

    def block_actions(self, dealt: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """As `Strategy.actions`, from the blocks dealt to the jobs' cells."""
        signals = self.signals
        none = F.lit(None)
        saved = jobs.select("job_id", *[
            (F.col(c) if c in jobs.columns else none).cast(kind).alias(c) for c, kind in (("saved_signal", "int"), ("saved_memory", "string"))
        ])
        entries = None if self.summary is None else self._entries(dealt, jobs, saved)
        date = dict(dealt.dtypes)["dates"][len("array<"):-1]
        kind = {"string": pa.string(), "date": pa.date32()}[date]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["job_id", "symbol", "iblock", "idx", "date", "close", "signal", "opens", "error"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            for batch in batches:
                out = []
                for stretch, iblock, (symbol, dates, entry) in stretches(batch):
                    whole = (stretch.job_id, symbol, iblock)
                    try:
                        made = np.asarray(signals(stretch, json.loads(entry) if entry else None)).astype(np.int32)
                    except Exception as error:
                        out.append((*whole, None, None, None, None, None, f"Signal generation failed: {reason(error)}"))
                        continue
                    if made.shape != stretch.idx.shape:
                        out.append((*whole, None, None, None, None, None, MISMATCH))
                        continue
                    keep = np.flatnonzero((made != HOLD) & np.concatenate(([True], made[1:] != made[:-1])))
                    for k in keep.tolist():
                        out.append((*whole, int(stretch.idx[k]), dates[k].as_py(), int(stretch.close[k]), int(made[k]), k == 0, None))
                    out.append((*whole, None, None, None, int(made[-1]), None, None))  # how the block ends
                yield _batch(out, list(zip(names, kinds)))

        schema = f"job_id long, symbol string, iblock long, idx long, date {date}, close long, signal int, opens boolean, error string"
        made = written(_beside(dealt, jobs, entries).mapInArrow(run, schema), "signals")
        failures = made.where("error IS NOT NULL").select("job_id", F.lit(1).alias("step"), "iblock", "error")
        if entries is not None:  # what failed first counts
            before = entries.where("error IS NOT NULL").select("job_id", F.lit(0).alias("step"), "iblock", "error")
            failures = failures.unionByName(before)
        first = F.min(F.struct("step", "iblock", "error"))
        failed = failures.groupBy("job_id").agg(first.alias("f")).select("job_id", F.col("f.error").alias("error"))
        ends = made.where("error IS NULL AND idx IS NULL").select("job_id", "iblock", F.col("signal").alias("last"))
        before = ends.withColumn("seen", F.lag("last").over(Window.partitionBy("job_id").orderBy("iblock"))).select("job_id", "iblock", "seen")
        acts = made.where("idx IS NOT NULL").join(failed, "job_id", "left_anti").drop("error")
        acts = acts.join(before, ["job_id", "iblock"], "left").join(saved.select("job_id", "saved_signal"), "job_id", "left")
        acts = acts.where(~F.col("opens") | (F.col("signal") != F.coalesce("seen", "saved_signal", F.lit(HOLD))))
        last = ends.groupBy("job_id").agg(F.max_by("last", "iblock").alias("new_signal"))
        if entries is None:
            last = last.withColumn("new_memory", none.cast("string"))
        else:
            last = last.join(entries.groupBy("job_id").agg(F.max_by("total", "iblock").alias("new_memory")), "job_id", "left")
        return acts.select(*ACTION_COLUMNS), failed, last


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(columns)], [name for name, _ in columns])


def _beside(dealt: DataFrame, jobs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The jobs of each cell (a bounded number) beside their block."""
    rows = cells(jobs, "r0", "i1")
    if entries is None:
        rows = rows.withColumn("entry", F.lit(None).cast("string"))
    else:
        rows = rows.join(entries.select("job_id", "iblock", "entry"), ["job_id", "iblock"], "left")
    of = rows.groupBy("symbol", "iblock", "salt").agg(
        F.collect_list(F.struct("job_id", "r0", "i0", "i1", "short_window", "long_window", "entry")).alias("jobs")
    )
    met = dealt.join(of, ["symbol", "iblock", "salt"])
    return met.select("symbol", "iblock", "first_idx", "own_from", "own_to", "dates", "closes", "jobs")


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[Stretch, int, tuple]]:
    """(stretch, block, (symbol, its dates, entry)) of every job beside every block of a batch."""
    symbols, blocks = batch.column("symbol").to_pylist(), batch.column("iblock").to_pylist()
    first_idx, own_from, own_to = (batch.column(c).to_pylist() for c in ("first_idx", "own_from", "own_to"))
    dates, dates_from = batch.column("dates").values, batch.column("dates").offsets.to_numpy()
    closes = lists(batch, "closes")
    columns = ("job_id", "r0", "i0", "i1", "short_window", "long_window", "entry")
    for row, jobs in enumerate(job_rows(batch, "jobs")):
        base = first_idx[row]
        for job_id, r0, i0, i1, short, long, entry in zip(*(jobs[c].tolist() for c in columns)):
            lo, hi = max(own_from[row], r0), min(own_to[row], i1)
            if lo > hi:
                continue
            stretch = Stretch(
                job_id, i0, short, long, np.arange(lo, hi + 1), closes[row][lo - base : hi - base + 1],
                closes[row][max(base, i0) - base : lo - base],
            )
            yield stretch, blocks[row], (symbols[row], dates.slice(dates_from[row] + lo - base, hi - lo + 1), entry)
