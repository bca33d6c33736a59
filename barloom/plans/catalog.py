"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.metrics import simple_return
from barloom.operators import bars as barops
from barloom.operators import blocks, crossover, jobs as joblist, liveness, reports, signals as sig, state, status
from barloom.operators.scan import period_block, running
from barloom.operators.strategies import BlockStrategy, FrameStrategy, PandasStrategy, Strategy, Stretch
from barloom.plans import backtest
from barloom.sources import calendar, csv_bars, driver_tables as tables, jobs_csv, sinks, symbol_files
from barloom.storage import shared_folder, written
from barloom.streaming import backtest as stream_results, feed, liveness as stream_live

FULL = ("1990-01-01", "2010-12-31")
PAIR = (20, 50)
SWEEP = [
    dict(start_date=start, end_date=end, short_window=short, long_window=long, initial_capital=capital)
    for short, long in [(5, 20), (10, 30), (20, 50), (30, 10), (50, 200)]
    for start, end, capital in [(*FULL, 10000.0), ("1996-03-15", "1999-09-30", 2500.0)]
]


def _param(short: int, long: int, start: str, end: str, capital: float = 10000.0) -> dict:
    return dict(start_date=start, end_date=end, short_window=short, long_window=long, initial_capital=capital)


def _jobs(spark: SparkSession, folder: str, params: list[dict]) -> DataFrame:
    listed = joblist.grid(tables.symbols(spark, folder), params)
    return joblist.number(
        listed, ["symbol", "short_window", "long_window", "start_date"]
    )


def _packed(spark: SparkSession, folder: str, max_window: int) -> DataFrame:
    return backtest.prepare(tables.bars(spark, folder), max_window, unique_dates=True)


def _single(spark: SparkSession, folder: str) -> backtest.Run:
    jobs = _jobs(spark, folder, [_param(*PAIR, *FULL)])
    return backtest.run(_packed(spark, folder, max(PAIR)), jobs)


def bars_valid(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff("date", F.lit("1995-01-01").cast("date"))
    units = {c: F.col(c) / 100.0 for c in ("open", "high", "low", "close")}
    swapped = F.pmod(day, F.lit(97)) == 0
    dirty = tables.bars(spark, folder).select(
        "symbol",
        "date",
        units["open"].alias("open"),
        F.when(swapped, units["low"]).otherwise(units["high"]).alias("high"),
        F.when(swapped, units["high"]).otherwise(units["low"]).alias("low"),
        F.when(F.pmod(day, F.lit(83)) == 0, F.lit(float("nan"))).otherwise(units["close"]).alias("close"),
        F.when(F.pmod(day, F.lit(89)) == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )
    return barops.valid_bars(dirty)


def bars_range(spark: SparkSession, folder: str) -> DataFrame:
    return barops.in_range(tables.bars(spark, folder), "1996-01-01", "1997-12-31")


def bars_lookup(spark: SparkSession, folder: str) -> DataFrame:
    ranked = written(blocks.ranked(tables.bars(spark, folder), unique_dates=True), "ranked")
    found = barops.find_date(ranked, "1996-06-03")
    absent = barops.find_date(ranked, "1980-01-01").select("symbol", F.col("position").alias("absent_position"))
    hundredth = barops.bar_at(ranked, 100).select("symbol", F.col("date").alias("date_at_100"))
    return found.join(absent, "symbol").join(hundredth, "symbol", "left")


def bars_position(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.ranked(tables.split_bars(spark, folder)).drop("cs")


def bars_date_index(spark: SparkSession, folder: str) -> DataFrame:
    return barops.date_index(blocks.ranked(tables.split_bars(spark, folder)))


def bars_last_per_date(spark: SparkSession, folder: str) -> DataFrame:
    return barops.last_per_date(tables.split_bars(spark, folder))


def bar_count(spark: SparkSession, folder: str) -> DataFrame:
    return barops.bar_count(tables.bars(spark, folder))


def mean_close(spark: SparkSession, folder: str) -> DataFrame:
    return barops.mean_close(tables.bars(spark, folder)).withColumn("mean_close", F.round("mean_close", 6))


def volatility(spark: SparkSession, folder: str) -> DataFrame:
    return barops.volatility(tables.bars(spark, folder)).withColumn("volatility", F.round("volatility", 8))


def sma(spark: SparkSession, folder: str) -> DataFrame:
    bars = crossover.averages(_packed(spark, folder, max(PAIR)), *PAIR)
    return bars.select(
        "symbol",
        "date",
        F.round(F.col("short_avg") / 100.0, 6).alias("short_sma"),
        F.round(F.col("long_avg") / 100.0, 6).alias("long_sma"),
    )


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals need no portfolio: jobs are placed, and their changes meet their bars again."""
    packed = _packed(spark, folder, max(PAIR))
    _, spans, dealt = backtest.locate(packed, _jobs(spark, folder, [_param(*PAIR, *FULL)]))
    far = crossover.pieces(packed, spans)
    actions = crossover.crossings(crossover.changes(dealt, spans, far))
    return crossover.job_series(dealt, spans, actions, far)


def crossover_signals(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder).select("symbol", "date", "close", "signal")


def signal_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sig.signal_counts(_signals(spark, folder))


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return _single(spark, folder).trades.select(
        "job_id", "symbol", "date", "signal", "price", "shares", "value", "cash_after"
    )


def round_trips(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.round_trips(_single(spark, folder).trades)


def equity_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _single(spark, folder).equity().select("job_id", "symbol", "date", "cash", "shares", "equity")


def equity_returns(spark: SparkSession, folder: str) -> DataFrame:
    curve = _single(spark, folder).equity()
    return curve.select(
        "job_id",
        "symbol",
        "date",
        F.round(simple_return(F.col("equity"), F.col("prev_equity")), 9).alias("ret"),
    )


def drawdown_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _single(spark, folder).drawdowns().select(
        "job_id", "symbol", "date", "equity", "peak", F.round("drawdown_pct", 6).alias("drawdown_pct")
    )


def backtest_result(spark: SparkSession, folder: str) -> DataFrame:
    return _single(spark, folder).results().drop("error_message")


def backtest_sweep(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder, SWEEP)
    return backtest.run(_packed(spark, folder, 200), jobs).results().drop("error_message")


AS_OF = "2024-01-31 00:00:00"
SILENCE = 6 * 3600
FAULTS = [
    dict(strategy="SMA", **_param(20, 50, *FULL), _prefix=""),
    dict(strategy="SMA", **_param(20, 50, "2030-01-01", "2030-12-31"), _prefix=""),
    dict(strategy="SMA", **_param(20, 50, "1996-01-01", "1996-01-31"), _prefix=""),
    dict(strategy="RSI", **_param(20, 50, *FULL), _prefix=""),
    dict(strategy="SMA", **_param(0, 50, *FULL), _prefix=""),
    dict(strategy="SMA", **_param(20, 50, *FULL, 0.0), _prefix=""),
    dict(strategy="SMA", **_param(21, 50, *FULL), _prefix="X-"),
    dict(strategy="SMA", **_param(22, 50, *FULL), _prefix="E-"),
]


def _faulty_run(spark: SparkSession, folder: str) -> backtest.Run:
    """A sweep over text files in which every status rule occurs: symbols with the prefix X- have no
    file, those with E- a file without a valid row."""
    symbols = tables.symbols(spark, folder)
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    csv_bars.save(tables.bars(spark, folder), path)
    rubbish = symbols.select(F.concat(F.lit("E-"), "symbol").alias("symbol"), F.lit("no bar at all").alias("line"))
    rubbish.write.mode("append").partitionBy("symbol").csv(path)
    listed = joblist.grid(symbols, FAULTS).withColumn("symbol", F.concat("_prefix", "symbol")).drop("_prefix")
    jobs = joblist.number(listed, ["symbol", "strategy", "short_window", "start_date", "initial_capital"])
    packed = backtest.prepare(csv_bars.load(spark, path), 50)
    return backtest.run(packed, jobs, files=csv_bars.files(spark, path), folder="data")


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return _faulty_run(spark, folder).results().select(
        "job_id", "symbol", "num_trades", "final_value", "success", "error_message"
    )


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return status.run_summary(_faulty_run(spark, folder).results())


def _sunk(spark: SparkSession, folder: str) -> str:
    """The faulty sweep's results and summary, written by the sinks."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    results = written(_faulty_run(spark, folder).results(), "results")
    sinks.write_results(results, path, 2.5)
    return path


def result_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows read back from text, with their place in the files."""
    raw = (
        spark.read.option("header", True).csv(f"{_sunk(spark, folder)}/results")
        .select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("part"))
        .withColumn("place", F.monotonically_increasing_id())
    )
    placed = running(raw, [], "part", ["place"], {"line": ("count", F.lit(1))})
    return placed.select(
        F.col("line").cast("bigint").alias("line"),
        F.col("job_id").cast("bigint").alias("job_id"),
        "symbol",
        *[F.col(c).cast("double").alias(c) for c in ("total_return", "max_drawdown", "final_value")],
        F.col("num_trades").cast("int").alias("num_trades"),
        F.col("success").cast("boolean").alias("success"),
        "error_message",
    )


def summary_sink(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(
        "submitted long, successful long, failed long, total_seconds double, jobs_per_second double"
    ).json(f"{_sunk(spark, folder)}/summary")


def report_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report = scalability_report(spark, folder)
    sinks.write_report(report, path)
    return spark.read.option("header", True).schema(report.schema).csv(path)


def job_lookup(spark: SparkSession, folder: str) -> DataFrame:
    run = _faulty_run(spark, folder)
    answers = run.results().filter("success").select("job_id", "symbol", "final_value")
    return status.lookup(run.placed.select("job_id", "symbol", "start_date"), answers)


def job_missing(spark: SparkSession, folder: str) -> DataFrame:
    run = _faulty_run(spark, folder)
    return status.unanswered(run.placed, run.results().filter("success")).select("job_id", "symbol", "strategy")


def scalability_report(spark: SparkSession, folder: str) -> DataFrame:
    report = reports.scalability(tables.runs(spark, folder))
    return report.select(
        *[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else c for c, kind in report.dtypes]
    )


def trading_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Weekdays between each order priority's first and last order."""
    ends = tables.table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("start"),
        F.max(F.col("o_orderdate").cast("date")).alias("end"),
    )
    return calendar.trading_days(ends, F.col("start"), F.col("end"))


def price_path(spark: SparkSession, folder: str) -> DataFrame:
    """One path per order priority; returns of up to 2 % from the order totals."""
    cents = F.floor(F.col("o_totalprice") * 100).cast("bigint")
    returns = tables.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("step"),
        ((F.pmod(cents, F.lit(401)) - 200) / 10000.0).alias("r"),
    ).withColumn("block", period_block(F.col("date"), 1))
    path = calendar.price_path(returns, "symbol", "block", ["date", "step"], 100.0)
    return path.select("symbol", "date", "step", F.round("price", 6).alias("price"))


def liveness_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.gaps(tables.heartbeats(spark, folder), SILENCE)


def _dead(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.dead_entities(
        tables.heartbeats(spark, folder), F.lit(AS_OF).cast("timestamp_ntz"), SILENCE
    )


def dead_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _dead(spark, folder)


def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.latest_status(tables.heartbeats(spark, folder), ["active_jobs", "completed_jobs"])


def orphaned_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return liveness.orphaned(
        tables.ledger(spark, folder), _dead(spark, folder), tables.answered(spark, folder)
    )


def ledger_counts(spark: SparkSession, folder: str) -> DataFrame:
    dead = _dead(spark, folder)
    return liveness.ledger_counts(
        liveness.ledger_status(tables.ledger(spark, folder), dead, tables.answered(spark, folder)),
        tables.heartbeats(spark, folder),
        dead,
    )


def _split_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(packed, jobs, states after 1997, states after 1999 continued from those)."""
    packed = _packed(spark, folder, max(PAIR))
    jobs = _jobs(spark, folder, [_param(*PAIR, *FULL)])
    first = written(backtest.run(packed, backtest.until(jobs, "1997-06-30")).state(), "state")
    second = written(backtest.run(packed, backtest.until(jobs, "1999-12-31"), first).state(), "state")
    return packed, jobs, first, second


STATE_COLUMNS = ["job_id", "symbol", "bars_processed", "last_date", "cash", "shares", "saved_value"]


def state_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return state.progress(_single(spark, folder).equity(state.SNAPSHOT_BARS))


def state_latest(spark: SparkSession, folder: str) -> DataFrame:
    _, _, first, second = _split_runs(spark, folder)
    return state.latest(first.unionByName(second)).select(*STATE_COLUMNS)


def state_open_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Saved jobs that still hold shares; the flat ones are taken as finished and deleted."""
    _, _, first, second = _split_runs(spark, folder)
    finished = second.filter("shares = 0")
    return state.open_jobs(state.without(first.unionByName(second), finished))


def state_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with a valid state; every third state of the first run is marked invalid."""
    _, jobs, first, _ = _split_runs(spark, folder)
    marked = first.withColumn("valid", F.col("job_id") % 3 != 0)
    return state.existing(jobs, marked).select("job_id", "symbol")


def resume_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs in sequence, each continuing the saved states of the one before."""
    packed, jobs, first, second = _split_runs(spark, folder)
    return backtest.run(packed, jobs, first.unionByName(second)).results().drop("error_message")


def momentum_frame(bars: DataFrame, jobs: DataFrame) -> DataFrame:
    """Example strategy: BUY after a rise, SELL after a fall, HOLD otherwise."""
    rise = F.coalesce(F.signum((F.col("close") - F.col("prev_close")).cast("double")), F.lit(0.0))
    return bars.select("job_id", "idx", rise.cast("int").alias("signal"))


def momentum_pandas(job_id: int):
    """The same strategy in Python."""

    def signals(bars: pd.DataFrame):
        return np.sign(bars["close"] - bars["prev_close"].fillna(bars["close"])).astype("int32")

    return signals


def _custom(spark: SparkSession, folder: str, strategy: Strategy) -> DataFrame:
    jobs = _jobs(spark, folder, [dict(strategy="MOMENTUM", **_param(*PAIR, *FULL))])
    run = backtest.run(_packed(spark, folder, 1), jobs, strategies={"MOMENTUM": strategy})
    return run.results().drop("error_message")


def slope_frame(bars: DataFrame, jobs: DataFrame) -> DataFrame:
    """Example strategy that repeats its signal: BUY above 110, SELL below."""
    return bars.select("job_id", "idx", F.when(F.col("close") > 11000, 1).otherwise(-1).alias("signal"))


class SlopePandas:
    """The same in Python, with a memory of the last close that survives a resume."""

    def __init__(self, job_id: int, memory: str | None = None):
        self.seen = int(memory) if memory else 0

    def __call__(self, bars: pd.DataFrame):
        self.seen += len(bars)
        return np.where(bars["close"] > 11000, 1, -1).astype("int32")

    def save(self) -> str:
        return str(self.seen)


def _resumed(spark: SparkSession, folder: str, strategy: Strategy) -> DataFrame:
    packed = _packed(spark, folder, 1)
    jobs = _jobs(spark, folder, [dict(strategy="SLOPE", **_param(*PAIR, *FULL))])
    named = {"SLOPE": strategy}
    first = written(backtest.run(packed, backtest.until(jobs, "1997-06-30"), strategies=named).state(), "state")
    return backtest.run(packed, jobs, first, strategies=named).results().drop("error_message")


def resume_custom(spark: SparkSession, folder: str) -> DataFrame:
    return _resumed(spark, folder, FrameStrategy(slope_frame))


def resume_pandas(spark: SparkSession, folder: str) -> DataFrame:
    return _resumed(spark, folder, PandasStrategy(SlopePandas))


def momentum_block(stretch: Stretch, entry) -> np.ndarray:
    """The first example on arrays; the close before a stretch is at hand."""
    before = stretch.before[-1] if len(stretch.before) else stretch.close[0]
    return np.sign(np.diff(stretch.close, prepend=before))


def slope_block(stretch: Stretch, entry) -> np.ndarray:
    """The second example on arrays."""
    return np.where(stretch.close > 11000, 1, -1)


def breakout_block(stretch: Stretch, entry) -> np.ndarray:
    """Example strategy with a memory of all bars: BUY above, SELL below every close before."""
    low, high = entry or (int(stretch.close[0]), int(stretch.close[0]))
    high_before = np.maximum.accumulate(np.concatenate(([high], stretch.close[:-1])))
    low_before = np.minimum.accumulate(np.concatenate(([low], stretch.close[:-1])))
    return np.where(stretch.close > high_before, 1, np.where(stretch.close < low_before, -1, 0))


BREAKOUT = BlockStrategy(
    breakout_block,
    lambda stretch: [int(stretch.close.min()), int(stretch.close.max())],
    lambda a, b: [min(a[0], b[0]), max(a[1], b[1])],
)


def custom_block_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return _custom(spark, folder, BlockStrategy(momentum_block))


def custom_block_breakout(spark: SparkSession, folder: str) -> DataFrame:
    return _custom(spark, folder, BREAKOUT)


def resume_block_breakout(spark: SparkSession, folder: str) -> DataFrame:
    return _resumed(spark, folder, BREAKOUT)


def resume_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _resumed(spark, folder, BlockStrategy(slope_block, lambda stretch: len(stretch.close), lambda a, b: a + b))


def strategy_isolation(spark: SparkSession, folder: str) -> DataFrame:
    """Strategies that raise while they are built, while they run, or in some blocks, beside one that works."""

    def raises(bars: DataFrame, jobs: DataFrame) -> DataFrame:
        raise ValueError("cannot be built")

    def divides(bars: DataFrame, jobs: DataFrame) -> DataFrame:
        return bars.select("job_id", "idx", F.expr("idx % (close - close) AS signal"))

    def stumbles(stretch: Stretch, entry):
        raise ValueError("no such bar")

    named = {
        "BUILDS": FrameStrategy(raises), "DIVIDES": FrameStrategy(divides), "MOMENTUM": FrameStrategy(momentum_frame),
        "STUMBLES": BlockStrategy(stumbles),
    }
    listed = joblist.grid(tables.symbols(spark, folder), [dict(strategy=name, **_param(*PAIR, *FULL)) for name in named])
    jobs = joblist.number(listed, ["symbol", "strategy"])
    run = backtest.run(_packed(spark, folder, 1), jobs, strategies=named)
    return run.results().select("job_id", "symbol", "num_trades", "final_value", "success", "error_message")


def strategy_failures(spark: SparkSession, folder: str) -> DataFrame:
    """User strategies that raise, give too few signals, or two for one bar and none for the next."""

    def raising(job_id: int):
        raise ValueError("no idea")

    def too_few(job_id: int):
        return lambda bars: [0] * (len(bars) - 1)

    def doubled(bars: DataFrame, jobs: DataFrame) -> DataFrame:
        return bars.select("job_id", F.greatest(F.col("idx") - 1, F.col("idx") * 0).alias("idx"), F.lit(0).alias("signal"))

    faulty = {
        "DOUBLED": FrameStrategy(doubled), "FEW": PandasStrategy(too_few), "RAISES": PandasStrategy(raising),
    }
    params = [dict(strategy=name, **_param(*PAIR, *FULL)) for name in faulty]
    listed = joblist.grid(tables.symbols(spark, folder), params)
    jobs = joblist.number(listed, ["symbol", "strategy"])
    run = backtest.run(_packed(spark, folder, 1), jobs, strategies=faulty)
    return run.results().select("job_id", "symbol", "success", "error_message")


def _ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as a bar of its return flag: long series with many bars a day."""
    price = F.pmod(F.floor(F.col("l_extendedprice") * 100).cast("bigint"), F.lit(2000).cast("bigint")) + 10000
    return tables.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.col("l_quantity").cast("bigint").alias("volume"),
    )


LONG_WINDOWS = [
    dict(start_date=FULL[0], end_date=FULL[1], short_window=short, long_window=long, initial_capital=10000.0)
    for short, long in [(5000, 9000), (100, 5000), (9000, 200)]
]


def sweep_long_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of several blocks."""
    symbols = tables.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct()
    jobs = joblist.number(
        joblist.grid(symbols, LONG_WINDOWS), ["symbol", "short_window", "long_window", "start_date"]
    )
    packed = backtest.prepare(_ticks(spark, folder), backtest.largest_window(jobs))
    return backtest.run(packed, jobs).results().drop("error_message")


POISON_WINDOWS = [
    dict(start_date=FULL[0], end_date=FULL[1], short_window=short, long_window=long, initial_capital=10000.0)
    for short, long in [(5, 20), (20, 2**31 - 1), (10**9, 50), (200, 1200), (12000, 200)]
]


def sweep_poison_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of any length beside short ones, on blocks whose look-back was made for twenty bars."""
    symbols = tables.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct()
    jobs = joblist.number(
        joblist.grid(symbols, POISON_WINDOWS), ["symbol", "short_window", "long_window", "start_date"]
    )
    return backtest.run(backtest.prepare(_ticks(spark, folder), 20), jobs).results().drop("error_message")


HUGE_SWEEP = [_param(short, long, *FULL, 1.5e16) for short, long in [(2, 5), (20, 50)]]


def sweep_huge_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Closes of some 10^18, whose window sums no BIGINT holds, beside ordinary ones."""
    huge = F.col("close") * 100_000_000_000_000 + F.pmod("volume", F.lit(7))
    bars = tables.bars(spark, folder).withColumn("close", F.when(F.substring("symbol", -1, 1) <= "3", huge).otherwise(F.col("close")))
    packed = backtest.prepare(bars, 50, unique_dates=True)
    return backtest.run(packed, _jobs(spark, folder, HUGE_SWEEP)).results().drop("error_message")


FINE = 10_000


def sweep_fine_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of four decimals, through text files and a sweep in units of a hundredth of a cent."""
    path = f"{shared_folder(spark)}/fine-{uuid.uuid4().hex}"
    fine = tables.bars(spark, folder).withColumns(
        {c: F.col(c) * 100 + F.pmod("volume", F.lit(100)) for c in csv_bars.PRICES}
    )
    csv_bars.save(fine, path, FINE)
    packed = backtest.prepare(csv_bars.load(spark, path, units=FINE), max(PAIR))
    jobs = _jobs(spark, folder, [_param(*PAIR, *FULL)])
    return backtest.run(packed, jobs, units=FINE).results().drop("error_message")


def custom_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return _custom(spark, folder, FrameStrategy(momentum_frame))


def custom_pandas_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return _custom(spark, folder, PandasStrategy(momentum_pandas))


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All bars written as text per symbol and read back."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    csv_bars.save(tables.bars(spark, folder), path)
    return csv_bars.load(spark, path)


#: Symbols that a path has to carry in disguise.
ODD_SYMBOLS = {"Brand#11": "000001", "Brand#12": "A+B", "Brand#13": "50%", "Brand#14": "x/y z"}


def csv_load(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of oddly named symbols as text: no header, blanks around fields, blank lines, a seventh field."""
    path = f"{shared_folder(spark)}/odd-{uuid.uuid4().hex}"
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ODD_SYMBOLS.items() for x in kv]), F.col("symbol")), "symbol")
    money = [F.concat(F.lit(" "), F.format_string("%.2f", F.col(c) / 100.0), F.lit("\t")) for c in csv_bars.PRICES]
    line = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *money, "volume", F.lit("more"))
    rows = tables.bars(spark, folder).select(name.alias("symbol"), F.explode(F.array(line, F.lit("  "))).alias("line"))
    rows.write.partitionBy("symbol").option("quote", "\u0000").option("sep", "\u0001").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv_bars.load(spark, path)


def csv_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers with a tail, read by their prefix."""
    path = f"{shared_folder(spark)}/lenient-{uuid.uuid4().hex}"
    money = [F.format_string("%.2fUSD", F.col(c) / 100.0) for c in csv_bars.PRICES]
    line = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *money, F.concat("volume", F.lit(".75")))
    rows = tables.bars(spark, folder).select("symbol", line.alias("line"))
    rows.write.partitionBy("symbol").option("sep", "\u0001").csv(path)
    return csv_bars.load(spark, path, lenient=True)


def csv_source(spark: SparkSession, folder: str) -> DataFrame:
    """All bars through the data source's writer and reader."""
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    symbol_files.save(tables.bars(spark, folder), path)
    return symbol_files.load(spark, path)


def csv_source_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of the symbols of one brand family, oddly named ones among them: only their files are opened."""
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    symbol_files.save(tables.bars(spark, folder).withColumn("symbol", F.concat(F.lit("50% a/b+"), "symbol")), path)
    return symbol_files.load(spark, path).filter(F.startswith("symbol", F.lit("50% a/b+Brand#2")))


def csv_explicit_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """All bars written to files whose names say nothing, read as one given symbol."""
    path = f"{shared_folder(spark)}/unnamed-{uuid.uuid4().hex}"
    csv_bars.printed(tables.bars(spark, folder)).drop("symbol").write.option("header", True).csv(path)
    return csv_bars.load(spark, path, "GIVEN")


def csv_text_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Unpadded text dates keep their text order: positions, and the bars of a closed text range."""
    path = f"{shared_folder(spark)}/unpadded-{uuid.uuid4().hex}"
    unpadded = F.concat_ws("-", F.year("date"), F.month("date"), F.day("date"))
    csv_bars.save(tables.bars(spark, folder).withColumn("date", unpadded), path)
    placed = blocks.ranked(csv_bars.load(spark, path, dates_as_text=True)).drop("cs")
    return placed.withColumn("in_range", F.col("date").between("1996-1-1", "1996-12-31"))


def csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Bars as lines of which every 11th date lacks a field, every 13th holds a word and every 17th
    has high below low; the rejects with their reason."""
    day = F.datediff("date", F.lit("1995-01-01").cast("date"))
    money = {c: F.format_string("%.2f", F.col(c) / 100.0) for c in csv_bars.PRICES}
    swapped = F.pmod(day, F.lit(17)) == 0
    low = F.when(swapped, F.format_string("%.2f", F.col("high") / 100.0 + 1)).otherwise(money["low"])
    full = F.concat_ws(
        ",", F.date_format("date", "yyyy-MM-dd"), money["open"], money["high"], low,
        F.when(F.pmod(day, F.lit(13)) == 0, F.lit("n/a")).otherwise(money["close"]), "volume", F.lit("extra"),
    )
    short = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), money["open"], money["high"])
    raw = tables.bars(spark, folder).select(
        "symbol", F.when(F.pmod(day, F.lit(11)) == 0, short).otherwise(full).alias("line")
    )
    path = f"{shared_folder(spark)}/dirty-{uuid.uuid4().hex}"
    raw.select("symbol", F.col("line").alias("value")).write.partitionBy("symbol").text(path)
    lines = spark.read.text(path).select("symbol", F.col("value").alias("line"))
    return csv_bars.quarantine(csv_bars.parsed(lines))


def job_list(spark: SparkSession, folder: str) -> DataFrame:
    """The sweep's job list written as text and read back, numbered in line order."""
    listed = _jobs(spark, folder, SWEEP)
    path = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    (
        listed.repartitionByRange(4, "job_id").sortWithinPartitions("job_id")
        .select("symbol", "strategy", "start_date", "end_date", "short_window", "long_window", "initial_capital")
        .write.option("header", True).csv(path)
    )
    return jobs_csv.load(spark, path)


def stream_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """The single-pair backtest over bars that arrive in four steps."""
    jobs = _jobs(spark, folder, [_param(*PAIR, *FULL)])
    return _streamed(tables.bars(spark, folder), jobs).drop("success", "error_message")


def _streamed(bars: DataFrame, jobs: DataFrame) -> DataFrame:
    """The last result row of every job, over bars that arrive in four steps."""
    jobs = written(jobs, "jobs")
    rows = feed.run_in_steps(
        bars, "date", ["1996-07-01", "1998-01-01", "2000-03-01"], lambda s: stream_results.results(s, jobs), "update"
    )
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job_id"]), "batch").alias("r"))
    return last.select("job_id", "r.*").select(
        "job_id", "symbol", "bars",
        *[F.round(c, 6).alias(c) for c in ("total_return", "sharpe_ratio", "max_drawdown")],
        "final_value", "num_trades", "winning", "losing", "late_bars", "success", "error_message",
    )


def stream_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Valid and invalid jobs on a stream with several bars to a date."""
    params = [
        dict(strategy="SMA", **_param(*PAIR, *FULL)), dict(strategy="RSI", **_param(*PAIR, *FULL)),
        dict(strategy="SMA", **_param(0, 50, *FULL)), dict(strategy="SMA", **_param(*PAIR, *FULL, 0.0)),
    ]
    listed = joblist.grid(tables.symbols(spark, folder), params)
    jobs = joblist.number(listed, ["symbol", "strategy", "short_window", "initial_capital"])
    return _streamed(tables.split_bars(spark, folder), jobs)


def stream_liveness(spark: SparkSession, folder: str) -> DataFrame:
    """Alive periods of all users from a stream of events; a closing beat ends the open ones."""
    beats = tables.heartbeats(spark, folder).select("entity", F.col("ts").cast("timestamp").alias("ts"))
    closing = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("entity"), F.lit("2024-03-01 00:00:00").cast("timestamp").alias("ts")
    )
    feedable = beats.unionByName(closing).withColumn("day", F.to_date("ts"))
    rows = feed.run_in_steps(
        feedable, "day", ["2024-01-10", "2024-01-20", "2024-02-15"], lambda s: stream_live.sessions(s, SILENCE), "append"
    )
    return rows.filter("entity >= 0").select(
        "entity", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
        F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "beats",
    )


def stream_deaths(spark: SparkSession, folder: str) -> DataFrame:
    """Deaths and revivals of all users as they are told by timers, without a closing beat."""
    beats = tables.heartbeats(spark, folder).select("entity", F.col("ts").cast("timestamp").alias("ts"))
    rows = feed.run_in_steps(
        beats.withColumn("day", F.to_date("ts")), "day", ["2024-01-10", "2024-01-20", "2024-02-15"],
        lambda s: stream_live.watch(s, SILENCE), "append",
    )
    return rows.select("entity", "event", F.col("ts").cast("timestamp_ntz").alias("ts"))


def stream_continues(spark: SparkSession, folder: str) -> DataFrame:
    """A batch run up to a date, continued by a stream that starts from its states; symbols without a bar answer by timer."""
    params = [dict(strategy="SMA", **_param(*PAIR, *FULL), _prefix=""), dict(strategy="SMA", **_param(*PAIR, FULL[0], "2000-03-31"), _prefix="X-")]
    listed = joblist.grid(tables.symbols(spark, folder), params).withColumn("symbol", F.concat("_prefix", "symbol")).drop("_prefix")
    jobs = written(joblist.number(listed, ["symbol"]), "jobs")
    packed = _packed(spark, folder, max(PAIR))
    batch = backtest.run(packed, backtest.until(jobs, "1997-06-30"))
    told = written(stream_results.openings(packed, batch.placed, written(batch.state(), "state")), "openings")
    path = f"{shared_folder(spark)}/announced-{uuid.uuid4().hex}"
    told.write.parquet(path)
    later = tables.bars(spark, folder).filter("date > DATE'1997-06-30'")
    rows = feed.run_in_steps(
        later, "date", ["1998-01-01", "2000-06-01"],
        lambda s: stream_results.results(s, jobs, announced=spark.readStream.schema(told.schema).parquet(path)), "update",
    )
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job_id"]), "batch").alias("r"))
    return last.select("job_id", "r.*").select(
        "job_id", "symbol", "bars", *[F.round(c, 6).alias(c) for c in ("total_return", "sharpe_ratio", "max_drawdown")],
        "final_value", "num_trades", "winning", "losing", "success", "error_message",
    )


QUERIES = {
    f.__name__: f
    for f in (
        bars_valid, bars_range, bars_lookup, bars_position, bars_date_index, bars_last_per_date,
        bar_count, mean_close, volatility, sma, crossover_signals, signal_counts, trades,
        round_trips, equity_curve, equity_returns, drawdown_curve, backtest_result, backtest_sweep,
        job_status, run_summary, job_lookup, job_missing, scalability_report, trading_calendar,
        price_path, liveness_gaps, dead_entities, latest_status, orphaned_jobs, ledger_counts,
        state_snapshots, state_latest, state_open_jobs, resume_equivalence, custom_strategy, custom_pandas_strategy,
        csv_scan, csv_quarantine, job_list, stream_backtest, stream_liveness, csv_load, csv_lenient, result_sink,
        summary_sink, report_sink, state_exists, resume_custom, resume_pandas, strategy_failures,
        custom_block_strategy, custom_block_breakout, resume_block_breakout, resume_blocks, strategy_isolation,
        sweep_long_windows, sweep_poison_windows, sweep_huge_prices, sweep_fine_prices, stream_faults,
        stream_deaths, stream_continues, csv_source, csv_source_pruned, csv_explicit_symbol, csv_text_dates,
    )
}


def generated_bars(spark: SparkSession) -> DataFrame:
    """500 series of 1250 bars."""
    return spark.range(500 * 1250).select(
        F.format_string("S%03d", F.floor(F.col("id") / 1250).cast("int")).alias("symbol"),
        F.date_add(F.lit("2000-01-03").cast("date"), F.pmod("id", F.lit(1250)).cast("int")).alias("date"),
        (10000 + F.pmod(F.col("id") * 7919, F.lit(2000))).alias("close"),
    )


def generated_signals(spark: SparkSession) -> DataFrame:
    """Signals of the generated series for windows 50/200, ranking and packing included."""
    packed = backtest.prepare(generated_bars(spark), 200, unique_dates=True)
    names = packed.filter("iblock = 0").select("symbol")
    one = joblist.number(joblist.grid(names, [_param(50, 200, *FULL)]), ["symbol"])
    _, spans, dealt = backtest.locate(packed, one)
    return crossover.crossings(crossover.changes(dealt, spans))


def large_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol with 40 parameter sets, from bars to result rows."""
    params = [_param(short, long, *FULL) for short in range(5, 45, 2) for long in (60, 200)]
    jobs = written(_jobs(spark, folder, params), "jobs")
    return backtest.run(_packed(spark, folder, 200), jobs).results()


def workloads(spark: SparkSession, folder: str, timed) -> dict[str, float]:
    """Timings of the benchmark's own workloads, and of 2000 jobs on bars that are packed before the clock starts."""
    out = {
        "signals_500x1250_with_packing": timed(lambda: generated_signals(spark)),
        "sweep_25x40_with_packing": timed(lambda: large_sweep(spark, folder)),
    }
    packed = _packed(spark, folder, 200)
    params = [_param(short, long, *FULL) for short in range(5, 45) for long in (60, 200)]
    jobs = written(_jobs(spark, folder, params), "jobs")
    out["sweep_2000_jobs_packed"] = timed(lambda: backtest.run(packed, jobs).results())
    return out
