"""The job sweep: bars and jobs in, one result row per job out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.metrics import sharpe_ratio, total_return_percent
from barloom.operators import blocks, crossover, equity, jobs as joblist, portfolio, state as saved, status
from barloom.operators.strategies import BlockStrategy, Strategy
from barloom.storage import written
from barloom.schemas import BUY, MINOR_UNITS, SELL

STRATEGIES = ["SMA"]


def prepare(bars: DataFrame, max_window: int, unique_dates: bool = False) -> DataFrame:
    """Packed blocks, written once for many sweeps. They answer windows of any length; those up to `max_window` (and
    a block's length) without looking into other blocks."""
    return written(blocks.pack(blocks.ranked(bars, unique_dates), max_window + 1), "packed")


def largest_window(jobs: DataFrame, strategies: list[str] | None = None, units: int = MINOR_UNITS) -> int:
    """The largest window of the jobs that can run (one aggregated row reaches the driver)."""
    valid = jobs.filter(joblist.invalid_reason(strategies or STRATEGIES, units).isNull())
    return int(valid.agg(F.max(F.greatest("short_window", "long_window"))).first()[0] or 1)


@dataclass
class Run:
    """The tables of one sweep. Jobs are placed and trades folded when it is made; the rest is lazy."""

    placed: DataFrame
    spans: DataFrame
    spread: DataFrame
    changes: DataFrame | None
    actions: DataFrame
    portfolio: DataFrame
    trades: DataFrame
    resumed: bool = False
    units: int = MINOR_UNITS
    last: DataFrame | None = None
    far: DataFrame | None = None

    def signals(self) -> DataFrame:
        """Every bar of every crossover job with its averages and its signal."""
        return crossover.job_series(self.spread, self.spans.filter(F.col("strategy").isin(*STRATEGIES)), self.actions, self.far)

    def equity(self, every: int = 1) -> DataFrame:
        """Equity of the jobs that succeed, at every bar or at every so many."""
        fine = self.outcome().filter("error_message IS NULL").select("job_id")
        spans = portfolio.opening_portfolio(self.spans).join(fine, "job_id", "left_semi")
        trades = self.trades.join(fine, "job_id", "left_semi")
        return equity.equity_rows(equity.intervals(trades, spans), self.spread, every)

    def drawdowns(self) -> DataFrame:
        return equity.drawdown_rows(self.equity())

    def outcome(self) -> DataFrame:
        holds = portfolio.holdings(self.trades, self.spans if self.resumed else None)
        metrics = equity.piece_metrics(equity.pieces(holds, self.spread))
        return outcome(self.placed, self.portfolio, metrics)

    def results(self) -> DataFrame:
        return result_rows(self.outcome(), self.units)

    def state(self) -> DataFrame:
        """The saved state after the last bar of every job, to be handed to the next run."""
        return state_rows(self.outcome(), self.changes, self.spans, self.last)


def locate(
    packed: DataFrame,
    jobs: DataFrame,
    state: DataFrame | None = None,
    files: DataFrame | None = None,
    folder: str = "",
    strategies: list[str] | None = None,
    units: int = MINOR_UNITS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all jobs with their place, the runnable ones, the blocks dealt to cells).

    With a saved state the runnable jobs start behind the bars it has seen, with its portfolio.
    With a listing of symbol `files` a job without data says whether its file is missing or empty.
    """
    placed = joblist.place(packed, jobs, strategies or STRATEGIES, files is not None, units)
    if files is not None:
        placed = status.with_load_errors(placed, files, folder)
    placed = written(placed, "placed")
    spans = joblist.runnable(placed)
    if state is None:
        spans = spans.withColumn("r0", F.col("i0"))
    else:
        spans = spans.join(saved.usable(state), "job_id", "left").withColumn(
            "r0", F.col("i0") + F.coalesce("bars_processed", F.lit(0))
        )
        fresh = portfolio.opening_portfolio(
            spans.drop(*portfolio.PORTFOLIO)
        ).select("job_id", *[F.col(c).alias(f"__{c}") for c in portfolio.PORTFOLIO])
        spans = spans.join(fresh, "job_id").select(
            *[c for c in spans.columns if c not in portfolio.PORTFOLIO],
            *[F.when(F.col("bars_processed").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
              for c in portfolio.PORTFOLIO],
        )
        spans = written(spans, "spans")
    return placed, spans, joblist.spread(packed, spans)


def until(jobs: DataFrame, date: str) -> DataFrame:
    """The same jobs, processed no further than `date` (a text date where jobs have text dates)."""
    kind = dict(jobs.dtypes)["end_date"]
    return jobs.withColumn("end_date", F.least("end_date", F.lit(date).cast(kind)))


def run(
    packed: DataFrame,
    jobs: DataFrame,
    state: DataFrame | None = None,
    files: DataFrame | None = None,
    folder: str = "",
    strategies: dict[str, Strategy | BlockStrategy] | None = None,
    units: int = MINOR_UNITS,
) -> Run:
    """Evaluate every job. `strategies` adds user strategies by the name jobs give in `strategy`.

    `units`: minor units per currency unit of the packed prices.
    """
    custom = strategies or {}
    placed, spans, dealt = locate(packed, jobs, state, files, folder, [*STRATEGIES, *custom], units)
    crossing = spans.filter(F.col("strategy").isin(*STRATEGIES))
    far = crossover.pieces(packed, crossing)
    changes = crossover.changes(dealt, crossing, far)
    actions = crossover.crossings(changes, None if state is None else spans)
    errors = last = None
    for name, strategy in custom.items():
        mine = F.col("strategy") == name
        if isinstance(strategy, BlockStrategy):
            found, failed, ended = strategy.block_actions(dealt, spans.filter(mine))
        else:
            found, failed, ended = strategy.actions(
                crossover.series_rows(crossover.on_blocks(dealt, spans.filter(mine))), spans.filter(mine)
            )
        actions = actions.unionByName(found)
        errors = failed if errors is None else errors.unionByName(failed)
        last = ended if last is None else last.unionByName(ended)
    after, trades = portfolio.fold(actions, spans)
    if errors is not None:
        after = after.join(errors, "job_id", "left").withColumn(
            "fault", F.coalesce("error", "fault")
        ).drop("error")
    return Run(placed, spans, dealt, changes, actions, after, trades, state is not None, units, last, far)


def outcome(placed: DataFrame, folded: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per job of `placed`: portfolio, final value, moments of the returns, drawdown, error.

    The moments pool three groups: saved returns, returns while holding, zero returns while flat.
    """
    before = [c for c in saved.MOMENTS if c in folded.columns]
    joined = placed.join(
        folded.select("job_id", "r0", *portfolio.PORTFOLIO, *before), "job_id", "left"
    ).join(metrics, "job_id", "left")
    absent = [f"CAST(NULL AS {kind}) AS {c}" for c, kind in saved.MOMENTS.items() if c not in before]
    return (
        joined.selectExpr("*", *absent)
        .selectExpr(
            "*",
            # a position bought at the very last bar has no later close; its value is what was paid
            """CASE WHEN r0 > i1 THEN saved_value WHEN shares = 0 THEN cash
                 ELSE try_add(cash, if(last_close IS NULL, last_buy_value, try_multiply(shares, last_close)))
               END AS final""",
            "coalesce(saved_n, 0D) AS s_n",
            "coalesce(saved_mean, 0D) AS s_mean",
            "coalesce(h_n, 0D) AS held",
            "coalesce(h_mean, 0D) AS held_mean",
            # no return at the first bar of a job, nor after a value that is not positive
            """greatest(0L, i1 - greatest(r0, i0 + 1) + 1) - coalesce(h_skipped, 0D) - coalesce(h_n, 0D)
               - coalesce(if(shares = 0 AND cash <= 0, i1 - greatest(last_trade_idx, r0 - 1), 0L), 0L) AS flat""",
            "greatest(saved_peak, CAST(capital AS DOUBLE)) AS peak_before",
        )
        .selectExpr("*", "s_n + held + flat AS ret_n", "coalesce((s_n * s_mean + held * held_mean) / nullif(s_n + held + flat, 0), 0D) AS ret_mean")
        .selectExpr(
            "*",
            """coalesce(saved_m2, 0D) + coalesce(h_m2, 0D) + s_n * pow(s_mean - ret_mean, 2)
               + held * pow(held_mean - ret_mean, 2) + flat * pow(ret_mean, 2) AS ret_m2""",
            "greatest(peak_before, h_peak) AS peak",
            "greatest(saved_drawdown, h_drawdown, (peak_before - h_low) / peak_before, 0D) AS drawdown",
            """coalesce(invalid, if(i0 IS NULL, 'No data in date range', NULL), fault,
                 if(h_low < 0, 'Invalid job: negative equity', NULL),
                 if(final IS NULL, 'Invalid job: numeric overflow', NULL)) AS error_message""",
        )
    )


def result_rows(outcomes: DataFrame, units: int = MINOR_UNITS) -> DataFrame:
    """Result rows; failures are rows with zero metrics and a message."""
    ok = F.col("error_message").isNull()
    deviation = F.expr("sqrt(coalesce(ret_m2 / nullif(ret_n, 0), 0D))")
    return outcomes.select(
        "job_id",
        "symbol",
        total_return_percent(F.col("final"), F.col("capital")).alias("total_return"),
        sharpe_ratio(F.col("ret_n"), F.col("ret_mean"), deviation).alias("sharpe_ratio"),
        "drawdown", "final", "num_trades", "winning", "losing",
        ok.alias("success"),
        "error_message",
    ).selectExpr(
        "job_id",
        "symbol",
        "if(success, round(total_return, 6), 0D) AS total_return",
        "if(success, round(sharpe_ratio, 6), 0D) AS sharpe_ratio",
        "if(success, round(drawdown * 100D, 6), 0D) AS max_drawdown",
        f"if(success, final / {units}D, 0D) AS final_value",
        *[f"CAST(if(success, {c}, 0L) AS INT) AS {c}" for c in ("num_trades", "winning", "losing")],
        "success",
        "error_message",
    )


def state_rows(
    outcomes: DataFrame, changes: DataFrame, spans: DataFrame, last: DataFrame | None = None
) -> DataFrame:
    last_dir = changes.groupBy("job_id").agg(F.max_by("dir", "idx").alias("new_dir"))
    carried = {"saved_dir": "int", "saved_signal": "int", "saved_memory": "string"}
    before = spans.select("job_id", *[
        F.col(c) if c in spans.columns else F.lit(None).cast(kind).alias(c) for c, kind in carried.items()
    ])
    ok = outcomes.filter(F.col("error_message").isNull()).drop(*carried)
    if last is None:
        ok = ok.withColumns({"new_signal": F.lit(None).cast("int"), "new_memory": F.lit(None).cast("string")})
    else:
        ok = ok.join(last, "job_id", "left")
    return ok.join(last_dir, "job_id", "left").join(before, "job_id", "left").select(
        "job_id",
        "symbol",
        (F.col("i1") - F.col("i0") + 1).alias("bars_processed"),
        F.col("last_date"),
        *portfolio.PORTFOLIO,
        F.col("final").alias("saved_value"),
        F.col("ret_n").alias("saved_n"),
        F.col("ret_mean").alias("saved_mean"),
        F.col("ret_m2").alias("saved_m2"),
        F.col("peak").alias("saved_peak"),
        F.col("drawdown").alias("saved_drawdown"),
        F.coalesce("new_dir", "saved_dir").alias("saved_dir"),
        F.coalesce("new_signal", "saved_signal").alias("saved_signal"),
        F.coalesce("new_memory", "saved_memory").alias("saved_memory"),
        F.lit(True).alias("valid"),
    )


def round_trips(trades: DataFrame) -> DataFrame:
    """SELL directly after BUY: one row per closed position; a profit of zero is not a win."""
    by_job = Window.partitionBy("job_id").orderBy("idx")
    before = F.lag(F.struct("signal", "value", "date")).over(by_job)
    return (
        trades.withColumn("before", before)
        .filter((F.col("signal") == SELL) & (F.col("before.signal") == BUY))
        .select(
            "job_id",
            "symbol",
            F.col("before.date").alias("buy_date"),
            F.col("date").alias("sell_date"),
            (F.col("value") - F.col("before.value")).alias("profit"),
            (F.col("value") > F.col("before.value")).alias("win"),
        )
    )
