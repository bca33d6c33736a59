from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import blocks
from barloom.operators.strategies import FrameStrategy, MISMATCH, PandasStrategy
from barloom.plans import backtest
from barloom.plans.catalog import momentum_frame, momentum_pandas
from tests import model
from tests.helpers import bars_of, by_job, jobs_of
from tests.test_backtest import walk


def momentum(closes):
    return [0] + [(b > a) - (b < a) for a, b in zip(closes, closes[1:])]


def test_strategies_by_name(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BITS", 6)
    monkeypatch.setattr(blocks, "BLOCK_DAYS", 16)
    closes = walk(4, 400)

    def failing(job_id):
        def signals(bars):
            raise ValueError("no idea")
        return signals

    def too_few(job_id):
        return lambda bars: [0] * (len(bars) - 1)

    def one_less(bars, jobs):
        return momentum_frame(bars, jobs).filter("idx > 0")

    strategies = {
        "FRAME": FrameStrategy(momentum_frame), "PANDAS": PandasStrategy(momentum_pandas),
        "RAISES": PandasStrategy(failing), "FEW": PandasStrategy(too_few), "LESS": FrameStrategy(one_less),
    }
    names = ["FRAME", "PANDAS", "RAISES", "FEW", "LESS", "SMA", "RSI"]
    jobs = jobs_of(spark, [("A", name, 0, 999, 5, 20, 10000) for name in names])
    run = backtest.run(backtest.prepare(bars_of(spark, {"A": closes}), 20), jobs, strategies=strategies)
    got = by_job(run.results())
    want = model.backtest(closes, 10000, momentum(closes))
    model.assert_result(got[1], want)
    model.assert_result(got[2], want)
    assert got[3]["error_message"] == "Signal generation failed: no idea"
    assert got[4]["error_message"] == MISMATCH and got[5]["error_message"] == MISMATCH
    model.assert_result(got[6], model.backtest(closes, 10000, model.signals(closes, 5, 20)))
    assert got[7]["error_message"] == "Invalid job: unknown strategy RSI"
    assert got[7]["final_value"] == 0.0 and got[7]["num_trades"] == 0


def test_repeated_buy_acts_only_after_a_change(spark):
    """BUY on consecutive bars is one signal; BUY after HOLD is a new one."""
    closes = [1000, 50, 50, 60, 70]

    def fixed(bars, jobs):
        return bars.select("job_id", "idx", F.element_at(F.array(*[F.lit(x) for x in (1, 0, 1, 1, 0)]),
                                                        (F.col("idx") + 1).cast("int")).alias("signal"))

    jobs = jobs_of(spark, [("A", "FIXED", 0, 99, 1, 2, 1.0)])
    run = backtest.run(backtest.prepare(bars_of(spark, {"A": closes}), 2), jobs, strategies={"FIXED": FrameStrategy(fixed)})
    assert [(r["idx"], r["shares"]) for r in run.trades.collect()] == [(2, 2)]
    model.assert_result(by_job(run.results())[1], model.backtest(closes, 1.0, [1, 0, 1, 1, 0]))
