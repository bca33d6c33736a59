"""Strategies on blocks: the same rows as on bars, memory across blocks and resumes, failures of their own jobs only."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import storage
from barloom.operators import blocks, jobs as joblist
from barloom.operators.strategies import MISMATCH, BlockStrategy, FrameStrategy
from barloom.plans import backtest, catalog
from tests import model
from tests.helpers import bars_of, by_job, day, jobs_of
from tests.test_backtest import walk


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BITS", 4)
    monkeypatch.setattr(joblist, "JOBS_PER_CELL", 2)


def breakout(closes: list[int]) -> list[int]:
    return [0 if not i else (1 if c > max(closes[:i]) else -1 if c < min(closes[:i]) else 0) for i, c in enumerate(closes)]


def test_memory_of_all_bars_before(spark, small):
    series = {"A": walk(1, 300), "B": walk(2, 17), "C": walk(3, 1)}
    jobs = [(s, "X", a, b, 1, 2, 10000) for s in series for a, b in ((0, 999), (13, 140), (16, 16))]
    run = backtest.run(backtest.prepare(bars_of(spark, series), 1), jobs_of(spark, jobs), strategies={"X": catalog.BREAKOUT})
    got = by_job(run.results())
    for k, (symbol, _, a, b, *_, capital) in enumerate(jobs, start=1):
        closes = series[symbol][a : b + 1]
        if closes:
            model.assert_result(got[k], model.backtest(closes, capital, breakout(closes)))
        else:
            assert got[k]["error_message"] == "No data in date range"


def test_repeated_signals_across_blocks_are_one_action(spark, small):
    rising = list(range(1000, 1100))
    always = BlockStrategy(lambda stretch, entry: np.ones(len(stretch.close)))
    run = backtest.run(backtest.prepare(bars_of(spark, {"A": rising}), 1), jobs_of(spark, [("A", "X", 0, 999, 1, 2, 100)]), strategies={"X": always})
    assert [r["idx"] for r in run.actions.collect()] == [0]


def test_same_rows_as_on_bars(spark, small):
    series = {"A": walk(5, 200), "B": walk(6, 130)}
    jobs = jobs_of(spark, [(s, n, 3, 999, 1, 2, 10000) for s in series for n in ("BARS", "BLOCKS")])
    both = {"BARS": FrameStrategy(catalog.momentum_frame), "BLOCKS": BlockStrategy(catalog.momentum_block)}
    run = backtest.run(backtest.prepare(bars_of(spark, series), 1), jobs, strategies=both)
    rows = {}
    for r in run.actions.collect():
        rows.setdefault(r["job_id"], set()).add((r["idx"], r["date"], r["close"], r["signal"]))
    assert rows[1] == rows[2] and rows[3] == rows[4] and len(rows[1]) > 50


def test_resumed_in_the_middle_of_a_block(spark, small):
    closes = walk(9, 120)
    packed = backtest.prepare(bars_of(spark, {"A": closes}), 1)
    jobs = jobs_of(spark, [("A", "X", 0, 999, 1, 2, 10000)])
    state = None
    for stop in (5, 37, 80):
        part = storage.written(backtest.run(packed, backtest.until(jobs, str(day(stop))), state, strategies={"X": catalog.BREAKOUT}).state(), "state")
        state = part if state is None else state.unionByName(part)
    got = by_job(backtest.run(packed, jobs, state, strategies={"X": catalog.BREAKOUT}).results())
    model.assert_result(got[1], model.backtest(closes, 10000, breakout(closes)))


def test_bars_are_not_shuffled(spark, small):
    packed = backtest.prepare(bars_of(spark, {"A": walk(1, 200)}), 1)
    _, spans, dealt = backtest.locate(packed, jobs_of(spark, [("A", "X", 0, 999, 1, 2, 100)]), strategies=["X"])
    acts, failed, last = BlockStrategy(catalog.momentum_block).block_actions(dealt, spans)
    made = acts._jdf.queryExecution().analyzed().toString()
    assert "explode" not in made.lower() and acts.count() < 200 and failed.count() == 0 and last.count() == 1


def test_failures_stay_with_their_jobs(spark, small):
    closes = walk(4, 100)

    def late(stretch, entry):
        if stretch.idx[0] >= 48:
            raise ValueError("half way")
        return np.zeros(len(stretch.close))

    def unsummed(stretch):
        raise ValueError("no summary")

    def building(bars, jobs):
        raise ValueError("not built")

    def running(bars, jobs):
        return bars.select("job_id", "idx", F.expr("CAST(1 / (close - close) AS INT) AS signal"))

    named = {
        "BUILT": FrameStrategy(building), "COMBINED": BlockStrategy(late, lambda s: 1, lambda a, b: a / 0), "FEW": BlockStrategy(lambda s, e: [0]),
        "GOOD": catalog.BREAKOUT, "LATE": BlockStrategy(late), "RUN": FrameStrategy(running), "SUMMED": BlockStrategy(late, unsummed, max),
    }
    jobs = jobs_of(spark, [("A", n, 0, 999, 1, 2, 10000) for n in named])
    got = by_job(backtest.run(backtest.prepare(bars_of(spark, {"A": closes}), 1), jobs, strategies=named).results())
    model.assert_result(got[4], model.backtest(closes, 10000, breakout(closes)))
    said = {n: got[k]["error_message"] for k, n in enumerate(named, start=1)}
    assert said["FEW"] == MISMATCH and said["GOOD"] is None
    for name, why in {"BUILT": "not built", "LATE": "half way", "SUMMED": "no summary", "COMBINED": "division by zero", "RUN": "DIVIDE_BY_ZERO"}.items():
        assert said[name] == f"Signal generation failed: {why}"
