from __future__ import annotations

import random

import pytest

from barloom.operators import blocks, jobs as joblist
from barloom.plans import backtest
from tests import model
from tests.helpers import bars_of, by_job, day, jobs_of


def staircase() -> list[int]:
    """300 closes in cents: a saw tooth, a decline, a rise."""
    out = []
    for i in range(300):
        if i < 80:
            out.append(round(10000 + (i % 10) * 30 - 150))
        elif i < 120:
            out.append(10000 - (i - 80) * 30)
        else:
            out.append(8800 + (i - 120) * 60)
    return out


@pytest.fixture
def small_blocks(spark, monkeypatch):
    """Blocks of 64 bars, 2 jobs per cell, Arrow batches of 7 rows: every border is crossed often."""
    monkeypatch.setattr(blocks, "BLOCK_BITS", 6)
    monkeypatch.setattr(blocks, "BLOCK_DAYS", 16)
    monkeypatch.setattr(joblist, "JOBS_PER_CELL", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def walk(seed: int, n: int, start: int = 10000, spread: int = 300, low: int = 1) -> list[int]:
    rng, price, out = random.Random(seed), start, []
    for _ in range(n):
        price = max(low, price + rng.randint(-spread, spread))
        out.append(price)
    return out


def check(run: backtest.Run, jobs: list[tuple], series: dict[str, list[int]], step: int = 1) -> None:
    got = by_job(run.results())
    assert len(got) == len(jobs)
    for k, (symbol, _, a, b, short, long, capital) in enumerate(jobs, start=1):
        closes = [c for i, c in enumerate(series.get(symbol, [])) if a <= i * step <= b]
        if not closes:
            assert got[k]["error_message"] == "No data in date range"
            continue
        model.assert_result(got[k], model.backtest(closes, capital, model.signals(closes, short, long)))


def test_published_case(spark):
    closes = {"TEST": staircase()}
    run = backtest.run(
        backtest.prepare(bars_of(spark, closes), 50), jobs_of(spark, [("TEST", "SMA", 0, 400, 20, 50, 10000)])
    )
    row = by_job(run.results())[1]
    assert round(row["total_return"], 3) == 94.134
    assert row["final_value"] == 19413.40
    assert (row["num_trades"], row["winning"], row["losing"]) == (3, 0, 1)
    assert round(row["max_drawdown"], 6) == 1.5
    assert round(row["sharpe_ratio"], 6) == 15.497766
    made = [(r["idx"], r["signal"], r["shares"], r["price"]) for r in run.trades.orderBy("idx").collect()]
    assert made == [(80, 1, 100, 10000), (85, -1, 100, 9850), (138, 1, 99, 9880)]


def test_steady_rise_gives_no_signal(spark):
    closes = {"UP": [10000 + 50 * i for i in range(300)]}
    run = backtest.run(
        backtest.prepare(bars_of(spark, closes), 30), jobs_of(spark, [("UP", "SMA", 0, 400, 10, 30, 10000)])
    )
    row = by_job(run.results())[1]
    assert row["success"] and row["num_trades"] == 0 and row["total_return"] == 0.0


def test_many_jobs_over_small_blocks(spark, small_blocks):
    series = {f"S{k}": walk(k, n) for k, n in enumerate([700, 64, 65, 63, 1, 333])}
    jobs = []
    for symbol in series:
        for short, long in [(3, 10), (10, 3), (5, 20), (20, 50), (1, 2), (7, 7)]:
            jobs.append((symbol, "SMA", 0, 5000, short, long, 10000))
            jobs.append((symbol, "SMA", 37, 410, short, long, 777.77))
    run = backtest.run(backtest.prepare(bars_of(spark, series, step=1), 50), jobs_of(spark, jobs))
    check(run, jobs, series)
    # the curve agrees bar by bar, and the drawdown with the metric
    want = model.backtest(series["S0"], 10000, model.signals(series["S0"], 3, 10))
    curve = [r["equity"] for r in run.equity().filter("job_id = 1").orderBy("idx").collect()]
    assert curve == want["curve"]
    worst = run.drawdowns().filter("job_id = 1").agg({"drawdown_pct": "max"}).first()[0]
    assert worst == pytest.approx(want["max_drawdown"])


def test_prices_at_and_below_zero(spark, small_blocks):
    series = {"Z": [p - 60 for p in walk(5, 400, start=100, spread=30, low=0)]}
    jobs = [("Z", "SMA", 0, 1000, s, l, 1000) for s, l in [(2, 5), (5, 2), (4, 9), (10, 30)]]
    run = backtest.run(backtest.prepare(bars_of(spark, series), 30), jobs_of(spark, jobs))
    got = by_job(run.results())
    for k, (_, _, _, _, short, long, capital) in enumerate(jobs, start=1):
        if got[k]["success"]:
            want = model.backtest(series["Z"], capital, model.signals(series["Z"], short, long))
            model.assert_result(got[k], want)
        else:
            assert got[k]["error_message"].startswith("Invalid job:")
    made = {r["idx"]: r["signal"] for r in run.actions.filter("job_id = 1").collect()}
    assert made == {i: s for i, s in enumerate(model.signals(series["Z"], 2, 5)) if s}


def test_order_and_partitioning_of_the_input_do_not_matter(spark, small_blocks):
    series = {"A": walk(1, 300), "B": walk(2, 200)}
    jobs = jobs_of(spark, [("A", "SMA", 0, 999, 5, 20, 5000), ("B", "SMA", 0, 999, 5, 20, 5000)])
    bars = bars_of(spark, series)
    plain = by_job(backtest.run(backtest.prepare(bars, 20), jobs).results())
    shuffled = bars.orderBy("close").repartition(7)
    assert by_job(backtest.run(backtest.prepare(shuffled, 20), jobs).results()) == plain


def test_a_symbol_with_most_of_the_rows_and_equal_dates(spark, small_blocks):
    """Many bars per date: the total order decides."""
    closes = walk(9, 900)
    rows = [("HOT", day(i // 300), c, c, c, c, 1) for i, c in enumerate(closes)]
    rows += [(f"C{k}", day(i), c, c, c, c, 1) for k in range(3) for i, c in enumerate(walk(k, 40))]
    from barloom.schemas import BARS

    bars = spark.createDataFrame(rows, BARS)
    got = [
        (r["idx"], r["close"])
        for r in blocks.ranked(bars).filter("symbol = 'HOT'").orderBy("idx").collect()
    ]
    ordered = [c for d in range(3) for c in sorted(closes[d * 300 : d * 300 + 300])]
    assert got == list(enumerate(ordered))


def test_constant_prices_and_too_few_bars(spark):
    series = {"FLAT": [5000] * 100, "FEW": [5000, 5100, 5200]}
    jobs = jobs_of(spark, [("FLAT", "SMA", 0, 999, 3, 9, 100), ("FEW", "SMA", 0, 999, 3, 9, 100)])
    for row in by_job(backtest.run(backtest.prepare(bars_of(spark, series), 9), jobs).results()).values():
        assert row["success"] and row["num_trades"] == 0 and row["sharpe_ratio"] == 0.0


def test_capital_below_one_share_and_zero_profit(spark):
    series = {"A": [1000] * 6 + [900, 1000, 1100, 1100, 1000, 900, 800, 900, 1000, 1100, 1200, 1100, 900]}
    jobs = [("A", "SMA", 0, 999, 1, 3, capital) for capital in (5, 100)]
    run = backtest.run(backtest.prepare(bars_of(spark, series), 3), jobs_of(spark, jobs))
    check(run, jobs, series)
    assert by_job(run.results())[1]["num_trades"] == 0


@pytest.mark.parametrize("first,second", [(40, 41), (63, 128), (100, 250), (299, 299)])
def test_resumed_runs_equal_one_run(spark, small_blocks, first, second):
    series = {"A": staircase(), "B": walk(3, 300)}
    jobs = [(s, "SMA", 0, 999, a, b, 10000) for s in series for a, b in [(20, 50), (3, 8), (8, 3)]]
    listed = jobs_of(spark, jobs)
    packed = backtest.prepare(bars_of(spark, series), 50)
    whole = by_job(backtest.run(packed, listed).results())
    state = None
    for stop in sorted({first, second}):
        part = backtest.run(packed, backtest.until(listed, str(day(stop))), state).state()
        from barloom.storage import written

        part = written(part, "state")
        state = part if state is None else state.unionByName(part)
    got = by_job(backtest.run(packed, listed, state).results())
    for k, row in whole.items():
        model.assert_result(got[k], row)


def test_plans_have_no_pairwise_joins(spark):
    series = {"A": walk(1, 100), "B": walk(2, 100)}
    jobs = jobs_of(spark, [(s, "SMA", 0, 999, 5, 20, 5000) for s in series])
    run = backtest.run(backtest.prepare(bars_of(spark, series), 20), jobs)
    for table in (run.actions, run.results(), run.equity(), run.drawdowns(), run.state()):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # the metrics read only the closes of the packed blocks
    scans = [line for line in run.results()._jdf.queryExecution().executedPlan().toString().split("\n")
             if "FileScan" in line and "closes" in line]
    assert scans and all("sums" not in line for line in scans)
