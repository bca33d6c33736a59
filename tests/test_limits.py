"""What must not be refused, rounded, lost or taken for something else."""

from __future__ import annotations

import types

import pytest
from pyspark.sql import functions as F

from barloom import storage
from barloom.operators import blocks
from barloom.operators.jobs import cells
from barloom.operators.strategies import MISMATCH, FrameStrategy, PandasStrategy
from barloom.plans import backtest
from barloom.sources import csv_bars
from tests import model
from tests.helpers import bars_of, by_job, day, jobs_of
from tests.test_backtest import walk
from tests.test_sources import GOOD, write

ODD = ["000001", "A+B", "50%", "x y", "1e3"]


def test_odd_symbols_in_both_layouts(spark, tmp_path):
    for name in ODD:
        write(tmp_path / "files", f"{name}.csv", "Date,Open,High,Low,Close,Volume", GOOD)
    plain = csv_bars.load(spark, str(tmp_path / "files"))
    assert sorted(r["symbol"] for r in plain.collect()) == sorted(ODD)
    listed = csv_bars.files(spark, str(tmp_path / "files"))
    assert sorted(r["symbol"] for r in listed.collect()) == sorted(ODD)
    more = bars_of(spark, {name: [1000, 1001] for name in [*ODD, "A/B"]})
    csv_bars.save(more, str(tmp_path / "saved"))
    again = csv_bars.load(spark, str(tmp_path / "saved"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, more.collect()))


def test_prices_are_neither_rounded_nor_lost(spark, tmp_path):
    rows = [
        "2020-01-02,1.2349,1.3,1.2,1.2345,5", "2020-01-03,inf,inf,1,2,5", "2020-01-06,0.0045,0.0050,0.0040,0.0045,5",
        "2020-01-07,1e300,1e300,1,2,5", "2020-01-08,1.1,1.3,1.07,1.29,5",
    ]
    write(tmp_path, "A.csv", *rows)
    cents = csv_bars.parsed(csv_bars.lines(spark, str(tmp_path)))
    assert [str(r["date"]) for r in csv_bars.bars(cents).collect()] == ["2020-01-08"]
    assert csv_bars.quarantine(cents).count() == 4
    fine = csv_bars.load(spark, str(tmp_path), units=10_000).orderBy("date").collect()
    assert [(r["open"], r["close"]) for r in fine] == [(12349, 12345), (45, 45), (11000, 12900)]


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BITS", 4)
    monkeypatch.setattr(blocks, "BLOCK_DAYS", 8)


def test_windows_over_several_blocks(spark, small):
    closes = {"A": walk(7, 300), "B": walk(8, 40)}
    listed = [("A", "SMA", 0, 999, 5, 50), ("A", "SMA", 3, 999, 90, 40), ("A", "SMA", 0, 999, 20, 150), ("B", "SMA", 0, 999, 2, 500)]
    jobs = [(*j, 10000) for j in listed]
    run = backtest.run(backtest.prepare(bars_of(spark, closes), 500), jobs_of(spark, jobs))
    got = by_job(run.results())
    for k, (symbol, _, a, _, short, long, capital) in enumerate(jobs, start=1):
        series = closes[symbol][a:]
        model.assert_result(got[k], model.backtest(series, capital, model.signals(series, short, long)))


def test_windows_above_the_look_back_are_answered(spark, small):
    """The look-back is what blocks answer by themselves, no limit: packed for 20, asked for 90 and 900."""
    closes = {"A": walk(7, 300)}
    jobs = [("A", "SMA", 0, 999, 5, 20, 10000), ("A", "SMA", 0, 999, 5, 90, 10000), ("A", "SMA", 0, 999, 5, 900, 10000)]
    got = by_job(backtest.run(backtest.prepare(bars_of(spark, closes), 20), jobs_of(spark, jobs)).results())
    for k, (_, _, _, _, short, long, capital) in enumerate(jobs, start=1):
        model.assert_result(got[k], model.backtest(closes["A"], capital, model.signals(closes["A"], short, long)))
    assert got[3]["success"] and got[3]["num_trades"] == 0  # longer than the series: no signal, no error


def test_invalid_jobs_do_not_widen_the_look_back(spark):
    jobs = jobs_of(spark, [("A", "SMA", 0, 9, 5, 20, 10000), ("A", "RSI", 0, 9, 5, 10**6, 10000), ("A", "SMA", 0, 9, 5, 10**6, -1)])
    assert backtest.largest_window(jobs) == 20


def test_only_covered_blocks_are_spread(spark, small):
    packed = backtest.prepare(bars_of(spark, {"A": walk(1, 320), "B": walk(2, 320)}), 10)
    run = backtest.run(packed, jobs_of(spark, [("A", "SMA", 40, 60, 3, 8, 10000)]))
    needed = cells(run.spans, "r0", "i1").select("symbol", "iblock", "salt").distinct()
    assert run.spread.count() == needed.count() == 2


def test_many_bars_on_a_date(spark, small):
    """One layout for every density: all bars of B on three dates."""
    closes = {"A": walk(3, 60), "B": walk(4, 90)}
    rows = bars_of(spark, {"A": closes["A"]}).unionByName(
        bars_of(spark, {"B": sorted(closes["B"])}).withColumn("date", F.expr("date_add('2000-01-01', cast(rank() over (order by close) / 31 as int))"))
    )
    ranked = blocks.ranked(rows).orderBy("symbol", "idx").collect()
    series = [r["close"] for r in ranked if r["symbol"] == "B"]
    assert [r["idx"] for r in ranked if r["symbol"] == "B"] == list(range(90)) and series == sorted(closes["B"])
    total = 0
    for r in (r for r in ranked if r["symbol"] == "B"):
        total += r["close"]
        assert r["cs"] == total


def test_large_capital(spark):
    closes = {"A": walk(5, 60)}
    got = by_job(backtest.run(backtest.prepare(bars_of(spark, closes), 8), jobs_of(spark, [("A", "SMA", 0, 99, 3, 8, 5e13)])).results())
    assert got[1]["success"]


def test_negative_price_at_a_buy_is_an_error(spark):
    def buys(bars, jobs):
        return bars.select("job_id", "idx", F.lit(1).alias("signal"))

    run = backtest.run(
        backtest.prepare(bars_of(spark, {"A": [-5, 10]}), 2), jobs_of(spark, [("A", "BUYS", 0, 9, 1, 2, 100)]),
        strategies={"BUYS": FrameStrategy(buys)},
    )
    assert by_job(run.results())[1]["error_message"] == "Invalid job: price at BUY must be positive"
    assert run.equity().count() == 0  # failed jobs have no curve


class Counting:
    """Buys from the tenth bar on, sells from the thirtieth; remembers how many it has seen."""

    def __init__(self, job_id, memory=None):
        self.seen = int(memory or 0)

    def __call__(self, bars):
        numbers = range(self.seen, self.seen + len(bars))
        self.seen += len(bars)
        return [0 if n < 10 else 1 if n < 30 else -1 for n in numbers]

    def save(self):
        return str(self.seen)


def test_user_strategies_resume_in_the_middle_of_a_buy(spark):
    closes = walk(9, 50)

    def steady(bars, jobs):
        return bars.select("job_id", "idx", F.when(F.col("idx") < 10, 0).when(F.col("idx") < 30, 1).otherwise(-1).alias("signal"))

    want = model.backtest(closes, 10000, [0] * 10 + [1] * 20 + [-1] * 20)
    strategies = {"FRAME": FrameStrategy(steady), "PANDAS": PandasStrategy(Counting)}
    jobs = jobs_of(spark, [("A", name, 0, 999, 1, 2, 10000) for name in strategies])
    packed = backtest.prepare(bars_of(spark, {"A": closes}), 2)
    first = storage.written(backtest.run(packed, backtest.until(jobs, str(day(20))), strategies=strategies).state(), "state")
    assert {r["job_id"]: (r["saved_signal"], r["saved_memory"]) for r in first.collect()} == {1: (1, None), 2: (1, "21")}
    got = by_job(backtest.run(packed, jobs, first, strategies=strategies).results())
    for k in (1, 2):
        model.assert_result(got[k], want)


def test_two_signals_for_one_bar_are_a_mismatch(spark):
    def doubled(bars, jobs):
        return bars.select("job_id", F.when(F.col("idx") == 5, 4).otherwise(F.col("idx")).alias("idx"), F.lit(0).alias("signal"))

    run = backtest.run(
        backtest.prepare(bars_of(spark, {"A": walk(1, 20)}), 2), jobs_of(spark, [("A", "D", 0, 99, 1, 2, 100)]),
        strategies={"D": FrameStrategy(doubled)},
    )
    assert by_job(run.results())[1]["error_message"] == MISMATCH


def test_packed_tables_outlive_a_session(spark, tmp_path):
    closes = {"A": walk(1, 100)}
    storage.save_packed(backtest.prepare(bars_of(spark, closes), 20), str(tmp_path / "packed"))
    packed = storage.load_packed(spark, str(tmp_path / "packed"))
    got = by_job(backtest.run(packed, jobs_of(spark, [("A", "SMA", 0, 999, 5, 20, 10000)])).results())
    model.assert_result(got[1], model.backtest(closes["A"], 10000, model.signals(closes["A"], 5, 20)))


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        context = types.SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: None)
        conf = types.SimpleNamespace(get=lambda key, default=None: folder)
        return types.SimpleNamespace(conf=conf, sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_folder(session(master))
        assert storage.shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared/barloom-app-1"
