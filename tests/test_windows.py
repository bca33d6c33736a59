"""Windows of any length, sums of any size, ranges and numbers without a single task that sees all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import kernels
from barloom.operators import blocks, crossover, jobs as joblist, scan
from barloom.plans import backtest
from tests import model
from tests.helpers import bars_of, by_job, day, jobs_of
from tests.test_backtest import walk

HUGE = 2**31 - 1


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BITS", 4)
    monkeypatch.setattr(blocks, "BLOCK_DAYS", 8)
    monkeypatch.setattr(blocks, "GROUP_BITS", 2)
    monkeypatch.setattr(joblist, "JOBS_PER_CELL", 2)


def windows_of(n: int) -> list[tuple[int, int]]:
    return [(1, 2), (3, 8), (16, 17), (15, 33), (40, 100), (150, 90), (2, n - 1), (n - 1, 2), (2, n), (n + 1, 3), (5, HUGE), (HUGE, 5)]


def test_every_window_over_small_blocks(spark, small):
    closes = {"A": walk(7, 300), "B": walk(8, 47)}
    jobs = [(s, "SMA", a, 999, *w, 10000) for s in closes for a in (0, 21) for w in windows_of(len(closes[s]) - a)]
    run = backtest.run(backtest.prepare(bars_of(spark, closes), 4), jobs_of(spark, jobs))
    got = by_job(run.results())
    rows = {(r["job_id"], r["pos"]): r for r in run.signals().collect()}
    for k, (symbol, _, a, _, short, long, capital) in enumerate(jobs, start=1):
        series = closes[symbol][a:]
        made = model.signals(series, short, long)
        model.assert_result(got[k], model.backtest(series, capital, made))
        for i in range(len(series)):
            row = rows[k, i]
            assert row["close"] == series[i] and row["signal"] == made[i]
            for name, w in (("short_avg", short), ("long_avg", long)):
                assert row[name] == (None if i < w - 1 else sum(series[i - w + 1 : i + 1]) / w)


def test_whole_series_averages(spark, small):
    closes = {"A": walk(7, 130), "B": walk(8, 5)}
    packed = backtest.prepare(bars_of(spark, closes), 4)
    for short, long in [(2, 4), (3, 70), (7, HUGE)]:
        got = {(r["symbol"], r["idx"]): (r["short_avg"], r["long_avg"]) for r in crossover.averages(packed, short, long).collect()}
        for symbol, series in closes.items():
            for i in range(len(series)):
                want = tuple(None if i < w - 1 else sum(series[i - w + 1 : i + 1]) / w for w in (short, long))
                assert got[symbol, i] == want


def test_resumed_long_windows(spark, small):
    closes = {"A": walk(3, 200)}
    jobs = [("A", "SMA", 0, 999, 5, 60, 10000), ("A", "SMA", 0, 999, 90, 10, 10000)]
    packed, listed = backtest.prepare(bars_of(spark, closes), 3), jobs_of(spark, jobs)
    state = backtest.run(packed, backtest.until(listed, str(day(111)))).state()
    got = by_job(backtest.run(packed, listed, state).results())
    for k, (_, _, _, _, short, long, capital) in enumerate(jobs, start=1):
        model.assert_result(got[k], model.backtest(closes["A"], capital, model.signals(closes["A"], short, long)))


def test_a_long_window_costs_no_rows(spark, small):
    """What is packed is the same, and a window that is never full asks for no block."""
    bars = bars_of(spark, {"A": walk(7, 300)})
    assert backtest.prepare(bars, HUGE - 1).count() == backtest.prepare(bars, 16).count() == 19
    packed = backtest.prepare(bars, 8)
    never = backtest.locate(packed, jobs_of(spark, [("A", "SMA", 0, 999, 5, 10**9, 1), ("A", "SMA", 0, 50, 5, 200, 1)]))[1]
    assert crossover.pieces(packed, never) is None
    some = backtest.locate(packed, jobs_of(spark, [("A", "SMA", 0, 999, 5, 10**9, 1), ("A", "SMA", 0, 999, 5, 100, 1)]))[1]
    found = crossover.pieces(packed, some).select(F.explode("pieces").alias("p"))
    assert {r[0] for r in found.select("p.window").collect()} == {100}
    assert found.count() <= 2 * 19


def test_sums_beyond_what_a_bigint_holds(spark, small):
    """Prices of 5 * 10^18 beside cheap ones: nothing aborts, and ties stay ties."""
    rng = random.Random(4)
    high = [5 * 10**18 + rng.randint(-3, 3) for _ in range(120)]
    closes = {"HIGH": high, "FLAT": [5 * 10**18 + 1] * 60, "LOW": walk(1, 120)}
    bars = bars_of(spark, closes).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    jobs = [(s, "SMA", 0, 999, *w, 6e16) for s in closes for w in ((3, 8), (2, 60), (30, 7))]
    run = backtest.run(backtest.prepare(bars, 6), jobs_of(spark, jobs))
    got = {}
    for r in run.actions.collect():
        got.setdefault(r["job_id"], {})[r["idx"]] = r["signal"]
    for k, (symbol, _, _, _, short, long, _) in enumerate(jobs, start=1):
        made = model.signals(closes[symbol], short, long)
        assert got.get(k, {}) == {i: s for i, s in enumerate(made) if s}
        if symbol == "FLAT":
            assert not any(made)
    results = by_job(run.results())
    for k, (symbol, _, _, _, short, long, capital) in enumerate(jobs, start=1):
        want = model.backtest(closes[symbol], capital, model.signals(closes[symbol], short, long))
        row = results[k]
        if max(want["curve"]) < 2**63:
            assert row["success"] and row["num_trades"] == want["num_trades"]
            assert row["final_value"] == pytest.approx(want["final_value"])


def test_prefix_sums_switch_to_whole_numbers_of_any_size():
    small = np.array([1, -5, 7], np.int64)
    assert kernels.prefix(small).dtype == np.int64 and kernels.prefix(small).tolist() == [0, 1, -4, 3]
    large = np.array([-(2**63), 2**63 - 1, 2**62], np.int64)
    assert kernels.prefix(large).tolist() == [0, -(2**63), -1, 2**62 - 1]
    assert kernels.larger(large, 3, np.array([0, 2**63 - 1, 2**62 - 1]), 3).tolist() == [False, False, True]


def test_the_directory_is_the_exact_sum_before_each_block(spark, small):
    closes = [2**62 + i for i in range(200)]
    packed = backtest.prepare(bars_of(spark, {"A": closes}).withColumn("open", F.col("close")), 5)
    for r in blocks.directory(packed).collect():
        assert int(r["before"]) == sum(closes[: r["iblock"] * 16])


# ---- ranges --------------------------------------------------------------------------------------


def test_ranges_take_their_positions_from_the_merge(spark, small):
    rng = random.Random(2)
    series = {"A": walk(1, 333), "B": walk(2, 16), "C": walk(3, 1)}
    packed = backtest.prepare(bars_of(spark, series, step=2), 5)
    jobs = []
    for symbol in [*series, "NONE"]:
        for _ in range(60):
            a = rng.randint(-20, 700)
            jobs.append((symbol, "SMA", a, a + rng.choice([-3, 0, 1, 5, 40, 900]), 2, 3, 1000))
    placed = joblist.place(packed, jobs_of(spark, jobs), ["SMA"])
    for r in placed.collect():
        symbol, _, a, b, *_ = jobs[r["job_id"] - 1]
        there = [i for i in range(len(series.get(symbol, []))) if a <= 2 * i <= b]
        want = (there[0], there[-1], day(2 * there[-1])) if there else (None, None, None)
        assert (r["i0"], r["i1"], r["last_date"]) == want


def test_many_bars_on_one_date_are_cut_by_the_merge(spark, small):
    bars = bars_of(spark, {"A": list(range(100, 300))}).withColumn("date", F.expr("date_add('2000-01-01', cast(close / 60 as int))"))
    packed = backtest.prepare(bars, 5)
    jobs = jobs_of(spark, [("A", "SMA", a, b, 2, 3, 1000) for a in range(7) for b in range(7)])
    for r in joblist.place(packed, jobs, ["SMA"]).collect():
        a, b = divmod(r["job_id"] - 1, 7)
        there = [i for i in range(200) if a <= (100 + i) // 60 <= b]
        assert (r["i0"], r["i1"]) == ((there[0], there[-1]) if there else (None, None))


def test_ranges_without_a_date_or_symbol_cover_nothing(spark):
    packed = backtest.prepare(bars_of(spark, {"A": walk(1, 30)}), 5)
    jobs = jobs_of(spark, [("A", "SMA", 0, 9, 2, 3, 1000)] * 4)
    jobs = jobs.withColumn("start_date", F.when(F.col("job_id") != 1, F.col("start_date"))).withColumn(
        "end_date", F.when(F.col("job_id") != 2, F.col("end_date"))
    ).withColumn("symbol", F.when(F.col("job_id") != 3, F.col("symbol")))
    assert {r["job_id"]: r["i1"] for r in joblist.place(packed, jobs, ["SMA"]).collect()} == {1: None, 2: None, 3: None, 4: 9}


@pytest.fixture
def fine_parts(spark):
    """Partitions that adaptive execution may not put together again."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_symbol_with_all_blocks_and_ranges_spreads_over_parts(spark, fine_parts):
    thin = spark.range(20000).select(F.lit("HOT").alias("symbol"), F.col("id").alias("iblock"), F.expr("date_add('1900-01-01', cast(id as int))").alias("first_date"))
    ends = spark.range(4000).select(F.lit("HOT").alias("symbol"), F.expr("date_add('1900-01-01', cast(id * 5 as int))").alias("first_date"))
    events = scan.dealt(thin.unionByName(ends, allowMissingColumns=True), ["symbol", "first_date", "iblock"], "events")
    sizes = [r["count"] for r in events.groupBy("__part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 24000 / 8
    merged = scan.running(events, ["symbol"], "__part", ["__at"], {"cut": ("max", F.col("iblock"))})
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert merged.filter("iblock IS NULL AND cut <> datediff(first_date, DATE '1900-01-01') - 1").count() == 0


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_numbers_follow_the_order_without_a_single_task(spark, fine_parts, rows):
    df = spark.range(rows).select(F.pmod(F.col("id") * 7919, F.lit(10007)).alias("a"), (F.col("id") % 3).alias("b")).repartition(7)
    made = scan.numbered(df, ["b", "a"], "n")
    got = [(r["b"], r["a"], r["n"]) for r in made.collect()]
    assert sorted(got, key=lambda r: r[2]) == [(*key, k) for k, key in enumerate(sorted((b, a) for b, a, _ in got), 1)]
    assert len(got) == rows
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
