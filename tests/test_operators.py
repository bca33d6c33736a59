from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import metrics
from barloom.operators import bars as barops, blocks, liveness, reports, scan, state, status
from barloom.sources import calendar
from barloom.schemas import BARS
from barloom.storage import written
from tests.helpers import bars_of, day


def five_bars(spark):
    closes = [30050, 30080, 30150, 30200, 30250]
    dates = [dt.date(2020, 1, d) for d in (2, 3, 6, 7, 8)]
    return spark.createDataFrame(
        [("TEST", d, c - 50, c + 100, c - 100, c, 1000) for d, c in zip(dates, closes)], BARS
    )


def test_five_bars(spark):
    bars = five_bars(spark)
    assert barops.bar_count(bars).first()["bars"] == 5
    assert barops.in_range(bars, "2020-01-03", "2020-01-07").count() == 3
    assert barops.mean_close(bars).first()["mean_close"] == pytest.approx(301.46)
    assert barops.volatility(bars).first()["volatility"] > 0
    ranked = blocks.ranked(bars)
    assert barops.find_date(ranked, "2020-01-07").first()["position"] == 3
    assert barops.find_date(ranked, "2020-01-04").first()["position"] == 5
    assert barops.bar_at(ranked, 4).first()["close"] == 30250
    assert barops.bar_at(ranked, 5).count() == 0


def test_validity(spark):
    nan = float("nan")
    rows = [(1.0, 2.0, 0.5, 1.5, 1), (1.0, 0.9, 0.5, 1.5, 1), (1.0, 2.0, 1.2, 1.5, 1), (1.0, 2.0, 0.5, 1.5, -1),
            (1.0, nan, 0.5, 1.5, 1), (nan, 2.0, 0.5, 1.5, 1), (-1.0, -0.5, -2.0, -1.5, 0), (None, 2.0, 0.5, 1.5, 1)]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double, volume long")
    assert sorted(r["open"] for r in barops.valid_bars(df).collect()) == [-1.0, 1.0]


def test_last_of_equal_dates(spark):
    rows = [("A", day(0), 1, 9, 1, 5, 1), ("A", day(0), 2, 9, 1, 4, 1), ("A", day(1), 1, 9, 1, 7, 1)]
    bars = spark.createDataFrame(rows, BARS)
    assert {(r["date"], r["close"]) for r in barops.last_per_date(bars).collect()} == {(day(0), 4), (day(1), 7)}
    index = {r["date"]: r["idx"] for r in barops.date_index(blocks.ranked(bars)).collect()}
    assert index == {day(0): 1, day(1): 2}


def test_running_and_previous_cross_block_borders(spark):
    rows = [("k", i // 7, i, (i * 37) % 11 - 5) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, block int, i int, v long")
    got = scan.running(df, ["key"], "block", ["i"], {
        "n": ("count", F.lit(1)), "total": ("sum", F.col("v")), "top": ("max", F.col("v"))})
    total, top = 0, -99
    for k, r in enumerate(got.orderBy("i").collect()):
        total, top = total + rows[k][3], max(top, rows[k][3])
        assert (r["n"], r["total"], r["top"]) == (k + 1, total, top)
    prev = [r["p"] for r in scan.previous(df, ["key"], "block", "i", "v", "p").orderBy("i").collect()]
    assert prev == [None] + [r[3] for r in rows[:-1]]


def test_sharpe_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.1), (2, 0.1), (3, 0.1), (3, 0.3)], "g int, r double")
    got = {r["g"]: r["s"] for r in df.groupBy("g").agg(metrics.sharpe_of(F.col("r")).alias("s")).collect()}
    assert got[1] == 0.0 and got[2] == 0.0
    assert got[3] == pytest.approx(2 * math.sqrt(252))
    shifted = df.filter("g = 3").agg(metrics.sharpe_of(F.col("r"), 0.1).alias("s")).first()["s"]
    assert shifted == pytest.approx(math.sqrt(252))


def test_silence_counts_whole_seconds(spark):
    base = dt.datetime(2024, 1, 1)
    beats = spark.createDataFrame(
        [(k, base + dt.timedelta(seconds=s)) for k, s in [(1, 0.0), (2, 0.0), (1, 6.999), (2, 7.0)]],
        "entity long, ts timestamp",
    )
    assert [r["entity"] for r in liveness.gaps(beats).collect()] == [2]
    dead = liveness.dead_entities(beats, F.lit(base + dt.timedelta(seconds=13.998)))
    assert [r["entity"] for r in dead.collect()] == []
    dead = liveness.dead_entities(beats, F.lit(base + dt.timedelta(seconds=13.999)))
    assert [r["entity"] for r in dead.collect()] == [1]


def test_ledger(spark):
    ledger = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None), (5, 8)], "job_id long, entity long")
    dead = spark.createDataFrame([(7,)], "entity long")
    answered = spark.createDataFrame([(1, True), (5, False)], "job_id long, success boolean")
    assert [r["job_id"] for r in liveness.orphaned(ledger, dead, answered).collect()] == [2]
    beats = spark.createDataFrame([(7,), (8,), (8,), (9,)], "entity long")
    counts = liveness.ledger_counts(liveness.ledger_status(ledger, dead, answered), beats, dead).first().asDict()
    assert counts == {"active_entities": 2, "pending": 2, "active": 1, "completed": 1, "failed": 1}


def test_scalability_truncates(spark):
    runs = spark.createDataFrame(
        [("e", 1, 20, "4.006"), ("e", 2, 20, "4.007"), ("e", 4, 20, "4.006"), ("x", 2, 0, "1.0")],
        "run string, num_workers int, jobs_completed long, t string",
    ).withColumn("total_time_sec", F.col("t").cast("decimal(18,3)"))
    got = {(r["run"], r["num_workers"]): r for r in reports.scalability(runs).collect()}
    assert (float(got["e", 1]["speedup"]), float(got["e", 1]["efficiency"])) == (1.0, 100.0)
    assert (float(got["e", 2]["speedup"]), float(got["e", 2]["efficiency"])) == (0.99, 49.0)
    assert (float(got["e", 4]["speedup"]), float(got["e", 4]["efficiency"])) == (1.0, 25.0)
    assert float(got["e", 2]["throughput"]) == 4.9912
    assert got["x", 2]["speedup"] is None and got["x", 2]["avg_job_time"] is None


def test_run_summary_rate(spark):
    results = spark.createDataFrame([(True,), (False,), (True,)], "success boolean")
    row = status.run_summary(results, 2.9).first()
    assert (row["submitted"], row["successful"], row["failed"], row["jobs_per_second"]) == (3, 2, 1, 1.5)
    assert status.run_summary(results, 0.4).first()["jobs_per_second"] is None


def test_calendar_and_price_path(spark):
    one = spark.createDataFrame([("A",)], "symbol string").select(
        "symbol", F.lit("2020-01-01").cast("date").alias("a"), F.lit("2024-12-31").cast("date").alias("b"))
    assert calendar.trading_days(one, F.col("a"), F.col("b")).count() == 1305
    rows = [("A", i // 4, i, [0.1, -0.05, 0.02][i % 3]) for i in range(10)]
    path = calendar.price_path(
        spark.createDataFrame(rows, "symbol string, block int, i int, r double"), "symbol", "block", ["i"], 100.0)
    price = 100.0
    for r in path.orderBy("i").collect():
        price *= 1 + r["r"]
        assert r["price"] == pytest.approx(price)


def test_snapshots(spark):
    rows = [(12345, "AAPL", 250, True), (12345, "AAPL", 500, True), (12345, "AAPL", 600, False), (1001, "X", 10, True)]
    shots = written(spark.createDataFrame(rows, "job_id long, symbol string, bars_processed long, valid boolean"), "s")
    assert {r["job_id"]: r["bars_processed"] for r in state.latest(shots).collect()} == {12345: 500, 1001: 10}
    jobs = spark.createDataFrame([(12345,), (7,)], "job_id long")
    assert [r["job_id"] for r in state.existing(jobs, shots).collect()] == [12345]
    left = state.without(shots, jobs)
    assert [r["job_id"] for r in state.open_jobs(left).collect()] == [1001]
