from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from barloom.plans import backtest
from barloom.schemas import JOBS
from barloom.sources import csv_bars, jobs_csv, sinks
from barloom.storage import written
from tests.helpers import bars_of, by_job, jobs_of

GOOD = "2020-01-02,300.00,301.00,299.00,300.50,1000000"


def write(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows) + "\n")


def test_dirty_file(spark, tmp_path):
    write(
        tmp_path, "AAPL.csv", "DATE,Open,High,Low,Close,Volume", GOOD, "", "   ",
        " 2020-01-03 ,\t300.00, 301.00,299.00,300.80 , 5\r", "2020-01-06,1,2,0.5,1.5", "2020-01-07,1,2,0.5,1.5,7,extra",
        "2020-01-08,abc,2,0.5,1.5,7", "2020-01-09,1,2,0.5,nan,7", "2020-01-10,12abc,13,11,12,7",
        "2020-01-13,1,2,0.5,1.5,-1", "2020-01-14,1,0.5,2,1.5,1", "2020-2-30,1,2,0.5,1.5,1",
    )
    typed = csv_bars.parsed(csv_bars.lines(spark, str(tmp_path)))
    good = {r["date"]: r for r in csv_bars.bars(typed).collect()}
    assert sorted(good) == [dt.date(2020, 1, 2), dt.date(2020, 1, 3), dt.date(2020, 1, 7)]
    assert good[dt.date(2020, 1, 3)]["close"] == 30080 and good[dt.date(2020, 1, 3)]["volume"] == 5
    assert good[dt.date(2020, 1, 7)]["symbol"] == "AAPL"
    reasons = sorted(r["reason"] for r in csv_bars.quarantine(typed).collect())
    assert reasons == ["insufficient columns"] + ["invalid bar"] * 3 + ["unparseable value"] * 3
    lenient = csv_bars.load(spark, str(tmp_path), lenient=True)
    assert lenient.filter("date = '2020-01-10'").first()["open"] == 1200


def test_file_without_header_and_explicit_symbol(spark, tmp_path):
    write(tmp_path, "raw.csv", GOOD, GOOD.replace("01-02", "01-03"))
    assert csv_bars.load(spark, str(tmp_path)).count() == 2
    assert {r["symbol"] for r in csv_bars.load(spark, str(tmp_path / "raw.csv"), "GOOGL").collect()} == {"GOOGL"}


def test_text_dates_order_as_text(spark, tmp_path):
    """Unpadded dates: as text the closed range keeps 30 of 100 bars, and no signal arises."""
    rows = [
        f"2020-{i // 30 + 1}-{i % 30 + 1},{150 + 0.5 * i:.2f},{151 + 0.5 * i:.2f},{149 + 0.5 * i:.2f},{150.5 + 0.5 * i:.2f},1000"
        for i in range(100)
    ]
    write(tmp_path, "AAPL.csv", "Date,Open,High,Low,Close,Volume", *rows)
    bars = csv_bars.load(spark, str(tmp_path), dates_as_text=True)
    jobs = jobs_of(spark, [("AAPL", "SMA", 0, 0, 10, 20, 10000)]).withColumn(
        "start_date", F.lit("2020-01-01")).withColumn("end_date", F.lit("2020-12-31"))
    run = backtest.run(backtest.prepare(bars, 20), jobs)
    row = by_job(run.results())[1]
    span = run.spans.first()
    assert row["success"] and row["num_trades"] == 0 and row["total_return"] == 0.0
    assert span["i1"] - span["i0"] + 1 == 30


def test_missing_and_empty_files(spark, tmp_path):
    write(tmp_path, "AAPL.csv", *[GOOD.replace("01-02", f"01-{d:02d}") for d in range(2, 9)])
    write(tmp_path, "EMPTY.csv", "Date,Open,High,Low,Close,Volume", "rubbish")
    bars = csv_bars.load(spark, str(tmp_path))
    rows = [(k, s, "SMA", dt.date(2020, 1, a), dt.date(2020, 1, b), 2, 3, c) for k, (s, a, b, c) in enumerate(
        [("AAPL", 1, 31, 1e4), ("EMPTY", 1, 31, 1e4), ("NONE", 1, 31, 1e4), ("AAPL", 20, 31, 1e4), ("AAPL", 1, 31, -1.0)], 1)]
    jobs = spark.createDataFrame(rows, JOBS)
    run = backtest.run(backtest.prepare(bars, 3), jobs, files=csv_bars.files(spark, str(tmp_path)), folder="data")
    got = {k: r["error_message"] for k, r in by_job(run.results()).items()}
    assert got == {
        1: None,
        2: "Exception: No valid data loaded from data/EMPTY.csv",
        3: "Exception: Failed to open file: data/NONE.csv",
        4: "No data in date range",
        5: "Invalid job: capital must be positive",
    }


def test_job_list(spark, tmp_path):
    write(
        tmp_path, "jobs.csv", "symbol,strategy,start_date,end_date,short_window,long_window,initial_capital",
        "AAPL,SMA,2020-01-01,2024-12-31,20,50,10000", "short,line", "MSFT,SMA,2022-01-01,2024-12-31,10,30,500.5,extra",
        "TSLA,SMA,2022-01-01,2024-12-31,ten,30,500",
    )
    got = by_job(jobs_csv.load(spark, str(tmp_path)))
    assert [got[k]["symbol"] for k in (1, 2, 3)] == ["AAPL", "MSFT", "TSLA"]
    assert got[2]["initial_capital"] == 500.5 and got[2]["start_date"] == dt.date(2022, 1, 1)
    assert got[3]["short_window"] is None


def test_saved_bars_and_results_read_back(spark, tmp_path):
    bars = bars_of(spark, {"A/B": [10000 + i for i in range(30)], "C": [500, 501]})
    csv_bars.save(bars, str(tmp_path / "bars"))
    again = csv_bars.load(spark, str(tmp_path / "bars"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, bars.collect()))
    jobs = jobs_of(spark, [("C", "SMA", 0, 9, 1, 2, 100), ("D", "SMA", 0, 9, 1, 2, 100)])
    results = written(backtest.run(backtest.prepare(bars, 2), jobs).results(), "results")
    sinks.write_results(results, str(tmp_path / "out"), 2.5)
    back = spark.read.option("header", True).csv(str(tmp_path / "out/results"))
    assert back.columns == results.columns and back.count() == 2
    summary = json.loads(spark.read.text(str(tmp_path / "out/summary")).first()[0])
    assert (summary["submitted"], summary["successful"], summary["failed"]) == (2, 1, 1)
    assert summary["jobs_per_second"] == 1.0


def test_four_rising_symbols_with_text_dates(spark, tmp_path):
    """Golden: 4 symbols of 200 rising bars with unpadded dates, windows 10/20: success, no trade, no return."""
    names = ["AAPL", "GOOGL", "MSFT", "AMZN"]
    for name in names:
        rows = [
            f"2024-{i // 30 + 1}-{i % 30 + 1},{200 + 0.2 * i:.1f},{201 + 0.2 * i:.1f},{199 + 0.2 * i:.1f},{200.5 + 0.2 * i:.1f},1000"
            for i in range(200)
        ]
        write(tmp_path, f"{name}.csv", "Date,Open,High,Low,Close,Volume", *rows)
    bars = csv_bars.load(spark, str(tmp_path), dates_as_text=True)
    jobs = jobs_of(spark, [(name, "SMA", 0, 0, 10, 20, 10000) for name in names]).withColumn(
        "start_date", F.lit("2024-01-01")).withColumn("end_date", F.lit("2024-12-31"))
    got = by_job(backtest.run(backtest.prepare(bars, 20), jobs).results())
    assert len(got) == 4
    for row in got.values():
        assert row["success"] and row["num_trades"] == 0
        assert (row["total_return"], row["sharpe_ratio"], row["max_drawdown"]) == (0.0, 0.0, 0.0)
