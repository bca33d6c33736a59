from __future__ import annotations

import datetime as dt
import json
import random
import uuid

from pyspark.sql import functions as F

from barloom.operators import blocks, liveness
from barloom.plans import backtest
from barloom.storage import shared_folder, written
from barloom.streaming import backtest as stream_results, feed, liveness as stream_live
from tests import model
from tests.helpers import bars_of, by_job, day, jobs_of
from tests.test_backtest import walk


def test_stream_equals_batch(spark):
    series = {"A": walk(1, 120), "B": walk(2, 90)}
    listed = [(s, "SMA", 0, 999, a, b, 10000) for s in series for a, b in [(3, 8), (8, 3)]]
    bars = bars_of(spark, series).select("symbol", "date", "close")
    jobs = written(jobs_of(spark, listed), "jobs")
    cuts = [str(day(40)), str(day(41)), str(day(80))]
    rows = feed.run_in_steps(bars, "date", cuts, lambda s: stream_results.results(s, jobs), "update").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["batch"]):
        last[r["job_id"]] = r
    for k, (symbol, _, _, _, short, long, capital) in enumerate(listed, start=1):
        want = model.backtest(series[symbol], capital, model.signals(series[symbol], short, long))
        model.assert_result({**last[k].asDict(), "success": True}, want)
        assert last[k]["bars"] == len(series[symbol]) and last[k]["late_bars"] == 0


def test_late_bars_are_counted_and_dropped(spark):
    bars = bars_of(spark, {"A": walk(1, 30)}).select("symbol", "date", "close")
    marked = bars.withColumn("part", F.when(F.col("date") == str(day(3)), 1).otherwise(0))
    in_order = marked.withColumn("arrives", F.date_add(F.lit("2000-01-01").cast("date"), F.col("part")))
    jobs = written(jobs_of(spark, [("A", "SMA", 0, 999, 3, 8, 10000)]), "jobs")
    rows = feed.run_in_steps(
        in_order, "arrives", ["2000-01-02"], lambda s: stream_results.results(s, jobs), "update"
    ).collect()
    final = max(rows, key=lambda r: r["batch"])
    assert (final["bars"], final["late_bars"]) == (29, 1)


def test_sessions_end_after_whole_seconds_of_silence(spark):
    base = dt.datetime(2024, 1, 1)
    times = [(1, 0.0), (1, 6.999999), (2, 0.0), (2, 7.0), (9, 3000.0), (9, 6000.0)]
    beats = spark.createDataFrame(
        [(e, base + dt.timedelta(seconds=s)) for e, s in times], "entity long, ts timestamp"
    ).withColumn("day", F.to_date(F.expr("timestampadd(DAY, CAST(unix_timestamp(ts) - unix_timestamp(TIMESTAMP'2024-01-01') AS INT) div 3000, ts)")))
    rows = feed.run_in_steps(
        beats, "day", ["2024-01-02", "2024-01-03"], lambda s: stream_live.sessions(s), "append"
    ).collect()
    found = sorted((r["entity"], r["beats"]) for r in rows if r["entity"] < 9)
    assert found == [(1, 2), (2, 1), (2, 1)]


def test_faulty_jobs_do_not_stop_the_stream(spark):
    """A price of zero at a BUY, an overflow, invalid jobs, and a sound one beside them."""
    fall_and_rise = [1000 - 10 * k for k in range(60)] + [420 + 10 * k for k in range(40)]
    to_zero = [50, 40, 30, 20, 10, 10, 10, 10, 100, 0, 0, 0]
    huge = [5, 4, 3, 2, 1, 1, 2, 3] + [2**55] * 4
    series = {"A": fall_and_rise, "Z": to_zero, "H": huge}
    listed = [
        ("A", "SMA", 0, 999, 3, 8, 10000), ("A", "RSI", 0, 999, 3, 8, 10000), ("A", "SMA", 0, 999, 0, 8, 10000),
        ("A", "SMA", 0, 999, 3, 8, 0), ("H", "SMA", 0, 999, 1, 2, 1e9),
    ]
    bars = bars_of(spark, series).select("symbol", "date", "close")
    jobs = written(jobs_of(spark, listed), "jobs")
    rows = feed.run_in_steps(
        bars, "date", [str(day(7)), str(day(50))], lambda s: stream_results.results(s, jobs), "update"
    ).collect()
    last = {r["job_id"]: r for r in sorted(rows, key=lambda r: r["batch"])}
    want = model.backtest(fall_and_rise, 10000, model.signals(fall_and_rise, 3, 8))
    model.assert_result(last[1].asDict(), want)
    assert last[2]["error_message"] == "Invalid job: unknown strategy RSI"
    assert last[3]["error_message"] == "Invalid job: window must be positive"
    assert last[4]["error_message"] == "Invalid job: capital must be positive"
    assert last[5]["error_message"] == "Invalid job: numeric overflow" and not last[5]["success"]


def test_a_stream_continues_a_batch_run(spark):
    """States of a batch run open the stream; prices in finer units; jobs without a bar end by the timer."""
    series = {"A": walk(1, 120), "B": walk(2, 90)}
    listed = [(s, "SMA", 0, 130, a, b, 10000) for s in series for a, b in [(3, 8), (8, 3), (5, 60)]]
    listed += [("NONE", "SMA", 0, 100, 3, 8, 10000), ("NONE", "SMA", 0, 999, 3, 8, 10000), ("NONE", "RSI", 0, 9, 3, 8, 10000)]
    units = 10_000
    bars = bars_of(spark, {k: [100 * c for c in v] for k, v in series.items()})
    jobs = written(jobs_of(spark, listed), "jobs")
    packed = backtest.prepare(bars, 8)
    batch = backtest.run(packed, backtest.until(jobs, str(day(49))), units=units)
    told = written(stream_results.openings(packed, batch.placed, batch.state()), "openings")
    path = f"{shared_folder(spark)}/told-{uuid.uuid4().hex}"
    told.write.parquet(path)
    rows = feed.run_in_steps(
        bars.filter(F.col("date") > str(day(49))).select("symbol", "date", "close"), "date", [str(day(70)), str(day(101))],
        lambda s: stream_results.results(s, jobs, units, spark.readStream.schema(told.schema).parquet(path)), "update",
    ).collect()
    last = {r["job_id"]: r for r in sorted(rows, key=lambda r: r["batch"])}
    for k, (symbol, strategy, _, end, short, long, capital) in enumerate(listed, start=1):
        if symbol != "NONE":
            want = model.backtest(series[symbol], capital, model.signals(series[symbol], short, long))
            model.assert_result(last[k].asDict(), want)
            assert last[k]["bars"] == len(series[symbol])
    assert last[7]["error_message"] == "No data in date range" and not last[7]["success"]
    assert 8 not in last  # its last date is still to come
    assert last[9]["error_message"] == "Invalid job: unknown strategy RSI"


def test_openings_carry_the_window(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BITS", 4)
    closes = walk(1, 100)
    packed = backtest.prepare(bars_of(spark, {"A": closes}), 3)
    listed = jobs_of(spark, [("A", "SMA", 7, 60, 3, 40, 10000), ("A", "SMA", 55, 60, 3, 40, 10000), ("Z", "SMA", 0, 9, 3, 4, 1)])
    run = backtest.run(packed, listed)
    got = {r["job_id"]: r["opening"] for r in stream_results.openings(packed, run.placed, run.state()).collect()}
    assert json.loads(got[1])["closes"] == closes[21:61] and json.loads(got[2])["closes"] == closes[55:61] and got[3] is None


def test_deaths_are_told_when_they_happen(spark):
    """After every step the entities told dead are those that the batch operator finds at the watermark."""
    rng, base = random.Random(3), dt.datetime(2024, 1, 1)
    beats = []
    for entity in range(12):
        at = 0.0
        while at < 6 * 86400:
            beats.append((entity, base + dt.timedelta(seconds=at)))
            at += rng.choice([600, 3599.9995, 3600.0, 3600.9999995, 3601, 40000, 90000 if entity % 2 else 700])
    frame = spark.createDataFrame(beats, "entity long, ts timestamp").withColumn("day", F.to_date("ts")).repartition(5)
    cuts = [f"2024-01-0{d}" for d in range(2, 7)]
    rows = feed.run_in_steps(frame, "day", cuts, lambda s: stream_live.watch(s, 3600), "append").collect()
    told: dict[int, list] = {}
    for r in rows:
        told.setdefault(r["entity"], []).append((r["ts"], r["event"]))
    ordered = sorted(beats, key=lambda b: b[1])
    for entity in range(12):
        own = [t for e, t in ordered if e == entity]
        end = ordered[-1][1].replace(microsecond=ordered[-1][1].microsecond // 1000 * 1000)
        want = []
        for a, b in zip(own, [*own[1:], None]):
            if ((b or end) - a).total_seconds() >= 3601:
                want.append((a, "dead"))
                if b:
                    want.append((b, "revived"))
        assert sorted(told.get(entity, [])) == sorted(want)
    # step by step: what was told by the end of a step, against the batch operator at that step's watermark
    steps = sorted({r["batch"] for r in rows})
    final = {r["entity"] for r in liveness.dead_entities(frame, F.lit(max(t for _, t in beats)), 3600).collect()}
    state = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event"] == "dead")):
        state[r["entity"]] = r["event"]
    assert {e for e, x in state.items() if x == "dead"} == final and len(steps) >= len(cuts)
