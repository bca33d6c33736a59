from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from barloom.sources import csv_bars, symbol_files
from tests.helpers import bars_of

SERIES = {"A/B": [10000 + i for i in range(30)], "C": [500, 501], "50% +": [700], "C2": [*range(900, 960)]}


def rows(df):
    return sorted(map(tuple, df.select("symbol", "date", *csv_bars.PRICES, "volume").collect()))


def test_round_trip_and_both_readers(spark, tmp_path):
    bars, path = bars_of(spark, SERIES), str(tmp_path / "bars")
    symbol_files.save(bars, path)
    assert rows(symbol_files.load(spark, path)) == rows(bars) == rows(csv_bars.load(spark, path))
    csv_bars.save(bars, str(tmp_path / "plain"))
    assert rows(symbol_files.load(spark, f"file://{tmp_path}/plain")) == rows(bars)
    symbol_files.save(bars_of(spark, {"D": [800]}), path, mode="append")
    assert rows(symbol_files.load(spark, path)) == rows(bars_of(spark, {**SERIES, "D": [800]}))
    symbol_files.save(bars_of(spark, {"D": [800]}), path)
    assert rows(symbol_files.load(spark, path)) == rows(bars_of(spark, {"D": [800]}))


def test_filters_prune_files(spark, tmp_path):
    path = str(tmp_path / "bars")
    symbol_files.save(bars_of(spark, SERIES).coalesce(1), path)
    symbol_files.register(spark)
    raw = spark.read.format("barloom_csv").option("splitBytes", 10_000).load(path)  # one file a task
    assert raw.rdd.getNumPartitions() == 4
    for condition, files in [("symbol = 'C'", 1), ("symbol IN ('C', 'A/B')", 2), ("symbol LIKE 'C%'", 2), ("symbol > 'C'", 4)]:
        kept = raw.filter(condition)
        assert kept.rdd.getNumPartitions() == files, condition
        assert {r["symbol"] for r in kept.collect()} == {s for s in SERIES if eval_like(condition, s)}
    assert raw.filter("symbol = 'none'").count() == 0
    bars = symbol_files.load(spark, path)
    assert rows(bars.filter("symbol = 'C2' AND close > 930")) == rows(bars_of(spark, SERIES).filter("symbol = 'C2' AND close > 930"))


def eval_like(condition, symbol):
    return {"symbol = 'C'": symbol == "C", "symbol IN ('C', 'A/B')": symbol in ("C", "A/B"),
            "symbol LIKE 'C%'": symbol.startswith("C"), "symbol > 'C'": symbol > "C"}[condition]


def test_pushed_filters_are_all_applied():
    reader = symbol_files.Reader("x", None, 1)
    other = [GreaterThan(("symbol",), "B"), EqualTo(("line",), "x")]
    assert list(reader.pushFilters([In(("symbol",), ("AB", "AC", "B")), StringStartsWith(("symbol",), "A"), *other])) == other
    assert [s for s in ("A", "AB", "AC", "B") if reader._keeps(s)] == ["AB", "AC"]


@pytest.mark.parametrize("split", [1, 3, 7, 64, 10_000])
def test_ranges_give_every_line_once(tmp_path, split, monkeypatch):
    monkeypatch.setattr(symbol_files, "CHUNK", 5)
    texts = {"X": b"a\nbb\n\nccc\r\ndddd", "Y": b"\n", "Z": b"", "W": b"\xff\xfe,1\nlong line without an end" + b"." * 40}
    for name, data in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden/V.csv").write_text("no\n")
    (tmp_path / "notes.txt").write_text("no\n")
    reader = symbol_files.Reader(str(tmp_path), None, split)
    got = {s: [] for s in texts}
    for part in reader.partitions():
        for batch in reader.read(part):
            for symbol, line in zip(*(c.to_pylist() for c in batch.columns)):
                got[symbol].append(line)
    assert got == {s: [line.decode("utf-8", "replace") for line in data.splitlines()] for s, data in texts.items()}


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    symbol_files.save(bars_of(spark, SERIES), path)
    lines = spark.createDataFrame([("A", "1"), (None, "2")], "symbol string, line string").coalesce(1)
    with pytest.raises(Exception, match="NULL"):
        lines.write.format("barloom_csv").mode("append").save(path)
    assert rows(symbol_files.load(spark, path)) == rows(bars_of(spark, SERIES))
    assert not [p for p in (tmp_path / "bars").iterdir() if p.name.startswith("_")]


def test_empty_and_explicit_symbol(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("2020-01-02,1,2,0.5,1.5,7\n")
    assert {r["symbol"] for r in symbol_files.load(spark, str(tmp_path / "raw.csv"), "GOOGL").collect()} == {"GOOGL"}
    empty = bars_of(spark, SERIES).filter(F.lit(False))
    symbol_files.save(empty, str(tmp_path / "none"))
    assert symbol_files.load(spark, str(tmp_path / "none")).count() == 0
