"""Backtests on a stream of bars: keyed state per job, one result row per job and micro-batch."""

from __future__ import annotations

import datetime as dt
import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.kernels import larger, prefix
from barloom.functions.metrics import MIN_DEVIATION, PERIODS_PER_YEAR
from barloom.operators.jobs import cells, invalid_reason
from barloom.schemas import BAR_ORDER, MINOR_UNITS

OUTPUT = (
    "job_id long, symbol string, bars long, total_return double, sharpe_ratio double, max_drawdown double, "
    "final_value double, num_trades int, winning int, losing int, late_bars long, success boolean, error_message string"
)
_STATE_FIELDS = [
    ("bars", "long"), ("last_date", "date"), ("closes", "array<long>"), ("direction", "int"),
    ("cash", "long"), ("shares", "long"), ("bought", "long"), ("trades", "int"), ("wins", "int"),
    ("losses", "int"), ("equity", "long"), ("n", "long"), ("mean", "double"), ("m2", "double"),
    ("peak", "long"), ("drawdown", "double"), ("late", "long"), ("fault", "string"), ("symbol", "string"),
]
STATE = ", ".join(f"{name} {kind}" for name, kind in _STATE_FIELDS)


def _signals(s: dict, closes: np.ndarray, short: int, long: int) -> np.ndarray:
    """BUY, SELL or HOLD of the new bars, by prefix sums over them and the closes kept."""
    known = np.concatenate([np.array(s["closes"], np.int64), closes])
    sums = prefix(known)
    upto = np.arange(len(known) - len(closes), len(known)) + 1
    position = s["bars"] + np.arange(len(closes))
    full = (position >= long) & (position >= short - 1)
    short_sum = np.where(full, sums[upto] - sums[np.maximum(upto - short, 0)], 0)
    long_sum = np.where(full, sums[upto] - sums[np.maximum(upto - long, 0)], 0)
    state = np.where(larger(short_sum, long, long_sum, short), 1, -1)
    state[~((short_sum > 0) & (long_sum > 0)).astype(bool)] = 0
    # the last state that was known before each bar
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    before = np.concatenate(([-1], at[:-1]))
    known_before = np.where(before >= 0, state[np.maximum(before, 0)], s["direction"])
    if len(at) and at[-1] >= 0:
        s["direction"] = int(state[at[-1]])
    s["closes"] = known[-max(short, long):].tolist()
    return np.where((state != 0) & (position > long) & (state != known_before), state, 0)


def advance(s: dict, closes: np.ndarray, short: int, long: int) -> None:
    """Let bars act on the state of a job. Only trades are taken one by one."""
    signals = _signals(s, closes, short, long)
    cash, shares = np.empty(len(closes), object), np.empty(len(closes), object)
    bound, begin = 0, 0  # of what any bar of this stretch can be worth
    for k in [*np.flatnonzero(signals).tolist(), len(closes)]:
        cash[begin:k], shares[begin:k] = s["cash"], s["shares"]
        bound = max(bound, abs(s["cash"]) + s["shares"] * max(int(closes.max()), -int(closes.min())))
        begin = k
        if k == len(closes):
            break
        close = int(closes[k])
        if signals[k] == 1 and s["shares"] == 0:
            if close <= 0:
                s["fault"] = "Invalid job: price at BUY must be positive"
                return
            if close <= s["cash"]:
                s["shares"] = s["cash"] // close
                s["bought"] = s["shares"] * close
                s["cash"] -= s["bought"]
                s["trades"] += 1
        elif signals[k] == -1 and s["shares"] > 0:
            value = s["shares"] * close
            s["wins" if value > s["bought"] else "losses"] += 1
            s["cash"], s["shares"] = s["cash"] + value, 0
            s["trades"] += 1
    if bound < 2**62:
        exact = cash.astype(np.int64) + shares.astype(np.int64) * closes
    else:
        exact = cash + shares * closes.astype(object)  # Python's integers do not overflow
    if bound >= 2**62 and max(map(abs, [*exact, s["cash"]])) >= 2**63:
        s["fault"] = "Invalid job: numeric overflow"
        s.update(cash=0, shares=0, bought=0)
        return
    value = exact.astype(float)
    if len(value) and value.min() < 0:
        s["fault"] = "Invalid job: negative equity"
    before = np.concatenate(([float(s["equity"])], value[:-1]))
    counted = (before > 0) & (s["bars"] + np.arange(len(value)) > 0)
    returns = (value[counted] - before[counted]) / before[counted]
    if len(returns):
        n, mean = len(returns), float(returns.mean())
        total, delta = s["n"] + n, mean - s["mean"]
        s["m2"] += float(((returns - mean) ** 2).sum()) + delta * delta * s["n"] * n / total
        s["mean"] += delta * n / total
        s["n"] = total
    peak = np.maximum.accumulate(np.maximum(value, float(s["peak"])))
    s["drawdown"] = max(s["drawdown"], float(((peak - value) / peak).max()))
    s["peak"], s["equity"] = max(s["peak"], int(exact.max())), int(exact[-1])
    s["bars"] += len(closes)


def _fresh(capital: int) -> dict:
    start = dict.fromkeys([name for name, _ in _STATE_FIELDS], 0)
    start.update(last_date=None, closes=[], direction=-1, cash=capital, equity=capital, peak=capital,
                 mean=0.0, m2=0.0, drawdown=0.0, fault=None)
    return start


def _update(units: int, timed: bool, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [name for name, _ in _STATE_FIELDS]
    row = {
        "job_id": key[0], "symbol": None, "bars": 0, "total_return": 0.0, "sharpe_ratio": 0.0,
        "max_drawdown": 0.0, "final_value": 0.0, "num_trades": 0, "winning": 0, "losing": 0, "late_bars": 0,
        "success": False, "error_message": None,
    }
    if state.hasTimedOut:  # the watermark is behind the last date, and no bar has come
        row.update(symbol=dict(zip(names, state.get))["symbol"], error_message="No data in date range")
        state.remove()
        yield pd.DataFrame([row])
        return
    new = pd.concat(list(batches))
    job = new.iloc[0]
    row.update(symbol=job.symbol, error_message=job.invalid)
    if job.invalid is not None:  # no state for a job that cannot run
        yield pd.DataFrame([row])
        return
    capital = int(job.capital)
    s = dict(zip(names, state.get)) if state.exists else {**_fresh(capital), "symbol": job.symbol}
    s["closes"] = list(s["closes"])
    if timed:
        for text in new.opening[new.date.isna()].dropna():
            opened = json.loads(text)
            s.update(opened, last_date=dt.date.fromisoformat(opened["last_date"]))
        new = new[new.date.notna()]
    new = new.sort_values([c for c in BAR_ORDER if c in new.columns], kind="stable")
    if s["last_date"] is not None:
        late = (new.date <= s["last_date"]).to_numpy()
        s["late"] += int(late.sum())
        new = new[~late]
    if len(new):
        s["last_date"] = new.date.iloc[-1]
        if s["fault"] is None:
            advance(s, new.close.to_numpy(np.int64), int(job.short_window), int(job.long_window))
    if s["fault"] is not None or (s["last_date"] is not None and s["last_date"] >= job.end_date):
        s["closes"] = []  # no bar to come needs them
    state.update(tuple(s[name] for name in names))
    if timed and s["last_date"] is None:
        over = dt.datetime.combine(job.end_date + dt.timedelta(days=1), dt.time(), dt.timezone.utc)
        state.setTimeoutTimestamp(max(int(over.timestamp() * 1000) - 1, state.getCurrentWatermarkMs() + 1))
        return  # nothing to tell yet
    row.update(bars=s["bars"], late_bars=s["late"], success=s["fault"] is None, error_message=s["fault"])
    if s["fault"] is None:
        deviation = math.sqrt(s["m2"] / s["n"]) if s["n"] else 0.0
        steady = s["n"] < 2 or deviation < MIN_DEVIATION
        row.update(
            total_return=(s["equity"] - capital) / capital * 100.0,
            sharpe_ratio=0.0 if steady else s["mean"] / deviation * math.sqrt(PERIODS_PER_YEAR),
            max_drawdown=s["drawdown"] * 100.0, final_value=s["equity"] / units,
            num_trades=s["trades"], winning=s["wins"], losing=s["losses"],
        )
    yield pd.DataFrame([row])


def openings(packed: DataFrame, placed: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """(job_id, opening): what announces each job to a stream; with the `state()` of a batch run, where that ended.

    `placed` are the jobs of that run. A job without a state opens with nothing. The closes its windows
    still need come from the blocks they lie in, as many as the state of a stream holds anyway.
    """
    if saved is None:
        return placed.select("job_id", F.lit(None).cast("string").alias("opening"))
    usable = placed.filter(F.col("i0").isNotNull() & F.col("invalid").isNull()).select(
        "job_id", F.col("symbol").alias("__symbol"), "i0", F.greatest("short_window", "long_window").cast("long").alias("reach")
    )
    at = saved.filter("valid").join(usable, "job_id").withColumn("upto", F.col("i0") + F.col("bars_processed") - 1)
    at = at.withColumn("from", F.greatest(F.col("i0"), F.col("upto") - F.col("reach") + 1))
    asked = cells(at.select("job_id", F.col("__symbol").alias("symbol"), "from", "upto"), "from", "upto")
    low = F.greatest("own_from", "from") - F.col("first_idx")
    some = F.slice("closes", (low + 1).cast("int"), (F.least("own_to", "upto") - F.col("first_idx") - low + 1).cast("int"))
    closes = (
        asked.join(packed.select("symbol", "iblock", "own_from", "own_to", "first_idx", "closes"), ["symbol", "iblock"])
        .groupBy("job_id")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("iblock", some.alias("some")))), lambda x: x["some"])).alias("closes"))
    )
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    fields = {
        "bars": long("bars_processed"), "last_date": F.col("last_date").cast("string"), "closes": F.col("closes"),
        "direction": F.coalesce("saved_dir", F.lit(-1)), "cash": F.col("cash"), "shares": F.col("shares"),
        "bought": long("last_buy_value"), "trades": long("num_trades"), "wins": long("winning"), "losses": long("losing"),
        "equity": long("saved_value"), "n": long("saved_n"), "mean": F.coalesce("saved_mean", F.lit(0.0)),
        "m2": F.coalesce("saved_m2", F.lit(0.0)), "peak": long("saved_peak"), "drawdown": F.coalesce("saved_drawdown", F.lit(0.0)),
    }
    opened = at.join(closes, "job_id").select("job_id", F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("opening"))
    return placed.select("job_id").join(opened, "job_id", "left")


def results(
    bars_stream: DataFrame, jobs: DataFrame, units: int = MINOR_UNITS, announced: DataFrame | None = None, lateness: str = "0 seconds"
) -> DataFrame:
    """Streaming results: a row for every job that received bars in the micro-batch.

    Jobs are validated as in a batch sweep; faulty ones answer with their message. Bars of a micro-batch
    are taken in the order of a batch sweep, so its size bounds what a job holds besides its state, whose size its
    longest window bounds; behind the last date of the job the window is dropped. A bar not later than the last
    one seen in an earlier micro-batch is late: it is counted and left out.

    `announced` is a stream of `openings`. Announced jobs start from the state they bring, and one whose last date the
    watermark (`lateness` behind the latest bar) passes without a bar answers "No data in date range". Spark then
    leaves out bars behind the watermark uncounted.
    """
    columns = ["symbol", *[c for c in BAR_ORDER if c in bars_stream.columns]]
    judged = jobs.withColumn("invalid", invalid_reason(["SMA"], units)).withColumn(
        "capital", F.coalesce(F.round(F.col("initial_capital") * units).try_cast("bigint"), F.lit(0).cast("bigint"))
    )
    about = ["short_window", "long_window", "capital", "end_date", "invalid"]
    feed = bars_stream.select(*columns).join(judged, "symbol").filter(
        F.col("date").between(F.col("start_date"), F.col("end_date"))
    )
    update = functools.partial(_update, units, announced is not None)
    timeout = GroupStateTimeout.NoTimeout
    rows = feed.select("job_id", *columns, *about)
    if announced is not None:
        timeout = GroupStateTimeout.EventTimeTimeout
        kinds = dict(bars_stream.dtypes)
        # no NULL in number columns, which pandas would turn into doubles
        none = [F.lit(None if c == "date" else 0).cast(kinds[c]).alias(c) for c in columns if c != "symbol"]
        at = lambda c: F.timestamp_seconds(F.unix_date(c) * 86400).alias("at")
        told = announced.join(judged, "job_id").select(
            "job_id", "symbol", *none, *about, "opening", at("start_date")
        )
        rows = rows.select("*", F.lit(None).cast("string").alias("opening"), at("date"))
        rows = rows.unionByName(told).withWatermark("at", lateness)
    return rows.groupBy("job_id").applyInPandasWithState(update, OUTPUT, STATE, "update", timeout)
