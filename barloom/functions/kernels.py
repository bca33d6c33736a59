"""Array arithmetic on packed blocks, applied by Spark to Arrow batches.

One input row is one block of closes with the few jobs of its cell, so the work of a row is bounded
by the block length times JOBS_PER_CELL. The moving sums, comparisons, returns and running peaks of
a job over a block are a handful of vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa

CHANGES = (
    "job_id long, symbol string, iblock long, idx long, date {date}, close long, dir int, prev_dir int, seed boolean"
)
SERIES = (
    "job_id long, symbol string, iblock long, idx long, pos long, date {date}, close long, "
    "short_avg double, long_avg double, dir int, signal int"
)
SUMMARIES = (
    "job_id long, `from` long, bars long, last_close long, n double, mean double, m2 double, "
    "peak double, low double, drawdown double"
)


def lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """A list column as one array per row, without copying."""
    column = batch.column(name)
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def job_rows(batch: pa.RecordBatch, name: str) -> Iterator[dict[str, np.ndarray]]:
    """A list<struct> column as one dict of arrays per row."""
    column = batch.column(name)
    fields = column.values
    arrays = {
        field.name: fields.field(k).to_numpy(zero_copy_only=False) for k, field in enumerate(fields.type)
    }
    offsets = column.offsets.to_numpy()
    for a, b in zip(offsets, offsets[1:]):
        yield {key: values[a:b] for key, values in arrays.items()}


def prefix(closes: np.ndarray) -> np.ndarray:
    """The sums of the first 0, 1, 2, … closes: BIGINT where that is exact, else Python's integers."""
    if _largest(closes) * len(closes) < 2**60:
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(closes, dtype=np.int64)))
    return np.array([0, *accumulate(closes.tolist())], object)


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


Piece = tuple[int, int, np.ndarray]


def _pieces(batch: pa.RecordBatch, row: int) -> dict[int, list[Piece]]:
    """By window: the blocks its far end lies in, as (first position, closes between, prefix sums)."""
    out: dict[int, list[Piece]] = {}
    if batch.schema.get_field_index("pieces") < 0 or not batch.column("pieces")[row].is_valid:
        return out
    for piece in batch.column("pieces")[row].values:
        some = piece["closes"].values.to_numpy(zero_copy_only=False)
        out.setdefault(piece["window"].as_py(), []).append((piece["start"].as_py(), int(piece["gap"].as_py()), prefix(some)))
    return out


def moving(
    total: np.ndarray, base: int, own_from: int, lo: int, hi: int, window: int, pieces: dict[int, list[Piece]]
) -> np.ndarray:
    """Exact sums of the `window` closes up to each of the positions lo..hi.

    `total` are the prefix sums of a block whose array starts at position `base`. Where the window reaches further
    back, the sum up to its far end comes from the `pieces`.
    """
    a, b = lo - base + 1, hi - base + 2
    if a >= window:
        return total[a:b] - total[a - window : b - window]
    far, parts = np.arange(lo - window, hi - window + 1), pieces[window]
    small = total.dtype != object and all(some.dtype != object and abs(gap) < 2**60 for _, gap, some in parts)
    kind = np.int64 if small else object
    before = np.zeros(len(far), kind)
    for start, gap, some in parts:
        there = (far >= start - 1) & (far < start + len(some) - 1)
        before[there] = some[far[there] - start + 1].astype(kind) - gap
    return (total[a:b] - total[own_from - base]).astype(kind) - before


def _states(short_sum: np.ndarray, long_sum: np.ndarray, short: int, long: int) -> np.ndarray:
    """+1 short average above long, -1 not above, 0 where one of them is not positive. Ties are ties."""
    state = np.where(larger(short_sum, long, long_sum, short), 1, -1)
    state[~((short_sum > 0) & (long_sum > 0)).astype(bool)] = 0
    return state


def crossover_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bars at which a job's crossover state differs from the bar before, or that one took no part."""
    for batch in batches:
        symbols, blocks = batch.column("symbol").to_pylist(), batch.column("iblock").to_pylist()
        first_idx, own_from, own_to = (batch.column(c).to_pylist() for c in ("first_idx", "own_from", "own_to"))
        closes = lists(batch, "closes")
        dates, dates_from = batch.column("dates").values, batch.column("dates").offsets.to_numpy()
        out: dict[str, list] = {name: [] for name in (
            "job_id", "symbol", "iblock", "idx", "date", "close", "dir", "prev_dir", "seed")}
        for row, jobs in enumerate(job_rows(batch, "jobs")):
            base, total, pieces = first_idx[row], prefix(closes[row]), _pieces(batch, row)
            for job_id, r0, i0, i1, short, long in zip(*(jobs[c].tolist() for c in (
                    "job_id", "r0", "i0", "i1", "short_window", "long_window"))):
                takes_part = i0 + max(long, short - 1)
                begin, end = max(own_from[row], r0, takes_part), min(own_to[row], i1)
                if begin > end:
                    continue
                known = begin > takes_part
                lo = begin - 1 if known else begin
                short_sum, long_sum = (moving(total, base, own_from[row], lo, end, w, pieces) for w in (short, long))
                state = _states(short_sum, long_sum, short, long)
                before = np.concatenate(([0], state[:-1]))
                change = (state != 0) & (state != before)
                if known:
                    change[0] = False
                at = np.flatnonzero(change)
                if not len(at):
                    continue
                offset = at + lo - base
                out["job_id"].append(np.full(len(at), job_id))
                out["symbol"].extend([symbols[row]] * len(at))
                out["iblock"].append(np.full(len(at), blocks[row]))
                out["idx"].append(offset + base)
                out["date"].append(offset + dates_from[row])
                out["close"].append(closes[row][offset])
                out["dir"].append(state[at])
                out["prev_dir"].append(before[at])
                out["seed"].append(offset + base == i0 + long)
        prev = _joined(out["prev_dir"], np.int32)
        yield pa.RecordBatch.from_pydict({
            "job_id": _joined(out["job_id"], np.int64),
            "symbol": pa.array(out["symbol"], pa.string()),
            "iblock": _joined(out["iblock"], np.int64),
            "idx": _joined(out["idx"], np.int64),
            "date": dates.take(pa.array(_joined(out["date"], np.int64))),
            "close": _joined(out["close"], np.int64),
            "dir": _joined(out["dir"], np.int32),
            "prev_dir": pa.array(prev, pa.int32(), mask=prev == 0),
            "seed": _joined(out["seed"], np.bool_),
        })


def job_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every bar of every job of a block: averages, crossover state, and the signal, where `acts` are given."""
    for batch in batches:
        symbols, blocks = batch.column("symbol").to_pylist(), batch.column("iblock").to_pylist()
        first_idx, own_from, own_to = (batch.column(c).to_pylist() for c in ("first_idx", "own_from", "own_to"))
        closes = lists(batch, "closes")
        dates, dates_from = batch.column("dates").values, batch.column("dates").offsets.to_numpy()
        acts = batch.column("acts").to_pylist() if batch.schema.get_field_index("acts") >= 0 else None
        for row, jobs in enumerate(job_rows(batch, "jobs")):
            base, total, pieces = first_idx[row], prefix(closes[row]), _pieces(batch, row)
            made = {(a["job_id"], a["idx"]): a["signal"] for a in (acts[row] or [])} if acts is not None else {}
            for job_id, r0, i0, i1, short, long in zip(*(jobs[c].tolist() for c in (
                    "job_id", "r0", "i0", "i1", "short_window", "long_window"))):
                lo, hi = max(own_from[row], r0), min(own_to[row], i1)
                if lo > hi:
                    continue
                n, sums, averages = hi - lo + 1, {}, []
                for window in (short, long):
                    average, first = np.full(n, np.nan), max(lo, i0 + window - 1)
                    if first <= hi:
                        sums[window] = moving(total, base, own_from[row], first, hi, window, pieces)
                        average[first - lo :] = sums[window] / window
                    averages.append(average)
                state, first = np.zeros(n, np.int32), max(lo, i0 + max(long, short - 1))
                if first <= hi:
                    both = (sums[w][first - hi - 1 :] for w in (short, long))
                    state[first - lo :] = _states(*both, short, long)
                idx = np.arange(lo, hi + 1)
                signal = np.array([made.get((job_id, k), 0) for k in idx.tolist()] if made else np.zeros(n), np.int32)
                yield pa.RecordBatch.from_pydict({
                    "job_id": np.full(n, job_id),
                    "symbol": pa.array([symbols[row]] * n, pa.string()),
                    "iblock": np.full(n, blocks[row]),
                    "idx": idx,
                    "pos": idx - i0,
                    "date": dates.slice(dates_from[row] + lo - base, n),
                    "close": closes[row][lo - base : hi - base + 1],
                    **{name: pa.array(x, mask=np.isnan(x)) for name, x in zip(("short_avg", "long_avg"), averages)},
                    "dir": pa.array(state, mask=state == 0),
                    "signal": signal,
                })


def larger(a: np.ndarray, times_a: int, b: np.ndarray, times_b: int) -> np.ndarray:
    """a * times_a > b * times_b for whole numbers; in Python's integers where BIGINT would overflow."""
    if object not in (a.dtype, b.dtype) and max(_largest(a) * times_a, _largest(b) * times_b) < 2**63:
        return a * times_a > b * times_b
    return np.array([int(x) * times_a > int(y) * times_b for x, y in zip(a.tolist(), b.tolist())], bool)


def holding_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Returns, peak, low and drawdown of the bars a job holds shares in a block.

    `pieces` is sorted by job and position. Between two pieces the equity stands still, so the
    running peak may pass over them.
    """
    for batch in batches:
        first_idx, closes = batch.column("first_idx").to_pylist(), lists(batch, "closes")
        rows = []
        for row, pieces in enumerate(job_rows(batch, "pieces")):
            ids = pieces["job_id"]
            borders = np.flatnonzero(np.diff(ids)) + 1
            for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(ids)]):
                start, stop = pieces["from"][a:b] - first_idx[row], pieces["until"][a:b] - first_idx[row]
                lengths = stop - start + 1
                ends = np.cumsum(lengths)
                at = np.arange(ends[-1]) + np.repeat(start - (ends - lengths), lengths)
                own_cash, own_shares, price = pieces["cash"][a:b], pieces["shares"][a:b], closes[row]
                if _largest(own_cash) + _largest(own_shares) * _largest(price) >= 2**62:  # exact all the same
                    own_cash, own_shares, price = (x.astype(object) for x in (own_cash, own_shares, price))
                cash, shares = np.repeat(own_cash, lengths), np.repeat(own_shares, lengths)
                value, before = cash + shares * price[at], cash + shares * price[at - 1]
                counted = (before > 0).astype(bool)
                returns = ((value[counted] - before[counted]) / before[counted]).astype(np.float64)
                value, before = value.astype(np.float64), before.astype(np.float64)
                mean = float(returns.mean()) if len(returns) else 0.0
                peak = np.maximum.accumulate(np.maximum(value, before[0]))
                fall = np.where(peak > 0, (peak - value) / np.where(peak > 0, peak, 1.0), 0.0)
                rows.append((
                    int(ids[a]), int(pieces["from"][a]), len(at),
                    int(closes[row][stop[-1]]) if pieces["open"][b - 1] else None,
                    float(len(returns)), mean, float(((returns - mean) ** 2).sum()),
                    float(peak[-1]), float(min(value.min(), before[0])), max(0.0, float(fall.max())),
                ))
        columns = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.int64()] * 4 + [pa.float64()] * 6
        names = ["job_id", "from", "bars", "last_close", "n", "mean", "m2", "peak", "low", "drawdown"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
