"""A plain Python model of one backtest, written from the definitions; the tests compare with it."""

from __future__ import annotations

import math


def signals(closes: list[int], short: int, long: int) -> list[int]:
    n = len(closes)
    out = [0] * n
    above_before = False
    for i in range(long, n):
        if i < short - 1 or n < max(short, long):
            continue
        s, l = sum(closes[i - short + 1 : i + 1]), sum(closes[i - long + 1 : i + 1])
        if s > 0 and l > 0:
            above = s * long > l * short
            if i > long and above != above_before:
                out[i] = 1 if above else -1
            above_before = above
    return out


def backtest(closes: list[int], capital: float, made: list[int]) -> dict:
    start = round(capital * 100)
    cash, shares, trades, curve, before = start, 0, [], [], 0
    for i, (close, signal) in enumerate(zip(closes, made)):
        if signal != before and signal != 0:
            if signal == 1 and shares == 0 and close > 0 and cash // close > 0:
                shares = cash // close
                cash -= shares * close
                trades.append((i, 1, shares, shares * close))
            elif signal == -1 and shares > 0:
                cash += shares * close
                trades.append((i, -1, shares, shares * close))
                shares = 0
        before = signal
        curve.append(cash + shares * close)
    returns = [(b - a) / a for a, b in zip(curve, curve[1:]) if a > 0]
    mean = sum(returns) / len(returns) if returns else 0.0
    dev = math.sqrt(sum((r - mean) ** 2 for r in returns) / len(returns)) if returns else 0.0
    peak, drawdown = curve[0], 0.0
    for value in curve:
        peak = max(peak, value)
        drawdown = max(drawdown, (peak - value) / peak * 100.0)
    trips = [b[3] - a[3] for a, b in zip(trades, trades[1:]) if a[1] == 1 and b[1] == -1]
    return {
        "total_return": (curve[-1] - start) / start * 100.0,
        "sharpe_ratio": mean / dev * math.sqrt(252) if len(returns) >= 2 and dev >= 1e-10 else 0.0,
        "max_drawdown": drawdown,
        "final_value": curve[-1] / 100.0,
        "num_trades": len(trades),
        "winning": sum(p > 0 for p in trips),
        "losing": sum(p <= 0 for p in trips),
        "trades": trades,
        "curve": curve,
    }


def assert_result(row, expected: dict) -> None:
    assert row["success"], row["error_message"]
    for name in ("num_trades", "winning", "losing"):
        assert row[name] == expected[name], (name, row, expected)
    for name in ("total_return", "sharpe_ratio", "max_drawdown", "final_value"):
        assert math.isclose(row[name], expected[name], rel_tol=1e-7, abs_tol=2e-6), (name, row, expected)
