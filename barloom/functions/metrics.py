"""Metric formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods per year, smallest deviation that counts.
PERIODS_PER_YEAR = 252
MIN_DEVIATION = 1e-10


def sharpe_ratio(count: Column, mean: Column, deviation: Column, risk_free: float = 0.0) -> Column:
    """Annualised (mean - rf) / population deviation; 0 below two returns or without deviation."""
    return F.when(
        (count >= 2) & (deviation >= MIN_DEVIATION),
        (mean - risk_free) / deviation * F.sqrt(F.lit(float(PERIODS_PER_YEAR))),
    ).otherwise(0.0)


def sharpe_of(returns: Column, risk_free: float = 0.0) -> Column:
    """The same as an aggregate over a column of returns."""
    return sharpe_ratio(F.count(returns), F.avg(returns), F.stddev_pop(returns), risk_free)


def simple_return(now: Column, before: Column) -> Column:
    """NULL where there is no positive previous value."""
    return F.when(before > 0, (now - before) / before)


def drawdown_percent(peak: Column, value: Column) -> Column:
    return F.when(peak > 0, (peak - value) / peak * 100.0).otherwise(0.0)


def total_return_percent(final: Column, capital: Column) -> Column:
    return (final - capital) / capital * 100.0
