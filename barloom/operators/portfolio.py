"""The order-dependent fold: actionable signals into an all-in, whole-share portfolio.

Whole shares make the recursion non-linear: every trade depends on the cash the one before left, so
the trades of one job can only be found in order. Spark does the rest: it brings the few actionable
rows of a job together, sorted, and streams them in Arrow batches through a small loop that keeps
three numbers per job. Nothing is collected per job, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barloom.schemas import BUY, SELL
from barloom.storage import written

PORTFOLIO = [
    "cash", "shares", "last_buy_value", "last_trade_idx", "num_trades", "winning", "losing", "fault",
]
_OPENING = ["open_cash", "open_shares", "open_buy_value"]
_MADE = {
    "shares": pa.int64(), "value": pa.int64(), "cash_after": pa.int64(), "shares_after": pa.int64(),
    "profit": pa.int64(), "fault": pa.string(),
}
_LARGEST = 2**63 - 1


def opening_portfolio(spans: DataFrame) -> DataFrame:
    """Spans with the portfolio they start from: the capital, or a saved state where one is given."""
    if "cash" in spans.columns:
        return spans
    return spans.selectExpr(
        "*",
        "capital AS cash",
        "0L AS shares",
        "CAST(NULL AS BIGINT) AS last_buy_value",
        "CAST(NULL AS BIGINT) AS last_trade_idx",
        "0L AS num_trades",
        "0L AS winning",
        "0L AS losing",
        "CAST(NULL AS STRING) AS fault",
    )


def execute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Actionable rows in order of (job_id, idx) -> the rows that became trades, and faults.

    BUY when flat: as many whole shares as the cash allows, at the close. SELL when invested: all
    of them. A BUY that affords nothing and a SELL when flat are ignored.
    """
    job, cash, shares, paid, ruined = None, 0, 0, 0, False
    for batch in batches:
        rows, made = [], {name: [] for name in _MADE}
        columns = [batch.column(c).to_pylist() for c in ("job_id", "signal", "close", *_OPENING)]
        for i, (job_id, signal, close, open_cash, open_shares, open_paid) in enumerate(zip(*columns)):
            if job_id != job:
                job, cash, shares, paid, ruined = job_id, open_cash, open_shares, open_paid, False
            if ruined:
                continue
            quantity, value, profit, fault = 0, 0, None, None
            if signal == BUY and shares == 0:
                if close <= 0:
                    ruined, fault = True, "Invalid job: price at BUY must be positive"
                elif close <= cash:
                    quantity = cash // close
                    value = paid = quantity * close
                    cash, shares = cash - value, quantity
            elif signal == SELL and shares > 0:
                quantity, value = shares, shares * close
                profit = value - paid
                cash, shares = cash + value, 0
                if max(abs(value), abs(cash)) > _LARGEST:
                    ruined, fault = True, "Invalid job: numeric overflow"
            if fault is not None:
                quantity, value, profit = None, None, None
            elif quantity == 0:
                continue
            rows.append(i)
            values = (quantity, value, None if fault else cash, None if fault else shares, profit, fault)
            for name, cell in zip(_MADE, values):
                made[name].append(cell)
        kept = batch.drop_columns(_OPENING).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, *[pa.array(made[name], kind) for name, kind in _MADE.items()]],
            names=[*kept.schema.names, *_MADE],
        )


def fold(acts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(portfolio per job after its last bar, trades as rows).

    `acts`: job_id, symbol, iblock, idx, date, close, signal, actionable rows only.
    """
    opening = opening_portfolio(spans)
    start = opening.selectExpr(
        "job_id", "salt", "i0", "i1",
        "cash AS open_cash", "shares AS open_shares", "coalesce(last_buy_value, 0L) AS open_buy_value",
    )
    ordered = acts.join(start, "job_id").repartition("job_id").sortWithinPartitions("job_id", "idx")
    kept = [f for f in ordered.schema.fields if f.name not in _OPENING]
    schema = StructType(
        kept + [StructField(n, StringType() if k == pa.string() else LongType()) for n, k in _MADE.items()]
    )
    made = written(ordered.mapInArrow(execute, schema), "trades")
    trades = made.filter("fault IS NULL").drop("fault", "iblock").withColumnRenamed("close", "price")

    after = made.groupBy("job_id").agg(
        F.expr("max_by(cash_after, idx) AS new_cash"),
        F.expr("max_by(shares_after, idx) AS new_shares"),
        F.expr(f"max_by(value, idx) FILTER (WHERE signal = {BUY}) AS new_buy_value"),
        F.expr("max(idx) AS new_trade_idx"),
        F.expr("count_if(fault IS NULL) AS new_trades"),
        F.expr("count_if(profit > 0) AS new_winning"),
        F.expr("count_if(profit <= 0) AS new_losing"),
        F.expr("max(fault) AS new_fault"),
    )
    portfolio = opening.join(after, "job_id", "left").selectExpr(
        *[c for c in opening.columns if c not in PORTFOLIO],
        "coalesce(new_cash, cash) AS cash",
        "coalesce(new_shares, shares) AS shares",
        "coalesce(new_buy_value, last_buy_value) AS last_buy_value",
        "coalesce(new_trade_idx, last_trade_idx) AS last_trade_idx",
        "num_trades + coalesce(new_trades, 0L) AS num_trades",
        "winning + coalesce(new_winning, 0L) AS winning",
        "losing + coalesce(new_losing, 0L) AS losing",
        "coalesce(fault, new_fault) AS fault",
    )
    return portfolio, trades


def holdings(trades: DataFrame, resumed: DataFrame | None = None) -> DataFrame:
    """Stretches with open shares: bars after `idx` up to and including `until`."""
    columns = ["job_id", "symbol", "salt", "i0", "i1", "idx", "signal", "cash_after", "shares_after"]
    rows = trades.select(*columns)
    if resumed is not None:
        rows = rows.unionByName(
            resumed.filter("shares > 0").selectExpr(
                "job_id", "symbol", "salt", "i0", "i1",
                "r0 - 1 AS idx", f"{BUY} AS signal", "cash AS cash_after", "shares AS shares_after",
            )
        )
    by_job = Window.partitionBy("job_id").orderBy("idx")
    return (
        rows.withColumn("closed_at", F.lead("idx").over(by_job))
        .filter("shares_after > 0")
        .selectExpr("*", "idx + 1 AS `from`", "coalesce(closed_at, i1) AS until")
    )
