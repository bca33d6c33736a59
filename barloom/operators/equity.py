"""Equity of a job: metrics by block, and the curve bar by bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import kernels
from barloom.functions.metrics import drawdown_percent
from barloom.operators import blocks
from barloom.operators.jobs import cells
from barloom.operators.scan import running


def pieces(holds: DataFrame, spread_blocks: DataFrame) -> DataFrame:
    """Holdings cut at block borders and reduced to one summary row per job and block.

    The pieces of a cell (a bounded number of jobs over one block) are brought to their block.
    """
    by_cell = (
        cells(holds, "from", "until")
        .selectExpr(
            "symbol", "iblock", "salt", "job_id",
            f"greatest(`from`, iblock << {blocks.BLOCK_BITS}) AS `from`",
            f"least(until, ((iblock + 1) << {blocks.BLOCK_BITS}) - 1) AS until",
            "cash_after AS cash",
            "shares_after AS shares",
            f"closed_at IS NULL AND (until >> {blocks.BLOCK_BITS}) = iblock AS open",
        )
        .groupBy("symbol", "iblock", "salt")
        .agg(F.sort_array(F.collect_list(F.struct("job_id", "from", "until", "cash", "shares", "open"))).alias("pieces"))
    )
    return (
        spread_blocks.join(by_cell, ["symbol", "iblock", "salt"])
        .select("first_idx", "closes", "pieces")
        .mapInArrow(kernels.holding_summaries, kernels.SUMMARIES)
    )


def piece_metrics(summaries: DataFrame) -> DataFrame:
    """Per job: moments of the holding returns, peak, max drawdown inside and across pieces."""
    return (
        summaries.selectExpr(
            "*",
            """max(peak) OVER (PARTITION BY job_id ORDER BY `from`
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak_before""",
            "sum(n * mean) OVER (PARTITION BY job_id) / nullif(sum(n) OVER (PARTITION BY job_id), 0) AS mean_all",
        )
        .groupBy("job_id")
        .agg(
            F.expr("sum(n) AS h_n"),
            F.expr("max(mean_all) AS h_mean"),
            F.expr("sum(m2 + n * pow(mean - mean_all, 2)) AS h_m2"),
            F.expr("sum(bars - n) AS h_skipped"),
            F.expr("max(peak) AS h_peak"),
            F.expr("min(low) AS h_low"),
            F.expr("max(greatest(drawdown, (peak_before - low) / nullif(peak_before, 0))) AS h_drawdown"),
            F.expr("max(last_close) AS last_close"),
        )
    )


def intervals(trades: DataFrame, spans: DataFrame) -> DataFrame:
    """Stretches of constant cash and shares that together cover every bar of a job."""
    opening = spans.select(
        "job_id", "symbol", "salt", "i0", "i1",
        F.col("r0").alias("idx"), F.lit(0).alias("rank"),
        F.col("cash").alias("cash"), F.col("shares").alias("shares"),
    )
    changed = trades.select(
        "job_id", "symbol", "salt", "i0", "i1", "idx", F.lit(1).alias("rank"),
        F.col("cash_after").alias("cash"), F.col("shares_after").alias("shares"),
    )
    by_job = Window.partitionBy("job_id").orderBy("idx", "rank")
    return (
        opening.unionByName(changed)
        .withColumn("until", F.coalesce(F.lead("idx").over(by_job) - 1, F.col("i1")))
        .withColumn("from", F.col("idx"))
        .withColumn("cash_before", F.coalesce(F.lag("cash").over(by_job), F.col("cash")))
        .withColumn("shares_before", F.coalesce(F.lag("shares").over(by_job), F.col("shares")))
        .filter(F.col("from") <= F.col("until"))
    )


def _value(cash: str, shares: str, price: Column) -> Column:
    """NULL where it does not fit a BIGINT."""
    return F.try_add(F.col(cash), F.try_multiply(F.col(shares), price))


def equity_rows(stretches: DataFrame, spread_blocks: DataFrame, every: int = 1) -> DataFrame:
    """One row per job and `every` bars: equity, and that of the bar before (NULL at the first bar)."""
    low, high = F.greatest("own_from", "from"), F.least("own_to", "until")
    low = low + F.pmod(F.col("i0") - low, F.lit(every))
    at = (F.col("idx") - F.col("first_idx")).cast("int")
    close, before = F.get("closes", at), F.get("closes", at - 1)
    at_trade = F.col("idx") == F.col("from")
    return (
        cells(stretches.drop("idx"), "from", "until")
        .join(spread_blocks, ["symbol", "iblock", "salt"])
        .withColumn(
            "idx",
            F.explode(
                F.when(low <= high, F.sequence(low, high, F.lit(every).cast("bigint")))
            ),
        )
        .select(
            "job_id", "symbol", "iblock", "i0", "idx",
            F.get("dates", at).alias("date"),
            close.alias("close"),
            "cash", "shares",
            _value("cash", "shares", close).alias("equity"),
            F.when(
                F.col("idx") > F.col("i0"),
                F.when(at_trade, _value("cash_before", "shares_before", before))
                .otherwise(_value("cash", "shares", before)),
            ).alias("prev_equity"),
        )
    )


def drawdown_rows(equity: DataFrame) -> DataFrame:
    """Running peak and drawdown of an equity curve, scanned block by block."""
    with_peak = running(equity, ["job_id"], "iblock", ["idx"], {"peak": ("max", F.col("equity"))})
    return with_peak.withColumn("drawdown_pct", drawdown_percent(F.col("peak"), F.col("equity")))
