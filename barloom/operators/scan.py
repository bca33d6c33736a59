"""Running totals over an ordered series, computed block by block.

A plain `Window.partitionBy(key).orderBy(...)` puts a whole series into one task. Here the series
is cut into consecutive blocks: each block is scanned on its own, one summary row per block carries
the totals of the blocks before it, and the two are joined. The work of a hot key is spread over as
many tasks as it has blocks; only the summaries meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.storage import written

_COMBINE = {
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "max": lambda before, here: F.greatest(before, here),
}
_WITHIN = {"count": lambda value: F.count(F.lit(1)), "sum": F.sum, "max": F.max}
_ACROSS = {"count": F.sum, "sum": F.sum, "max": F.max}


def running(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    totals: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add inclusive running totals `{name: (count|sum|max, value)}` per key in `order`.

    `block` must not decrease along `order` within a key.
    """
    within = Window.partitionBy(*keys, block).orderBy(*order)
    upto_here = within.rowsBetween(Window.unboundedPreceding, 0)
    earlier = (
        Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )

    local = df
    for name, (kind, value) in totals.items():
        here = F.row_number().over(within) if kind == "count" else _WITHIN[kind](value).over(upto_here)
        local = local.withColumn(f"__{name}", here)

    summary = df.groupBy(*keys, block).agg(
        *[_WITHIN[kind](value).alias(name) for name, (kind, value) in totals.items()]
    )
    carried = summary.select(
        *keys,
        block,
        *[_ACROSS[kind](F.col(name)).over(earlier).alias(f"__before_{name}")
          for name, (kind, _) in totals.items()],
    )
    joined = local.join(carried, [*keys, block])
    return joined.select(
        *df.columns,
        *[_COMBINE[kind](F.col(f"__before_{name}"), F.col(f"__{name}")).alias(name)
          for name, (kind, _) in totals.items()],
    )


def dealt(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """`df` in the order of `order`, cut into even parts by a range sort, as a written table.

    Adds `__at`, which increases along the order, and `__part`, the part; parts follow one another. They
    come from the data, so a hot key is as many parts as it has rows for, and `__part` can be the
    block of `running`.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ordered.withColumn("__at", F.monotonically_increasing_id()), label)
    return placed.withColumn("__part", F.shiftright("__at", 33))  # the upper bits are the partition's number


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add `name` = 1, 2, 3, … along `order`.

    Rows are counted within their part; the parts (as many as the range sort has partitions, whatever
    the number of rows) are added up by the driver, so nothing is windowed in one task.
    """
    placed = dealt(df, order, "numbered")
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    start = F.get(F.array(*[F.lit(n) for n in before]) if before else F.array(F.lit(0)), F.col("__part").cast("int"))
    inside = F.col("__at") - F.shiftleft("__part", 33)
    return placed.withColumn(name, (start + inside + 1).cast("bigint")).drop("__at", "__part")


def period_block(date: Column, days: int) -> Column:
    """Calendar blocks: a function of the row alone, so it costs no pass over the data.

    Never NULL: a NULL check inferred on one side of the carry join only would keep Spark from
    reusing the shuffle of the series for both sides.
    """
    return F.coalesce(F.floor(F.unix_date(date) / F.lit(days)).cast("int"), F.lit(0))


def previous(df: DataFrame, keys: list[str], block: str, order: str, value: str, name: str) -> DataFrame:
    """Add `name`: `value` of the row before in the series, across block borders; NULL at its start."""
    within = Window.partitionBy(*keys, block).orderBy(order)
    last = df.groupBy(*keys, block).agg(F.max_by(value, order).alias("__last"))
    carried = last.select(
        *keys, block, F.lag("__last").over(Window.partitionBy(*keys).orderBy(block)).alias("__carried")
    )
    return (
        df.withColumn("__here", F.lag(value).over(within))
        .withColumn("__rank", F.row_number().over(within))
        .join(carried, [*keys, block])
        .withColumn(name, F.when(F.col("__rank") == 1, F.col("__carried")).otherwise(F.col("__here")))
        .drop("__here", "__rank", "__carried")
    )
