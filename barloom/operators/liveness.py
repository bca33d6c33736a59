"""Liveness of entities by their heartbeats, and the ledger of assigned work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import period_block, previous

# Fixed value: seconds without a heartbeat (whole seconds) above which an entity is dead.
TIMEOUT_SECONDS = 6


def _seconds(later, earlier):
    """Elapsed whole seconds; the fraction is dropped."""
    return F.timestamp_diff("SECOND", earlier, later)


def dead_entities(heartbeats: DataFrame, as_of, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Entities whose last heartbeat is too old at `as_of` (a timestamp column or literal)."""
    return (
        heartbeats.groupBy("entity")
        .agg(F.max("ts").alias("last_ts"))
        .withColumn("elapsed", _seconds(as_of, F.col("last_ts")))
        .filter(F.col("elapsed") > timeout)
    )


def gaps(heartbeats: DataFrame, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Silent stretches: consecutive heartbeats of an entity further apart than the timeout."""
    blocked = heartbeats.withColumn("block", period_block(F.to_date("ts"), 1))
    return (
        previous(blocked, ["entity"], "block", "ts", "ts", "prev_ts")
        .withColumn("elapsed", _seconds(F.col("ts"), F.col("prev_ts")))
        .filter(F.col("elapsed") > timeout)
        .select("entity", "prev_ts", "ts", "elapsed")
    )


def latest_status(heartbeats: DataFrame, columns: list[str]) -> DataFrame:
    """The last heartbeat's payload per entity."""
    return (
        heartbeats.groupBy("entity")
        .agg(F.max("ts").alias("last_ts"), F.max_by(F.struct(*columns), "ts").alias("s"))
        .select("entity", "last_ts", "s.*")
    )


def orphaned(ledger: DataFrame, dead: DataFrame, answered: DataFrame) -> DataFrame:
    """Work assigned to a dead entity and not answered: it returns to the pending state."""
    return ledger.join(dead, "entity", "left_semi").join(answered, "job_id", "left_anti")


def ledger_status(ledger: DataFrame, dead: DataFrame, answered: DataFrame) -> DataFrame:
    """Status per job: completed, failed, active, or pending (unassigned or orphaned)."""
    return (
        ledger.join(answered.select("job_id", "success"), "job_id", "left")
        .join(dead.select("entity", F.lit(True).alias("is_dead")), "entity", "left")
        .withColumn(
            "status",
            F.when(F.col("success"), "completed")
            .when(~F.col("success"), "failed")
            .when(F.col("entity").isNull() | F.col("is_dead"), "pending")
            .otherwise("active"),
        )
        .drop("is_dead")
    )


def ledger_counts(statuses: DataFrame, heartbeats: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: entities that are alive, and the jobs of each status."""
    alive = heartbeats.select("entity").distinct().join(dead, "entity", "left_anti")
    rows = statuses.select("status").unionByName(alive.select(F.lit("alive").alias("status")))
    return rows.agg(
        F.count_if(F.col("status") == "alive").alias("active_entities"),
        *[
            F.count_if(F.col("status") == status).alias(status)
            for status in ("pending", "active", "completed", "failed")
        ],
    )
