"""Liveness on a stream of heartbeats: silent stretches close a session, and timers announce deaths when they happen."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.liveness import TIMEOUT_SECONDS


def sessions(heartbeats: DataFrame, timeout: int = TIMEOUT_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """Alive periods per entity: first and last heartbeat, and how many there were.

    Dead means more than `timeout` whole seconds of silence, so a period ends after
    (timeout + 1) seconds; Spark joins an event exactly at the gap, hence one microsecond less.
    """
    gap = f"{(timeout + 1) * 1_000_000 - 1} microseconds"
    return (
        heartbeats.withWatermark("ts", lateness)
        .groupBy("entity", F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("beats"))
        .select("entity", "first_ts", "last_ts", "beats")
    )


EVENTS = "entity long, event string, last_us long"


def _watched(timeout: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the last beat in microseconds and whether its death has been told."""
    silence = (timeout + 1) * 1_000_000
    told: list[tuple[str, int]] = []
    if state.hasTimedOut:
        last, dead = state.get[0], True
        told.append(("dead", last))
    else:
        beats = sorted(int(us) for batch in batches for us in batch["us"])
        last, dead = state.get if state.exists else (beats[0], False)
        for us in beats:
            if us - last >= silence:  # a silence that came and went within what has arrived
                if not dead:
                    told.append(("dead", last))
                told.append(("revived", us))
                dead = False
            elif dead and us > last:
                told.append(("revived", us))
                dead = False
            last = max(last, us)
    due = -(-last // 1000) + silence // 1000 - 1  # Spark calls when the watermark is later than this
    if not dead and due <= state.getCurrentWatermarkMs():
        told.append(("dead", last))
        dead = True
    state.update((last, dead))
    if not dead:
        state.setTimeoutTimestamp(due)
    if told:
        yield pd.DataFrame([(key[0], event, us) for event, us in told], columns=["entity", "event", "last_us"])


def watch(heartbeats: DataFrame, timeout: int = TIMEOUT_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """(entity, event, ts): "dead" with the last beat, as soon as the watermark is more than `timeout` whole seconds
    behind it, and "revived" with the beat that ends a silence.

    Time is event time, so a death needs no further beat of its entity, only of any other. At any moment the entities
    whose last event is "dead" are those that `dead_entities` finds at the watermark.
    """
    beats = heartbeats.select("entity", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", lateness)
    told = beats.groupBy("entity").applyInPandasWithState(
        functools.partial(_watched, timeout), EVENTS, "last_us long, dead boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return told.select("entity", "event", F.timestamp_micros("last_us").alias("ts"))
