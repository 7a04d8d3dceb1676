"""Structured Streaming forms of the time-driven operators; each keeps the batch operator's meaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_counts(events: DataFrame, key: str, at: str, limit: int, late: str = "5 minutes") -> DataFrame:
    """Calls a key and minute, and how many the limit lets through; a minute is final once the watermark has passed it."""
    counts = events.withWatermark(at, late).groupBy(key, F.window(at, "1 minute")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").alias("minute"), "n", F.least("n", F.lit(limit).cast("bigint")).alias("allowed"))


def hourly_counts(events: DataFrame, at: str, late: str = "1 hour", **counted: Column) -> DataFrame:
    """Counts of each hour: all, and those for which each named condition holds."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, "1 hour"))
    return rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counted.items()]).withColumn("hour", F.col("window.start")).drop("window")


def hopping_power(samples: DataFrame, at: str, value: str, size: str, hop: str, late: str) -> DataFrame:
    """Mean square of overlapping blocks."""
    power = F.avg(F.col(value) * F.col(value))
    return samples.withWatermark(at, late).groupBy(F.window(at, size, hop)).agg(power.alias("power")).select(F.col("window.start").alias("start"), "power")


def first_operations(calls: DataFrame, operation: list[str], at: str, window: str = "1 day") -> DataFrame:
    """Each operation once: replays within the window are dropped, later ones are new calls."""
    return calls.withWatermark(at, window).dropDuplicatesWithinWatermark(operation)


def episodes(events: DataFrame, key: str, at: str, quiet_ms: int = 7_200_000) -> DataFrame:
    """(key, claimed, refreshed, n, is_new): an episode of a key is claimed once, refreshed while it goes on, and closed after a quiet gap.

    A row is emitted for each batch that touches an episode; is_new tells the claim. State is one row a key and is dropped by an event-time timer.
    """
    key_type, stamp = events.schema[key].dataType.simpleString(), "claimed timestamp, refreshed timestamp, n bigint"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = pd.concat([b[at] for b in batches]).sort_values()
        claimed, refreshed, n = state.get if state.exists else (None, None, 0)
        out, new = [], claimed is None
        for t in times:
            if claimed is not None and (t - refreshed).total_seconds() * 1000 > quiet_ms:
                out.append((claimed, refreshed, n, new))
                claimed = None
            if claimed is None:
                claimed, refreshed, n, new = t, t, 0, True
            refreshed, n = max(refreshed, t), n + 1
        out.append((claimed, refreshed, n, new))
        state.update((claimed, refreshed, n))
        state.setTimeoutTimestamp(max(int(refreshed.timestamp() * 1000) + quiet_ms, state.getCurrentWatermarkMs() + 1))
        rows = pd.DataFrame(out, columns=["claimed", "refreshed", "n", "is_new"])
        rows.insert(0, key, group[0])
        yield rows

    marked = events.withWatermark(at, f"{quiet_ms} milliseconds")
    return marked.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {key_type}, {stamp}, is_new boolean", stamp, "append", GroupStateTimeout.EventTimeTimeout
    )


def to_targets(targets: dict[str, Callable[[DataFrame, int], None]], failed: Callable[[str, int, Exception], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that gives every batch to every target; one that fails is reported and does not stop the next."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, target in targets.items():
                try:
                    target(batch, batch_id)
                except Exception as e:  # the report decides what to do about it
                    failed(name, batch_id, e)
        finally:
            batch.unpersist()

    return write
