"""Streams: change tracking, coverage that never goes back, outcomes once each, counts by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

#: How late an observation may be before its window is closed.
LATE = "26 hours"


def hourly_counts(stream: DataFrame, at: str, *keys: str) -> DataFrame:
    """Counts by UTC hour and keys."""
    return stream.withWatermark(at, LATE).groupBy(F.window(at, "1 hour").alias("hour"), *keys).agg(F.count("*").alias("n"))


def coverage(stream: DataFrame, target: str, at: str, status: str) -> DataFrame:
    """First and last successful observation of each target; an older, late one can't set the state back."""
    good = stream.where(F.col(status).isin("success", "partial"))
    return good.groupBy(target).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"), F.max_by(status, at).alias("last_status"))


def once(stream: DataFrame, key: list[str], at: str) -> DataFrame:
    """Events without the repeats of their idempotency key within the lateness bound."""
    return stream.withWatermark(at, LATE).dropDuplicatesWithinWatermark(key)


def each_batch(apply: Callable[[DataFrame, int], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: what ``apply`` makes of a batch, in a folder of its number, so that a replay replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch, number).write.mode("overwrite").parquet(f"{path}/{number:08d}")

    return write
