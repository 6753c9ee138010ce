"""Append-only logs as streams: retention by watermark, cooldown by state, upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(log: DataFrame, stamp: str, by: str, window: str, late: str) -> DataFrame:
    """Entries of each kind in each window; later ones than ``late`` behind the newest are dropped,
    which bounds the state."""
    return log.withWatermark(stamp, late).groupBy(F.window(stamp, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def first_seen(log: DataFrame, keys: list[str], stamp: str, cooldown: str) -> DataFrame:
    """Entries whose key had none within the cooldown before (as far as the watermark reaches)."""
    return log.withWatermark(stamp, cooldown).dropDuplicatesWithinWatermark(keys)


def upsert_stream(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``apply``, which writes a new snapshot; an epoch that is replayed
    after a failure upserts the same rows again, so the result is the same."""
    return changes.writeStream.foreachBatch(lambda batch, epoch: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
