"""Who was judged recently, kept as state over a stream of judgements.

A person's rows are judged one by one, again and again. The person is fresh while every one of the rows
was last judged by the model in question and not longer ago than the cooldown; a row that was judged by
another model, or that a later message takes away, ends that at once, and time ends it by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUTPUT = "key string, until long, at long"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rocksdb(spark: SparkSession) -> None:
    """State that follows its keys one by one, which timers need, lies in RocksDB."""
    spark.conf.set(*PROVIDER)


class Cooldown(StatefulProcessor):
    """State of a key: the last judgement of each of its rows, until when it was said to be fresh and its
    timer, as one value, so that a micro-batch costs a key one read and one write of state. Times are
    microseconds. Output at every change and at expiry: until when the key is fresh, null if it isn't."""

    def __init__(self, model: str, days: float):
        self.model, self.span = model, round(days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "held array<struct<row string, stamp long, model string>>, timer long")

    def _until(self, held: dict) -> int | None:
        """When the first row's judgement lapses, None if one isn't by the model."""
        if not held or any(model != self.model or stamp is None for stamp, model in held.values()):
            return None
        return min(stamp for stamp, _ in held.values()) + self.span

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        # of a row's judgements in a micro-batch only the last one can count
        last, newest = {}, None
        for r in rows:
            if r.row not in last or last[r.row].micros is None or (r.micros is not None and r.micros >= last[r.row].micros):
                last[r.row] = r
            if r.micros is not None and (newest is None or r.micros > newest):
                newest = r.micros
        before, timer = self.state.get() or ((), None)
        held = {row: (stamp, model) for row, stamp, model in before or ()}
        for row, r in last.items():
            if r.gone:
                held.pop(row, None)
            elif row not in held or held[row][0] is None or (r.micros is not None and r.micros >= held[row][0]):
                held[row] = (r.micros, r.model)
        until = self._until(held)
        # a time that the stream has passed already isn't waited for
        if until is not None and until // 1000 <= timerValues.getCurrentWatermarkInMs():
            until = None
        wanted = None if until is None else until // 1000 + 1
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.state.update(([(row, *said) for row, said in held.items()], wanted))
        yield Row(key=key[0], until=until, at=newest)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        before, timer = self.state.get() or ((), None)
        held = [(row, stamp, model) for row, stamp, model in before or ()]
        if timer is not None:
            self.state.update((held, None))
            yield Row(key=key[0], until=None, at=self._until({row: said for row, *said in held}))

    def close(self) -> None:
        pass


def freshness(judged: DataFrame, model: str, days: float = 30, late: str = "0 seconds") -> DataFrame:
    """Of the stream ``judged(key, row, stamp, model[, gone])``: key, fresh_until and the time of each change."""
    rocksdb(judged.sparkSession)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in judged.columns else F.lit(False)
    rows = judged.select(F.col("key").cast("string"), F.col("row").cast("string"), F.col("stamp").cast("timestamp").alias("stamp"), "model", gone.alias("gone"), F.unix_micros(F.col("stamp").cast("timestamp")).alias("micros")).withWatermark("stamp", late)
    told = rows.groupBy("key").transformWithState(Cooldown(model, days), OUTPUT, "Update", "EventTime")
    return told.select("key", F.timestamp_micros("until").alias("fresh_until"), F.timestamp_micros("at").alias("at"))


def into_folder(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """What a stream has to say so far, with the number of its micro-batch: each is a folder, which a
    replay writes anew."""
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema.add("epoch", "long")).parquet(folder)


def latest(changes: DataFrame) -> DataFrame:
    """Each key's state by its last change."""
    last = Window.partitionBy("key").orderBy(F.col("epoch").desc(), F.col("at").desc_nulls_last())
    return changes.withColumn("n", F.row_number().over(last)).where("n = 1").select("key", "fresh_until")
