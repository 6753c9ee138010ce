"""What the operators share of Spark: shipping the package, tables in the shared folder, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick import session
from tarnwick.workspace import clear, drop, drop_since, mark, save, shared_folder  # noqa: F401

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """What every query with Python does first: the package goes to the executors, and Arrow batches
    get a bound in bytes (unless the session has one): by rows alone, long texts make large ones."""
    session.ship(spark)
    if spark.conf.get(BATCH, None) in (None, "64m", "67108864b", "67108864"):
        spark.conf.set(BATCH, "4m")


def size_bytes(df: DataFrame, column: str | None = None) -> int:
    """Bytes of ``df`` by the optimiser's statistics (file sizes: no job runs); where those are
    unknown and ``column`` is named, by a sum of that column's lengths."""
    from pyspark.sql import functions as F

    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known > 1 << 50 and column:
        known = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return known


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
