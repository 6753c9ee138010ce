"""Pages, top rows and ordered look-ups. Every order is total, so results don't depend on plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 50) -> DataFrame:
    """At most ``most`` rows in order; a negative limit or offset is refused."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their place; Spark cuts groups before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def best_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(rows, keys, order, 1).drop("place")


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows``, of which there are few, with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def in_given_order(rows: DataFrame, key: str, wanted: Sequence[int]) -> DataFrame:
    """Rows with the wanted keys and the place each has in the list; missing keys vanish."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(list(wanted),)], "ids array<bigint>").select(F.posexplode("ids").alias("place", key))
    return rows.join(listed, key)


def fill_up(ranked: DataFrame, others: DataFrame, key: str, score: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of ``ranked`` by score, then ``others`` that aren't among them by
    ``order``. Both sides are cut to the limit before they meet."""
    best = ranked.orderBy(score, key).limit(limit)
    rest = others.join(best.select(key), key, "left_anti").orderBy(*order, key).limit(limit)
    one = best.select(key, F.lit(0).alias("tier"), F.row_number().over(Window.orderBy(score, key)).alias("place"))
    two = rest.select(key, F.lit(1).alias("tier"), F.row_number().over(Window.orderBy(*order, key)).alias("place"))
    return one.union(two).orderBy("tier", "place").limit(limit)
