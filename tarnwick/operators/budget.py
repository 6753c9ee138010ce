"""Queues that are worked through until a budget is spent or too much goes wrong.

Running totals over all rows in one order are taken in three steps: rows are dealt to ranges of the order
and written, each range's totals are summed, and a row adds its range's start to what precedes it there.
No window spans all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick import workspace


def _name(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def in_line(rows: DataFrame, order: Sequence[Column | str], **totals: Column) -> DataFrame:
    """``rows`` with place (from 1, by ``order``, which must tell any two rows apart) and, for each of
    ``totals``, the sum of what stands before the row (null counts as nothing)."""
    order = [_name(o) for o in order]
    amounts = {name: F.coalesce(x, F.lit(0)) for name, x in totals.items()}
    dealt = rows.withColumns({f"_{name}": x for name, x in amounts.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = workspace.save(dealt.withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), *(F.sum(f"_{name}").alias(f"_sum_{name}") for name in amounts))
    # one row for each range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = sums.select("_range", before("_rows").alias("_start"), *(before(f"_sum_{name}").alias(f"_start_{name}") for name in amounts))
    inside = Window.partitionBy("_range").orderBy(*order)
    preceding = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_range")
    out = out.withColumns({"place": F.col("_start") + F.row_number().over(inside)} | {name: F.col(f"_start_{name}") + F.coalesce(F.sum(f"_{name}").over(preceding), F.lit(0)) for name in amounts})
    return out.select(*rows.columns, "place", *amounts)


def with_lookups(rows: DataFrame, order: Sequence[Column | str], needs: Column, most: int | None) -> DataFrame:
    """``rows`` with granted: whether a row that needs a look-up gets one, as the first ``most`` in line do
    (all, if None)."""
    if most is None:
        return rows.withColumn("granted", F.coalesce(needs, F.lit(False)))
    lined = in_line(rows.withColumn("_needs", F.coalesce(needs, F.lit(False))), order, used=F.col("_needs").cast("long"))
    return lined.withColumn("granted", F.col("_needs") & (F.col("used") < most)).drop("_needs", "used", "place")


def within_time(rows: DataFrame, order: Sequence[Column | str], seconds: Column, budget: float, reserve: float = 30.0) -> DataFrame:
    """The rows that are begun before the time for all of them, less a reserve, is over."""
    return in_line(rows, order, spent=seconds).where(F.col("spent") <= budget - reserve).drop("spent")


def until_failures(rows: DataFrame, order: Sequence[Column | str], failed: Column, most: int = 3, at_once: Column | None = None) -> DataFrame:
    """The rows up to the ``most``-th failure in a row, or to the first row that ends the work ``at_once``;
    with their place. What fails there is among them, what comes behind isn't."""
    lined = workspace.save(in_line(rows.withColumns({"_failed": F.coalesce(failed, F.lit(False)), "_ends": F.coalesce(at_once if at_once is not None else F.lit(False), F.lit(False))}), order))
    # a failure counts for its place and the next ones; the first place with enough of them is the end
    reach = lined.where("_failed").select(F.explode(F.sequence(F.col("place"), F.col("place") + most - 1)).alias("at"))
    ends = reach.groupBy("at").count().where(F.col("count") == most).select("at").union(lined.where("_ends").select("place"))
    last = ends.agg(F.min("at").alias("_last"))
    return lined.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("place") <= F.col("_last"))).drop("_failed", "_ends", "_last")
