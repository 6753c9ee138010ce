"""Coverage, funnel, triage and calibration reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import percent


def counts(rows: DataFrame, by: Sequence[str] = (), shares: Sequence[str] = (), **conditions: Column) -> DataFrame:
    """total and, for each named condition, how many rows meet it; pct_* for those in ``shares``.
    One pass with partial aggregation, whatever the number of conditions."""
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))
    for k in shares:
        out = out.withColumn(f"pct_{k}", percent(F.col(k), F.col("total")))
    return out


def dense_counts(rows: DataFrame, column: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A column for each of ``values`` with its count (0 where there are none), and total."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))


def stage_counts(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """place, stage and n for each of ``values``, with 0 for those without rows."""
    found = rows.groupBy(F.col(column).alias("stage")).agg(F.count("*").alias("n"))
    all_ = rows.sparkSession.createDataFrame(list(enumerate(values)), "place int, stage string")
    return all_.join(found, "stage", "left").select("place", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """Keys of more than one row, null being one key."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def coverage_label(pct: Column) -> Column:
    return F.when(pct >= 80, "on target").when(pct >= 60, "approaching").otherwise("below")


def triage(rows: DataFrame, by: str, strong: Column, weak: Column) -> DataFrame:
    """A bucket for each group by what holds for any or all of its rows."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.bool_or(strong).alias("any_strong"), F.bool_and(strong).alias("all_strong"), F.bool_or(weak).alias("any_weak"))
    bucket = F.when(F.col("all_strong"), "clear").when(F.col("any_strong") & (F.col("n") > 1), "mixed").when(F.col("any_weak"), "weak").otherwise("none")
    return g.select(by, "n", bucket.alias("bucket"))


def calibration(cases: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: how many of ``cases(score, correct)`` are accepted and right, precision
    (null without accepted ones) and coverage. Cases are expanded by the few thresholds and
    aggregated before the shuffle."""
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    accepted = F.col("score") >= F.col("threshold")
    out = cases.select("score", "correct", grid).groupBy("threshold").agg(F.count_if(accepted).alias("accepted"), F.count_if(accepted & F.col("correct")).alias("right"), F.count("*").alias("n"))
    return out.withColumn("precision", F.round(F.try_divide("right", "accepted"), 6)).withColumn("coverage", F.round(F.try_divide("accepted", "n"), 6))


def moves(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """How often which value became which other one, most frequent first."""
    changed = rows.where(old.isNotNull() & (old != new)).select(F.concat(old, F.lit(" -> "), new).alias("move"))
    return changed.groupBy("move").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "move")
