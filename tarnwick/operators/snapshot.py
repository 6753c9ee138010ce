"""Changes to tables as new snapshots: upsert, update, retention, purge, export.

Parquet has no row updates, so each operator maps the old snapshot to the new one; writers publish a
snapshot by writing a new folder and moving the pointer last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.budget import in_line


def upsert(old: DataFrame, new: DataFrame, key: str, surrogate: str) -> DataFrame:
    """``old`` with the rows of ``new`` replacing those of equal key, which keep their surrogate;
    new keys get the next surrogates in the order of their keys. Null values of ``new`` overwrite."""
    columns = [c for c in old.columns if c not in (key, surrogate)]
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    value = lambda c: F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    known = joined.where(F.col(f"o.{surrogate}").isNotNull()).select(F.col(f"o.{surrogate}").alias(surrogate), key, *(value(c) for c in columns))
    added = joined.where(F.col(f"o.{surrogate}").isNull()).select(key, *(value(c) for c in columns))
    top = old.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("_top"))  # one row
    numbered = in_line(added, [key]).crossJoin(F.broadcast(top)).withColumn(surrogate, F.col("_top") + F.col("place"))
    return known.unionByName(numbered.select(surrogate, key, *columns))


def retain(log: DataFrame, stamp: str, cutoff: Column, method: str, kept: Sequence[str]) -> DataFrame:
    """``log`` without entries before ``cutoff``, unless their method is one of ``kept`` or null."""
    old = (F.col(stamp) < cutoff) & ~F.col(method).isin(*kept)
    return log.where(~F.coalesce(old, F.lit(False)))


def purge(parents: DataFrame, gone: Column, key: str, children: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """``parents`` without the rows that ``gone`` names, and each child table (table, foreign key,
    action): its rows go too on "cascade", its key becomes null on "null"."""
    keys = parents.where(gone).select(F.col(key).alias("_gone"))
    out = {"parents": parents.where(~F.coalesce(gone, F.lit(False)))}
    for name, (table, foreign, action) in children.items():
        if action == "cascade":
            out[name] = table.join(keys, F.col(foreign) == F.col("_gone"), "left_anti")
        else:
            hit = table.join(keys, F.col(foreign) == F.col("_gone"), "left")
            out[name] = hit.withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).drop("_gone")
    return out


def insert_missing(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, one for each key, whose key ``table`` doesn't have."""
    return new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")


def set_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """``table`` with columns set where the condition holds (null counts as not)."""
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def latest(table: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """The newest row of each key: the state of a key-value table kept as an append-only log."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(stamp).desc()))).where("_n = 1").drop("_n")


def evolve(table: DataFrame, schema, defaults: dict[str, object]) -> DataFrame:
    """``table`` with the columns that it lacks of ``schema``, filled from ``defaults`` or with null."""
    have = set(table.columns)
    return table.select(*(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def export_json(table: DataFrame, path: str, by: str, order: Sequence[str]) -> None:
    """One folder for each value of ``by``, rows sorted within its files."""
    table.repartition(by).sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).json(path)


def export_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)
