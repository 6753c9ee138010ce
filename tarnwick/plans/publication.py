"""The table of people and what is searched of them, published together; exported as JSON and rebuilt.

A version holds the people as stored and the texts that the index is made of. It is refused if a key occurs
twice or if not every person is indexed, so what readers see always fits together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick import workspace
from tarnwick.functions.names import stable_key
from tarnwick.operators import directory, records, snapshot
from tarnwick.operators.budget import in_line
from tarnwick.versions import Store, same_rows, unique

#: What isn't exported: surrogates, keys and what is worked out anew.
WORKED_OUT = ["id", "stable_key", "has_profile", "grants_count", "pubs_count", "updated_at"]


def publish(store: Store, people: DataFrame, parent: int, now: Column) -> int:
    """``people`` (records with lists as arrays) as the version after ``parent``."""
    full = workspace.save(records.derived(snapshot.evolve(people, _record_schema(), {}), now).select(*records.COLUMNS))
    tables = {"people": records.stored(full), "indexed": directory.documents(full)}
    return store.publish(tables, parent, checks=[unique("people", "stable_key"), same_rows("people", "indexed")])


def _record_schema() -> T.StructType:
    """Records as they are handled: lists as arrays, eligibility as a boolean."""
    kind = lambda f: T.ArrayType(T.StringType()) if f.name in records.LISTS else T.BooleanType() if f.name == "pi_eligible" else f.dataType
    return T.StructType([T.StructField(f.name, kind(f)) for f in records.schema()])


def export(people: DataFrame, folder: str) -> None:
    """Stored ``people`` as JSON, a folder for each department, a record a line without what is null."""
    shown = records.recorded(people).drop(*WORKED_OUT)
    snapshot.export_json(shown, folder, "department", ["last_name", "first_name"])


def rebuild(spark: SparkSession, folder: str, store: Store, now: Column) -> int:
    """The table from an export, as the store's next version: keys are worked out anew, ids follow the keys."""
    schema = T.StructType([f for f in _record_schema() if f.name not in WORKED_OUT])
    rows = spark.read.schema(schema).json(folder)
    key = stable_key(F.col("department"), F.col("orcid"), F.col("email"), F.col("first_name"), F.col("last_name"))
    numbered = in_line(rows.withColumn("stable_key", key), ["stable_key"]).withColumnRenamed("place", "id")
    return publish(store, numbered, store.current(), now)
