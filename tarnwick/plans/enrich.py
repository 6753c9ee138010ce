"""Enrichment: from captured payloads of several sources to one merged record for each person.

raw payloads (person, source, payload) -> contributions (person, field, source, confidence, pos, entry)
-> merged lists and fields -> people whose merged content changed. Each step is a DataFrame; a failed
run resumes because people leave the selection once their new snapshot is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import merge
from tarnwick.sources.payloads import CONFIDENCE, PUBLICATION


def contributions(payloads: DataFrame, parsers: dict) -> DataFrame:
    """``payloads(person_id, source, payload)`` with ``parsers`` (source to a function from the raw
    column to an array of publications): a row for each publication, with its source's confidence."""
    parsed = F.array().cast(f"array<{PUBLICATION}>")
    confidence = F.lit(0.5)
    for source, parse in parsers.items():
        parsed = F.when(F.col("source") == source, F.coalesce(parse(F.col("payload")), F.array().cast(f"array<{PUBLICATION}>"))).otherwise(parsed)
        confidence = F.when(F.col("source") == source, F.lit(CONFIDENCE.get(source, 0.5))).otherwise(confidence)
    rows = payloads.select("person_id", "source", confidence.alias("confidence"), F.posexplode(parsed).alias("pos", "entry"))
    return rows.select("person_id", "source", "confidence", "pos", "entry.*")


def merged_publications(rows: DataFrame, cap: int = merge.CAPS["recent_publications"]) -> DataFrame:
    """Each person's publications, newest first: of equal ones the most confident source's."""
    key = merge.entry_key(F.lit("recent_publications"), F.col("title"), F.col("doi"), F.lit(None), F.col("year"), F.lit(None))
    keyed = rows.withColumn("key", F.when(key != "title:", key))
    order = [F.col("confidence").desc(), F.col("source"), F.col("pos")]
    out = [F.coalesce("year", F.lit(0)).desc(), *order]
    return merge.merge_lists(keyed, ["person_id"], "key", order, out, cap)


def backfill(people: DataFrame, eligible_first: bool = True) -> DataFrame:
    """Resolved people who were never enriched, eligible ones first."""
    rows = people.where("last_enriched IS NULL AND identity_status IN ('auto', 'confirmed')")
    order = [F.col("pi_eligible").desc_nulls_last()] if eligible_first else []
    return rows.orderBy(*order, "department", "person_id")
