"""Ordered classification: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import blank, slug


def first_match(rules: Sequence[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    out = None
    for condition, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(default) if default is None or isinstance(default, str) else default)


#: Beginnings of a roster's job descriptions and the titles that they stand for, in order.
TITLES = [
    (r"^PROF[-\s]", "Professor"), (r"^ASSOC PROF[-\s]", "Associate Professor"), (r"^ASSOC ADJ PROF[-\s]", "Associate Adjunct Professor"),
    (r"^ASST PROF[-\s]", "Assistant Professor"), (r"^ASST ADJ PROF[-\s]", "Assistant Adjunct Professor"), (r"^ASST RES[-\s]", "Assistant Researcher"),
    (r"^ASSOC RES[-\s]", "Associate Researcher"), (r"^RES SCNTST[-\s]", "Research Scientist"), (r"^HS CLIN PROF[-\s]", "Health Sciences Clinical Professor"),
    (r"^HS ASSOC CLIN PROF[-\s]", "Health Sciences Associate Clinical Professor"), (r"^HS ASST CLIN PROF[-\s]", "Health Sciences Assistant Clinical Professor"),
    (r"^PROF OF CLIN[-\s]", "Professor of Clinical Medicine"), (r"^ASSOC PROF OF CLIN[-\s]", "Associate Professor of Clinical Medicine"),
    (r"^ASST PROF OF CLIN[-\s]", "Assistant Professor of Clinical Medicine"), (r"^PROF EMERITUS", "Professor Emeritus"), (r"^NON-SENATE ACAD EMERITUS", "Professor Emeritus"),
    (r"^HHMI INVESTIGATOR", "HHMI Investigator"), (r"^LECTURER", "Lecturer"), (r"^SR LECTURER", "Senior Lecturer"), (r"^ADJUNCT PROF[-\s]", "Adjunct Professor"),
    (r"^ACT PROF[-\s]", "Acting Professor"), (r"^PROF IN RES[-\s]", "Professor in Residence"), (r"^ASSOC PROF IN RES[-\s]", "Associate Professor in Residence"),
    (r"^ASST PROF IN RES[-\s]", "Assistant Professor in Residence"), (r"^VISITING", "Visiting Professor"), (r"^COLLEGE PROVOST", "College Provost"),
    (r"^DEAN", "Dean"), (r"^ASSOC DEAN", "Associate Dean"), (r"^ASST DEAN", "Assistant Dean"),
]


def by_pattern(x: Column, patterns: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first pattern that the trimmed upper-case text matches."""
    text = F.upper(F.trim(x))
    return first_match([(text.rlike(p), v) for p, v in patterns], default)


#: The stages of the coverage funnel, in order of display.
STAGES = ["enriched", "sources_dry", "normalizer_no_input", "resolved_not_enriched", "stuck_in_identity_review", "identity_not_found", "no_footprint_or_rejected", "unresolved"]


def funnel_stage(enriched: Column, status: Column, visited: Column, has_input: Column) -> Column:
    """One of STAGES: what has its text is enriched, whatever its status; resolved rows are told
    apart by whether sources were visited and gave anything; others by their status."""
    resolved = status.isin("auto", "confirmed")
    return first_match(
        [
            (~blank(enriched), "enriched"),
            (resolved & visited & has_input, "sources_dry"),
            (resolved & visited, "normalizer_no_input"),
            (resolved, "resolved_not_enriched"),
            (status == "ambiguous", "stuck_in_identity_review"),
            (status == "not_found", "identity_not_found"),
            (status.isin("no_footprint", "rejected"), "no_footprint_or_rejected"),
        ],
        "unresolved",
    )


def division(x: Column, registry: Sequence[dict]) -> Column:
    """struct(slug, label, bundle) by the first entry of ``registry`` that matches: ``equals`` and
    ``contains`` compare in lower case, ``exact`` as it stands. Without one a slug of the text, and
    "other" for a blank."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    low = F.lower(raw)
    entry = lambda s, name, bundle: F.struct(s.alias("slug"), name.alias("label"), F.lit(bundle).alias("bundle"))
    rules = []
    for r in registry:
        holds = F.lit(False)
        for v in r.get("equals", ()):
            holds = holds | (low == v.lower())
        for v in r.get("contains", ()):
            holds = holds | F.contains(low, F.lit(v.lower()))
        for v in r.get("exact", ()):
            holds = holds | F.contains(raw, F.lit(v))
        rules.append((holds, entry(F.lit(r["slug"]), F.lit(r["label"]), r.get("bundle", "default"))))
    rules.append((raw == "", entry(F.lit("other"), F.lit("Other / Unassigned"), "default")))
    return first_match(rules, entry(slug(raw), raw, "default"))


def sources_of(rows: DataFrame, bundles: DataFrame, core: Sequence[str]) -> DataFrame:
    """``rows(bundle, ...)`` with sources: the core ones and those of its bundle (default's if the
    bundle has none), each once, sorted. ``bundles(bundle, source)`` is a dimension."""
    lists = bundles.groupBy("bundle").agg(F.collect_set("source").alias("own"))
    usual = F.array(*(F.lit(c) for c in core)) if core else F.array().cast("array<string>")
    default = lists.where("bundle = 'default'").select(F.col("own").alias("usual_own"))
    joined = rows.join(lists, "bundle", "left").join(default, how="left")
    return joined.withColumn("sources", F.array_sort(F.array_union(usual, F.coalesce("own", "usual_own", F.array().cast("array<string>"))))).drop("own", "usual_own")
