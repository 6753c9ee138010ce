"""Confidence-ordered merging of what several sources say about one record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.text import title_key

#: How many entries of each list are kept.
CAPS = {"funded_grants": 25, "recent_publications": 20, "expertise_keywords": 30, "awards": 20, "patents": 20}


def entry_key(field: Column, title: Column, doi: Column, number: Column, year: Column, agency: Column) -> Column:
    """What makes two entries of a list the same: for publications the DOI or title, for grants the
    title or agency, for patents the number or title, for awards name and year; else the text."""
    return _named_key(field, title_key(title), doi, number, year, agency)


def _named_key(field: Column, name: Column, doi: Column, number: Column, year: Column, agency: Column) -> Column:
    some = lambda x: F.nullif(x, F.lit(""))
    return (
        F.when(field == "recent_publications", F.coalesce(F.concat(F.lit("doi:"), F.lower(some(doi))), F.concat(F.lit("title:"), name)))
        .when(field == "funded_grants", F.coalesce(some(name), title_key(agency)))
        .when(field == "patents", F.coalesce(some(number), name))
        .when(field == "awards", F.concat(name, F.coalesce(year.cast("string"), F.lit(""))))
        .otherwise(name)
    )


def merge_lists(rows: DataFrame, by: Sequence[str], key: str, order: Sequence[Column], output_order: Sequence[Column], cap: int) -> DataFrame:
    """Of ``rows`` with equal ``by`` and ``key`` the first by ``order`` (blank keys go), then the
    first ``cap`` of each ``by`` by ``output_order``, with their place."""
    first = rows.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*output_order))).where(F.col("place") <= cap)


def _parts(field: Column, entry: Column) -> dict[str, Column]:
    """What the key of a list's entries is made of: conditions, so that no more is taken out of a variant than the
    key of its field has. Of other lists an object is its JSON."""
    part = lambda c: F.try_variant_get(entry, f"$.{c}", "string")
    title = F.when(field == "awards", part("name")).when(field.isin("recent_publications", "funded_grants", "patents"), part("title")).otherwise(F.to_json(entry))
    title = F.when(F.startswith(F.schema_of_variant(entry), F.lit("OBJECT")), title).otherwise(F.try_variant_get(entry, "$", "string"))
    # a text or an array has none of these
    of = lambda kind, c: F.when(field == kind, part(c))
    return {"title": title, "doi": of("recent_publications", "doi"), "number": of("patents", "patent_number"), "year": of("awards", "year"), "agency": of("funded_grants", "agency")}


def variant_key(field: Column, entry: Column) -> Column:
    """:func:`entry_key` of an entry of any shape: an object with the fields that its kind has, or a text."""
    parts = F.struct(*(part.alias(name) for name, part in _parts(field, entry).items()))
    # in an array of one, so that the parts are taken out of the variant once
    return F.get(F.transform(F.array(parts), lambda x: entry_key(field, *(x[c] for c in ("title", "doi", "number", "year", "agency")))), F.lit(0))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` as for :func:`merge_entries` with what it takes from the entries: their keys, and the years
    of publications. The parts of a key are columns of their own before, so each is taken out once."""
    parts = _parts(F.col("field"), F.col("entry"))
    rows = rows.withColumns({f"_{name}": part for name, part in parts.items()}).withColumn("_title", title_key(F.col("_title")))
    year = F.when(F.col("field") == "recent_publications", F.coalesce(F.try_variant_get("entry", "$.year", "int"), F.lit(0)))
    return rows.withColumns({"key": _named_key(F.col("field"), *(F.col(f"_{name}") for name in parts)), "year": year}).drop(*(f"_{name}" for name in parts))


def merge_entries(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows(*by, field, source, confidence, pos, entry)``, the entry a variant of whatever shape its
    source has, as *by, field, place, entry, sources: of entries with one key the most confident
    source's, in the order of confidence, source and place (publications by falling year first), as many
    as the field keeps. ``sources`` are all that have the entry."""
    return merge_keyed(keyed(rows), by).drop("key")


def merge_keyed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`merge_entries` of :func:`keyed` rows, whose entries may be of any type, with their keys."""
    order = [F.col("confidence").desc(), F.col("source"), F.col("pos")]
    same = Window.partitionBy(*by, "field", "key")
    # blank keys go by their number: a condition on the key alone would be pushed down, and the key made again for it
    number = F.when(~F.coalesce("key", F.lit("")).isin("", "title:"), F.row_number().over(same.orderBy(*order)))
    first = rows.withColumns({"_n": number, "sources": F.array_sort(F.collect_set("source").over(same))}).where("_n = 1")
    cap = F.lit(20)
    for field, most in CAPS.items():
        cap = F.when(F.col("field") == field, most).otherwise(cap)
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*by, "field").orderBy(F.col("year").desc_nulls_last(), *order)))
    return placed.where(F.col("place") <= cap).select(*by, "field", "place", "entry", "sources", "key")


def provenance(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """What the log says of each field that ``rows`` (as for :func:`merge_entries`) fill: source_name, that
    of the most confident source, with +merge if there are several, and its confidence."""
    best = F.struct((-F.col("confidence")).alias("c"), F.col("source").alias("s"))
    grouped = rows.groupBy(*by, "field").agg(F.min(best).alias("best"), F.count_distinct("source").alias("n"))
    return grouped.select(*by, "field", F.concat("best.s", F.when(F.col("n") > 1, "+merge").otherwise("")).alias("source_name"), (-F.col("best.c")).alias("confidence"))


def merge_scalars(rows: DataFrame, by: Sequence[str], confidence: str, source: str, fields: Sequence[str]) -> DataFrame:
    """For each field the value of the most confident source that has one (the empty string is
    none), ties by the source's name; one aggregation, combined before the shuffle."""
    some = lambda f: F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.struct((-F.col(confidence)).alias("c"), F.col(source).alias("s")))
    return rows.groupBy(*by).agg(*(F.min_by(f, some(f)).alias(f) for f in fields))


def fold_profiles(rows: DataFrame, by: Sequence[str], total: Sequence[str], most: Sequence[str]) -> DataFrame:
    """One row for several profiles of one person: sums of ``total``, maxima of ``most``."""
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in total), *(F.max(c).alias(c) for c in most))


def changed(new: DataFrame, old: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows of ``new`` whose content's SHA-256 isn't what ``old(key, raw_hash)`` has for the key."""
    hashed = new.withColumn("raw_hash", F.sha2(content, 256))
    return hashed.join(old.select(key, "raw_hash"), [key, "raw_hash"], "left_anti")


def context(sections: Sequence[tuple[str, Column]]) -> Column:
    """The non-blank sections under their headings, with an empty line between; null without any."""
    parts = [F.when((c.isNotNull()) & (c != ""), F.concat(F.lit(f"## {title}\n"), c)) for title, c in sections]
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit(""))


def publication_lines(pubs: Column, most: int = 10) -> Column:
    """A line for each of the first publications: title, year and journal as far as known."""
    line = lambda p: F.concat_ws(", ", F.concat(F.lit("- "), p["title"]), p["year"].cast("string"), p["journal"])
    return F.array_join(F.transform(F.slice(pubs, 1, most), line), "\n")


def change_log(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A row for each field that differs, null-safe: key, field_updated, old_value, new_value."""
    pairs = before.alias("b").join(after.alias("a"), key)
    entries = F.array(*(F.struct(F.lit(f).alias("field_updated"), F.col(f"b.{f}").cast("string").alias("old_value"), F.col(f"a.{f}").cast("string").alias("new_value")) for f in fields))
    return pairs.select(key, F.explode(entries).alias("e")).where(~F.col("e.old_value").eqNullSafe(F.col("e.new_value"))).select(key, "e.*")
