"""The directory: who is shown, what is searched, and pages of it.

People are rows with id, first_name, last_name and department, and as far as a function needs them the
other columns of :mod:`tarnwick.operators.records`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import blank
from tarnwick.operators import ranking
from tarnwick.operators.search import Index, bm25, query_terms

#: The statuses of people who left or are listed twice, and the columns of a curating list.
GONE = ("Inactive", "Duplicate")
CURATED = ["id", "stable_key", "department", "first_name", "last_name", "title", "email", "eah_status", "last_enriched"]

#: The arrays whose entries are a person's keywords, in the order in which they are searched.
KEYWORD_ARRAYS = ["expertise_keywords", "disease_areas", "methodologies", "populations", "committee_service"]


def departments(wanted: str | Iterable[str | None] | None) -> list[str] | None:
    """The departments that a request names; None for all of them (nothing, "" or "all")."""
    if wanted is None or wanted in ("", "all"):
        return None
    named = [wanted] if isinstance(wanted, str) else [d for d in wanted if d and d != "all"]
    return named or None


def department_list(raw: str | None, known: Iterable[str]) -> list[str] | None:
    """The departments of a comma-separated list, None if "all" is among them or it is empty; a name
    that isn't known is refused."""
    named = [part for part in (p.strip().lower() for p in (raw or "").split(",")) if part]
    if not named or "all" in named:
        return None
    if strange := sorted(set(named) - set(known)):
        raise ValueError(f"unknown departments: {', '.join(strange)}")
    return named


def in_departments(people: DataFrame, wanted, column: str = "department") -> DataFrame:
    named = departments(wanted)
    return people if named is None else people.where(F.col(column).isin(*named))


def is_active(status: Column) -> Column:
    return status.isNull() | ~status.isin(*GONE)


def is_named(first: Column, last: Column) -> Column:
    return ~(F.coalesce(first, F.lit("")) == "") & ~(F.coalesce(last, F.lit("")) == "")


def public(people: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Without the divisions that only those who curate see."""
    return people.where(~F.col("department").isin(*excluded)) if excluded else people


def only_fields(people: DataFrame, fields: Sequence[str]) -> Column:
    """A record as JSON with those of ``fields`` that the table has; null ones are left out."""
    return F.to_json(F.struct(*(f for f in fields if f in people.columns)), {"ignoreNullFields": "true"})


def search_document(first: Column, last: Column, title: Column, research: Sequence[Column], arrays: Sequence[Column]) -> Column:
    """struct(name, title, research, keywords): what of a person is searched. Empty texts add nothing;
    the arrays are joined one behind the other."""
    empty = F.array().cast("array<string>")
    name = F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))))
    interests = F.concat_ws(" ", *(F.when(r != "", r) for r in research))
    keywords = F.array_join(F.concat(*(F.coalesce(a, empty) for a in arrays)), " ")
    return F.struct(name.alias("name"), F.coalesce(title, F.lit("")).alias("title"), interests.alias("research"), keywords.alias("keywords"))


def documents(people: DataFrame) -> DataFrame:
    """doc_id and text of every person, for the index. All parts weigh the same, so they are one text."""
    d = search_document(F.col("first_name"), F.col("last_name"), F.col("title"), [F.col("research_interests"), F.col("research_interests_enriched")], [F.col(a) for a in KEYWORD_ARRAYS])
    return people.select(F.col("id").alias("doc_id"), d.alias("d")).select("doc_id", F.concat_ws(" ", "d.name", "d.title", "d.research", "d.keywords").alias("text"))


def matching(people: DataFrame, index: Index, query: str | None) -> tuple[DataFrame, list[Column]]:
    """The people whom a query finds (every one of its words begins one of theirs), and the order in
    which they are shown: by score, and by name where the query has no word."""
    terms = query_terms(query or "")
    if not terms:
        return people, [F.col("last_name"), F.col("first_name"), F.col("id")]
    return people.join(bm25(index, terms).withColumnRenamed("doc_id", "id"), "id"), [F.col("score"), F.col("id")]


def search(people: DataFrame, index: Index, query: str | None = None, wanted=None, excluded: Sequence[str] = (), limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the public directory, and a row with the total. Statistics are the whole index's, so
    a department's filter doesn't change scores."""
    shown = public(in_departments(people, wanted), excluded).where(is_named(F.col("first_name"), F.col("last_name")))
    found, order = matching(shown, index, query)
    return ranking.page(found, order, limit, offset), found.agg(F.count("*").alias("total"))


def curate(people: DataFrame, index: Index, query: str | None = None, wanted=None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """As :func:`search`, of all divisions, unnamed people too, with the columns CURATED."""
    found, order = matching(in_departments(people, wanted), index, query)
    page = ranking.page(found, order, limit, offset)
    return page.select(*(c for c in CURATED if c in page.columns)), found.agg(F.count("*").alias("total"))


def match_pool(people: DataFrame, index: Index, terms: Sequence[str], limit: int = 60) -> DataFrame:
    """id, tier and place of the people for matching, of those in ``people`` who are active and have a
    profile: without terms all of them, by name; all by name if there are at most ``limit``; else the
    best by score, filled up to the limit with others by h-index and name."""
    able = people.where(F.col("has_profile") & is_active(F.col("eah_status")))
    by_name = [F.col("last_name"), F.col("first_name")]
    if not terms:
        return able.orderBy(*by_name, "id").select("id", F.lit(0).alias("tier"), F.lit(None).cast("int").alias("place"))
    # one row, counted no further than the limit; both ways are cut to the limit, and one of them is empty
    few = F.broadcast(able.select("id").limit(limit + 1).agg((F.count("*") <= limit).alias("few")))
    all_ = ranking.numbered(able.orderBy(*by_name, "id").limit(limit), [*by_name, F.col("id")]).select("id", F.lit(0).alias("tier"), "place")
    scored = bm25(index, terms, every=False).withColumnRenamed("doc_id", "id").join(able.select("id"), "id")
    best = ranking.fill_up(scored, able, "id", F.col("score"), [F.col("h_index").desc_nulls_last(), *by_name], limit)
    return all_.crossJoin(few).where("few").drop("few").union(best.crossJoin(few).where("NOT few").drop("few"))


def shown_slices(record: dict[str, Column]) -> dict[str, Column]:
    """What of a person's lists a card shows."""
    most = {"expertise_keywords": 8, "funded_grants": 3, "recent_publications": 3}
    return {name: F.slice(column, 1, most[name]) for name, column in record.items() if name in most}


def has_profile(interests: Column, enriched: Column, keywords: Column) -> Column:
    """Whether there is anything to match a person by."""
    return ~blank(interests) | ~blank(enriched) | (F.coalesce(F.size(keywords), F.lit(0)) > 0)
