"""Matching people to what a call asks for: keywords, a bounded pool, a score, ranks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.text import shortened
from tarnwick.operators.ranking import fill_up
from tarnwick.operators.search import Index, bm25

POOL, RETURNED, LEAST = 60, 15, 40


def pool_counts(people: DataFrame, has_profile: Column) -> DataFrame:
    """How many people can be matched, and how many lack a profile; 0 and 0 for none."""
    return people.agg(F.count_if(has_profile).alias("with_profile"), (F.count("*") - F.count_if(has_profile)).alias("without_profile"))


def candidate_pool(people: DataFrame, index: Index, terms: Sequence[str], has_profile: Column, order: Sequence[Column], limit: int = POOL) -> DataFrame:
    """The best ``limit`` people with a profile for any of the terms, filled up with others by
    ``order``; doc_id, tier and place."""
    scored = bm25(index, terms, every=False).join(people.where(has_profile).select("doc_id"), "doc_id")
    return fill_up(scored, people, "doc_id", F.col("score"), order, limit)


def summary_line(place: Column, name: Column, title: Column, interests: Column, keywords: Column, grants: Column, h_index: Column) -> Column:
    """A person in a line, leaving out what is missing."""
    some = lambda head, x: F.when(x.isNotNull() & (x != ""), F.concat(F.lit(head), x))
    return F.concat_ws(" | ", F.concat(F.lit("ID:"), place.cast("string")), name, some("", title), some("Interests: ", shortened(interests, 300)), some("Keywords: ", F.array_join(F.slice(keywords, 1, 8), ", ")), F.when(grants > 0, F.concat(F.lit("Funded projects: "), grants.cast("string"))), F.when(h_index.isNotNull(), F.concat(F.lit("h-index: "), h_index.cast("string"))))


def rank_matches(scored: DataFrame, pool: DataFrame, most: int = RETURNED, least: int = LEAST) -> DataFrame:
    """``scored(place, score)`` joined to the pool (unknown places vanish), at least ``least``, with
    ranks from 1; ties by place."""
    order = [F.col("score").desc(), F.col("place")]
    best = scored.where(F.col("score") >= least).join(pool, "place").orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def match(people: DataFrame, index: Index, terms: Sequence[str], has_profile: Column, order: Sequence[Column], scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pool, score and rank. ``scorer`` maps the pool to (place, score): a model's reply, or any
    other judgement."""
    pool = candidate_pool(people, index, terms, has_profile, order).withColumn("place", F.row_number().over(Window.orderBy("tier", "place")) - 1)
    return rank_matches(scorer(pool), pool)
