"""Which record of an external index is a person's: cascades over captured replies, as joins.

Replies are tables: records by id, searches by what was asked. Each step is a join of those people whom
the steps before it left; a step that finds several answers finds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.names import similarity
from tarnwick.functions.text import last_path_part

#: The likeness of names from which a search's hit counts, publications that are tried, papers of
#: a reply, DOIs that are looked up, and fundings that are kept.
NAME, TRIED, PAPERS, DOIS, FUNDINGS = 0.85, 3, 3, 8, 15

#: What is read of an author's record.
AUTHOR = "id string, orcid string, display_name string, display_name_alternatives array<string>"


def named(first: Column, last: Column, names: Column) -> Column:
    """Whether one of the names, by its first and last words, is like a person's."""
    def one(n: Column) -> Column:
        words = F.filter(F.split(F.coalesce(n, F.lit("")), r"\s+"), lambda w: w != "")
        return (F.size(words) >= 2) & (similarity(first, last, F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))) >= NAME)

    return F.coalesce(F.exists(names, one), F.lit(False))


def find_author(people: DataFrame, records: DataFrame, searches: DataFrame) -> DataFrame:
    """person_id, author_id and via of the people whose author record is found: by the stored id, else by
    ORCID, else as the only hit of a search by name whose name fits.

    ``people(person_id, openalex_id, orcid, first, last)``, ``records(payload)`` are captured author
    records, ``searches(person_id, payload)`` the captured replies of searches for a person's name."""
    known = records.select(F.from_json("payload", AUTHOR).alias("a")).where("a.id IS NOT NULL").select(last_path_part(F.col("a.id")).alias("author_id"), last_path_part(F.col("a.orcid")).alias("_orcid"))
    found = lambda df, via: df.select("person_id", "author_id", F.lit(via).alias("via"))
    keyed = people.withColumns({"_id": F.nullif(last_path_part(F.col("openalex_id")), F.lit("")), "_by": F.nullif(last_path_part(F.col("orcid")), F.lit(""))})
    one = found(keyed.join(known.select("author_id").distinct(), F.col("_id") == F.col("author_id")), "id")
    rest = keyed.join(one.select("person_id"), "person_id", "left_anti")
    # an ORCID stands for one record, the first by id
    by_orcid = known.where("_orcid IS NOT NULL").groupBy("_orcid").agg(F.min("author_id").alias("author_id"))
    two = found(rest.join(by_orcid, F.col("_by") == F.col("_orcid")), "orcid")
    rest = rest.join(two.select("person_id"), "person_id", "left_anti").where("coalesce(first, '') <> '' AND coalesce(last, '') <> ''")
    hits = searches.select("person_id", F.explode(F.from_json("payload", f"results array<struct<{AUTHOR.replace(' string', ':string').replace(' array', ':array')}>>")["results"]).alias("a"))
    fits = hits.join(rest, "person_id").where(named(F.col("first"), F.col("last"), F.concat(F.array("a.display_name"), F.coalesce("a.display_name_alternatives", F.array().cast("array<string>")))))
    only = fits.groupBy("person_id").agg(F.count("*").alias("n"), F.first(last_path_part(F.col("a.id"))).alias("author_id")).where("n = 1")
    return one.union(two).union(found(only, "name"))


def author_by_papers(people: DataFrame, searches: DataFrame) -> DataFrame:
    """person_id and author_id of the people who are found among the authors of their own papers.

    ``people(person_id, first, last, orcid, titles)``, ``searches(title, payload)`` the captured replies of
    searches by title. The first three titles are tried in turn, of each the first three papers and their
    authors in order; one with the person's ORCID counts, or one whose name has the last name in it and
    begins with the first one's initial."""
    asked = people.select("person_id", F.lower("first").alias("first"), F.lower("last").alias("last"), "orcid", F.posexplode(F.slice("titles", 1, TRIED)).alias("nth", "title")).where("coalesce(title, '') <> ''")
    papers = searches.select("title", F.slice(F.from_json("payload", "data array<struct<authors:array<struct<authorId:string,name:string,externalIds:struct<ORCID:string>>>>>")["data"], 1, PAPERS).alias("papers"))
    rows = asked.join(papers, "title").select("*", F.posexplode("papers").alias("paper", "p")).select("*", F.posexplode("p.authors").alias("place", "a"))
    name = F.lower(F.coalesce("a.name", F.lit("")))
    by_name = (F.coalesce("first", F.lit("")) != "") & (F.coalesce("last", F.lit("")) != "") & F.contains(name, F.col("last")) & F.startswith(name, F.left("first", F.lit(1)))
    same = F.coalesce(F.col("orcid") == F.col("a.externalIds.ORCID"), F.lit(False)) & (F.coalesce("orcid", F.lit("")) != "")
    order = F.struct("nth", "paper", "place")
    return rows.where(same | by_name).groupBy("person_id").agg(F.min_by("a.authorId", order).alias("author_id"))


def fundings_of_works(people: DataFrame, works: DataFrame) -> DataFrame:
    """person_id, place, agency and awards: who funded the works of the people's first eight DOIs, each
    funder with its awards once, in the order of the DOIs, at most fifteen.

    ``people(person_id, dois)``, ``works(doi, payload)`` the captured records of works."""
    clean = F.filter(F.transform("dois", lambda d: F.trim(d)), lambda d: F.coalesce(d != "", F.lit(False)))
    asked = people.select("person_id", F.posexplode(F.slice(clean, 1, DOIS)).alias("nth", "doi"))
    funders = works.select("doi", F.from_json("payload", "message struct<funder:array<struct<name:string,award:array<string>>>>")["message"]["funder"].alias("funders"))
    rows = asked.join(funders, "doi").select("person_id", "nth", F.posexplode("funders").alias("at", "f")).where("coalesce(f.name, '') <> ''")
    rows = rows.select("person_id", "nth", "at", F.col("f.name").alias("agency"), F.slice(F.coalesce("f.award", F.array().cast("array<string>")), 1, 5).alias("awards"))
    once = Window.partitionBy("person_id", F.lower("agency"), "awards").orderBy("nth", "at")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1")
    place = F.row_number().over(Window.partitionBy("person_id").orderBy("nth", "at"))
    return rows.withColumn("place", place).where(F.col("place") <= FUNDINGS).select("person_id", "place", "agency", "awards")
