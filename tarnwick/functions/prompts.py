"""Texts that are put to a model or a reader: records, candidates and questions, line by line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.rules import first_match

#: How much of each part is shown.
INTERESTS, ALTERNATIVES, TOPICS, AFFILIATIONS, REGISTER_AFFILIATIONS, WORKS, FUNDINGS = 400, 6, 10, 6, 8, 10, 5


def _line(head: str, x: Column) -> Column:
    """A line, or null where there is nothing to say."""
    return F.when(x.isNotNull() & (x != ""), F.concat(F.lit(head), x))


def _listed(items: Column, most: int) -> Column:
    return F.array_join(F.slice(items, 1, most), "; ")


def person_block(first: Column, last: Column, title: Column, division: Column, email: Column, interests: Column) -> Column:
    """Who is looked for. Of the address only the domain is shown."""
    name = F.trim(F.concat_ws(" ", first, last))
    domain = F.when(F.contains(email, F.lit("@")), F.regexp_extract(email, "^[^@]*@(.*)$", 1))
    about = F.left(F.regexp_replace(interests, r"(?U)^\s+|\s+$", ""), F.lit(INTERESTS))
    return F.concat_ws("\n", F.lit("PERSON (from the roster):"), F.concat(F.lit("Name: "), name), _line("Title: ", title), _line("Division or school: ", division), _line("Email domain: ", domain), _line("Research interests: ", about))


def work_line(work: Column) -> Column:
    """A work as "- title (year, journal)"."""
    year = F.when(work["year"].isNotNull() & (work["year"] != 0), F.concat(F.lit(" ("), work["year"].cast("string"), F.when(F.coalesce(work["journal"], F.lit("")) != "", F.concat(F.lit(", "), work["journal"])).otherwise(""), F.lit(")")))
    return F.concat(F.lit("- "), F.coalesce(work["title"], F.lit("?")), F.coalesce(year, F.lit("")))


def candidate_block(number: Column, c: Column) -> Column:
    """A profile of the author index: ``c`` has external_id, display_name, alternatives, cluster_size,
    score, name_similarity, current, listed, works_count, citations, topics, affiliations, orcid and
    works (structs of title, year and journal)."""
    others = F.when(F.coalesce(F.size(c["alternatives"]), F.lit(0)) > 0, F.concat(F.lit(" (also published as: "), _listed(c["alternatives"], ALTERNATIVES), F.lit(")")))
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), "yes").otherwise("no")
    evidence = F.concat_ws(", ", F.concat(F.lit("score="), c["score"].cast("string")), F.concat(F.lit("name_similarity="), c["name_similarity"].cast("string")), F.concat(F.lit("current="), yes(c["current"])), F.concat(F.lit("listed="), yes(c["listed"])))
    output = F.when(c["works_count"].isNotNull() | c["citations"].isNotNull(), F.concat(F.coalesce(c["works_count"], F.lit(0)).cast("string"), F.lit(" works, "), F.coalesce(c["citations"], F.lit(0)).cast("string"), F.lit(" citations")))
    works = F.array_join(F.transform(F.slice(c["works"], 1, WORKS), work_line), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CANDIDATE "), number.cast("string"), F.lit(":")),
        F.concat(F.lit("Profile: "), c["external_id"]),
        F.concat(F.lit("Shown name: "), F.coalesce(c["display_name"], F.lit("?")), F.coalesce(others, F.lit(""))),
        F.when(F.coalesce(c["cluster_size"], F.lit(1)) > 1, F.concat(F.lit("Stands for "), c["cluster_size"].cast("string"), F.lit(" profiles of one person."))),
        F.concat(F.lit("Evidence: "), evidence),
        _line("Output: ", output),
        _line("Topics: ", _listed(c["topics"], TOPICS)),
        _line("Affiliations: ", _listed(c["affiliations"], AFFILIATIONS)),
        F.concat(F.lit("ORCID on the profile: "), F.when(F.coalesce(c["orcid"], F.lit("")) != "", "yes").otherwise("no")),
        _line("Recent works:\n", works),
    )


def register_block(number: Column, c: Column) -> Column:
    """A record of the person register: orcid, names, unique_hit, employed, name_similarity, email_match,
    employments, fundings and works."""
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), "yes").otherwise("no")
    checks = F.concat_ws(", ", F.concat(F.lit("only hit="), yes(c["unique_hit"])), F.concat(F.lit("employed="), yes(c["employed"])), F.concat(F.lit("name_similarity="), c["name_similarity"].cast("string")), F.concat(F.lit("email match="), yes(c["email_match"])))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CANDIDATE "), number.cast("string"), F.lit(":")),
        F.concat(F.lit("ORCID: "), c["orcid"]),
        _line("Names: ", F.array_join(c["names"], "; ")),
        F.concat(F.lit("Checks: "), checks),
        _line("Affiliations: ", _listed(c["employments"], REGISTER_AFFILIATIONS)),
        _line("Fundings: ", _listed(c["fundings"], FUNDINGS)),
        _line("Works:\n", F.array_join(F.transform(F.slice(c["works"], 1, WORKS), work_line), "\n")),
    )


def candidate_blocks(candidates: Column, seed: str | None = None) -> Column:
    """The blocks of all candidates, numbered in their order, or in one that ``seed`` fixes: by a hash
    of it and their ids, the same for every run."""
    if seed is not None:
        keyed = F.transform(candidates, lambda c: F.struct(F.xxhash64(F.lit(seed), c["external_id"]).alias("h"), c.alias("c")))
        candidates = F.transform(F.array_sort(keyed, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)), lambda x: x["c"])
    return F.transform(candidates, lambda c, i: candidate_block(i + 1, c))


def question(person: Column, blocks: Column) -> Column:
    return F.concat_ws("\n\n", person, F.array_join(blocks, "\n\n"), F.lit("Is exactly one of these candidates certainly this person? Answer with the verdict as JSON alone."))


def year_span(years: Column) -> Column:
    """"first-last" of an affiliation's years, one year alone, or null."""
    low, high = F.array_min(years), F.array_max(years)
    return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def affiliation_history(affiliations: Column, most: int = AFFILIATIONS) -> Column:
    """"name (years)" of an author's affiliations(institution, years), as many as are shown."""
    named = F.filter(affiliations, lambda a: F.coalesce(a["institution"], F.lit("")) != "")
    return F.slice(F.transform(named, lambda a: F.concat(a["institution"], F.coalesce(F.concat(F.lit(" ("), year_span(a["years"]), F.lit(")")), F.lit("")))), 1, most)


def context(sections: Sequence[tuple[str, Column]], stored: Sequence[tuple[str, Column]], name: Column) -> Column:
    """A person's material for a summary: a section for each source that has text, then stored texts that
    no section contains already; null where there is nothing but the name."""
    present = [F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), x)) for title, x in sections]
    body = F.concat_ws("\n\n", *present)
    for title, x in stored:
        new = (F.coalesce(x, F.lit("")) != "") & ~F.contains(body, x)
        body = F.when(new, F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.concat(F.lit(f"## {title}\n"), x))).otherwise(body)
    return F.when(body != "", F.concat(F.lit("Name: "), name, F.lit("\n\n"), body))


def friendly_error(message: Column, known: Sequence[tuple[str, str]], default: str) -> Column:
    """What a user is told: by the first of ``known`` (part, text) that the message contains."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return first_match([(F.contains(low, F.lit(part.lower())), text) for part, text in known], default)


#: Titles and degrees in listings, in the order in which they are tried.
LISTED_TITLES = ["Professor", "Associate Professor", "Assistant Professor", "Adjunct Professor", "Professor Emeritus", "Professor Emerita", "Research Scientist", "Senior Lecturer", "Lecturer", "Distinguished Professor"]
LISTED_DEGREES = ["PhD", "MD", "MS", "BS", "BA", "MA", "MPH", "DrPH", "ScD", "JD", "MBA"]


def listing_entry(line: Column, titles: Sequence[str] = LISTED_TITLES, degrees: Sequence[str] = LISTED_DEGREES) -> Column:
    """struct(first, last, title, degrees) of a listing's line "Last, First Middle, DEGREES, Title", null
    for what is no person: under 5 or over 500 characters, without a comma, a name or one of ``titles``,
    or with a digit in the last name. The first title in their order counts; degrees, with dots or
    without and wherever they stand, are upper case without dots, each once."""
    t = F.coalesce(line, F.lit(""))
    title = first_match([(F.contains(F.lower(t), F.lit(x.lower())), x) for x in titles])
    parts = F.transform(F.split(t, ","), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
    first = F.coalesce(F.get(F.split(F.get(parts, F.lit(1)), " "), F.lit(0)), F.lit(""))
    last = F.get(parts, F.lit(0))
    dotted = ("".join(c + r"\.?" if k + 1 == len(d) or d[k + 1].isupper() else c for k, c in enumerate(d)) for d in degrees)
    found = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(rf"(?i)\b({'|'.join(dotted)})\b"), F.lit(1)), lambda x: F.upper(F.replace(x, F.lit("."), F.lit("")))))
    ok = F.length(t).between(5, 500) & F.contains(t, F.lit(",")) & title.isNotNull() & (first != "") & (last != "") & ~last.rlike(r"\d")
    return F.when(ok, F.struct(first.alias("first"), last.alias("last"), title.alias("title"), found.alias("degrees")))


def listed_once(entries: DataFrame, pos: str) -> DataFrame:
    """Of ``entries(first, last, ...)`` the first row by ``pos`` of each name, in any case."""
    order = Window.partitionBy(F.lower("first"), F.lower("last")).orderBy(pos)
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
