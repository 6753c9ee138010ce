"""What is known of a person as one text, to be summarised: a section for each thing that a source says.

Sources' data are variants, of whatever shape; a rule names what of them is a section. What a source said in
an earlier run, and is stored, stands in where no source has that kind of thing now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many of each kind are shown, how much of an abstract, and how many subject terms.
MOST = {"grants": 10, "publications": 10, "trials": 8, "patents": 8, "awards": 10, "topics": 15, "works": 5}
EXCERPT, SUBJECTS = 200, 5

_GRANT = "array<struct<title:string,agency:string,nsf_program:string,abstract:string,status:string>>"
_PUBLICATION = "array<struct<title:string,journal:string,year:string,mesh_terms:array<string>>>"
_AWARD = "array<struct<name:string,title:string,year:string>>"  # of patents the title is the name
#: Sources of publications that have no form of their own.
PLAIN_SOURCES = ("openalex", "crossref", "dblp", "arxiv", "nasa_ads", "repec", "escholarship")


def _some(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _lines(items: Column, most: int, line) -> Column:
    """A line or more for each of the first items; null for none."""
    return F.nullif(F.array_join(F.flatten(F.transform(F.slice(items, 1, most), line)), "\n"), F.lit(""))


def _bracketed(*parts: Column) -> Column:
    """What there is of some parts, in brackets."""
    inner = F.concat_ws(", ", *(F.when(_some(p), p) for p in parts))
    return F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise("")


def _title(x: Column) -> Column:
    return F.concat(F.lit("- "), F.when(_some(x), x).otherwise("Untitled"))


def grant_lines(grants: Column, agency: str | None = None) -> Column:
    """Titles with who pays, and the beginnings of abstracts."""
    who = lambda g: (g["agency"], F.lit(None).cast("string")) if agency is None else (F.lit(agency), g["nsf_program"])
    line = lambda g: F.concat(F.array(F.concat(_title(g["title"]), _bracketed(*who(g)))), F.when(_some(g["abstract"]), F.array(F.concat(F.lit("  Abstract: "), F.left(g["abstract"], F.lit(EXCERPT))))).otherwise(F.array().cast("array<string>")))
    return _lines(grants, MOST["grants"], line)


def publication_lines(publications: Column, most: int = MOST["publications"], subjects: bool = True) -> Column:
    """Titles with journal and year, and subject terms; a year stands behind a journal only."""
    none = F.array().cast("array<string>")
    where = lambda p: F.when(_some(p["journal"]), _bracketed(p["journal"], p["year"])).otherwise("")
    terms = lambda p: F.when(F.lit(subjects) & (F.coalesce(F.size(p["mesh_terms"]), F.lit(0)) > 0), F.array(F.concat(F.lit("  Subjects: "), F.array_join(F.slice(p["mesh_terms"], 1, SUBJECTS), ", ")))).otherwise(none)
    return _lines(publications, most, lambda p: F.concat(F.array(F.concat(_title(p["title"]), where(p))), terms(p)))


def award_lines(awards: Column, most: int = MOST["awards"]) -> Column:
    return _lines(awards, most, lambda a: F.array(F.concat(F.lit("- "), F.coalesce(a["name"], F.lit("")), _bracketed(a["year"]))))


def _metrics(data: Column, works: str) -> Column:
    number = lambda path, tail: F.concat(F.try_variant_get(data, f"$.{path}", "string"), F.lit(tail))
    return F.nullif(F.concat_ws(", ", F.concat(F.lit("h-index: "), F.try_variant_get(data, "$.h_index", "string")), number(works, f" {'papers' if works == 'paper_count' else 'works'}"), number("citation_count", " citations")), F.lit(""))


def sections(source: Column, data: Column) -> Column:
    """What a source's data have to say, as an array of sections."""
    get = lambda path, kind: F.try_variant_get(data, f"$.{path}", kind)
    grants, publications = get("funded_grants", _GRANT), get("recent_publications", _PUBLICATION)
    headed = lambda title, x: F.concat(F.lit(f"{title}:\n"), x)
    when = lambda holds, x: F.when(holds, x)
    s = lambda *names: source.isin(*names)
    trials = _lines(grants, MOST["trials"], lambda g: F.array(F.concat(_title(g["title"]), F.lit(" ("), F.coalesce(g["status"], F.lit("")), F.lit(")"))))
    topics = F.nullif(F.array_join(F.slice(get("expertise_keywords", "array<string>"), 1, MOST["topics"]), ", "), F.lit(""))
    works = F.nullif(F.array_join(F.transform(F.slice(get("recent_works", "array<string>"), 1, MOST["works"]), lambda w: F.concat(F.lit("- "), w)), "\n"), F.lit(""))
    count = F.nullif(get("works_count", "string"), F.lit("0"))
    every = F.array(
        when(s("profile"), F.concat(F.lit("Profile description: "), F.nullif(get("research_interests_enriched", "string"), F.lit("")))),
        when(s("nih_reporter"), headed("Grants of NIH", grant_lines(grants))),
        when(s("nsf_awards"), headed("Grants of NSF", grant_lines(grants, "NSF"))),
        when(s("pubmed"), headed("Publications in PubMed", publication_lines(publications))),
        when(s("semantic_scholar"), F.concat(F.lit("Semantic Scholar: "), _metrics(data, "paper_count"))),
        when(s("semantic_scholar"), headed("Publications in Semantic Scholar", publication_lines(publications, 8, False))),
        when(s("orcid"), F.concat(F.lit("ORCID: "), count, F.lit(" works"))),
        when(s("orcid") & count.isNotNull(), headed("Works in ORCID", works)),
        when(s("openalex"), F.concat(F.lit("OpenAlex: "), _metrics(data, "works_count"))),
        when(s("openalex"), F.concat(F.lit("Topics: "), topics)),
        when(s(*PLAIN_SOURCES), F.concat(F.lit("Publications ("), F.replace(source, F.lit("_"), F.lit(" ")), F.lit("):\n"), publication_lines(publications))),
        when(s("clinical_trials"), headed("Clinical trials", trials)),
        when(s("patents_view"), headed("Patents", award_lines(F.transform(get("patents", _AWARD), lambda p: p.withField("name", p["title"])), MOST["patents"]))),
        when(s("wikidata"), headed("Honors and awards", award_lines(get("awards", _AWARD)))),
    )
    return F.filter(every, lambda x: x.isNotNull())


#: Sources that give grants, publications, awards and patents, for which stored ones stand in.
KINDS = {
    "grants": ("nih_reporter", "nsf_awards", "clinical_trials"), "publications": ("pubmed", "semantic_scholar", *PLAIN_SOURCES),
    "awards": ("wikidata",), "patents": ("patents_view",),
}


def contexts(people: DataFrame, found: DataFrame) -> DataFrame:
    """person_id and context of ``people(person_id, name, title, research_interests, funded_grants,
    recent_publications, awards, patents)``, the last four as variants, from
    ``found(person_id, pos, source, data)``; null for a person of whom nothing but the name is known."""
    said = found.select("person_id", "pos", "source", sections(F.col("source"), F.col("data")).alias("s")).where(F.size("s") > 0)
    has = lambda field, path: F.coalesce(F.size(F.try_variant_get("data", path, "array<variant>")), F.lit(0)) > 0
    paths = {"grants": "$.funded_grants", "publications": "$.recent_publications", "awards": "$.awards", "patents": "$.patents"}
    flags = found.groupBy("person_id").agg(*(F.bool_or(F.col("source").isin(*KINDS[k]) & has(k, p)).alias(f"_{k}") for k, p in paths.items()))
    parts = said.groupBy("person_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source", "s"))), lambda x: x["s"])).alias("parts"))
    rows = people.join(parts, "person_id", "left").join(flags, "person_id", "left")
    stored = lambda kind, title, x: F.when(~F.coalesce(F.col(f"_{kind}"), F.lit(False)), F.concat(F.lit(f"{title}:\n"), x))
    get = lambda c, kind: F.try_variant_get(c, "$", kind)
    more = F.array(
        stored("grants", "Grants found earlier", grant_lines(get("funded_grants", _GRANT))), stored("publications", "Publications found earlier", publication_lines(get("recent_publications", _PUBLICATION))),
        stored("awards", "Honors and awards", award_lines(get("awards", _AWARD))), stored("patents", "Patents", award_lines(F.transform(get("patents", _AWARD), lambda p: p.withField("name", p["title"])), MOST["patents"])),
    )
    own = F.when(_some(F.col("research_interests")), F.concat(F.lit("Research interests: "), "research_interests"))
    none = F.array().cast("array<string>")
    body = F.filter(F.concat(F.array(own), F.coalesce("parts", none), more), lambda x: x.isNotNull())
    head = F.concat(F.lit("Name: "), "name", F.when(_some(F.col("title")), F.concat(F.lit(", "), "title")).otherwise(""))
    return rows.select("person_id", F.when(F.size(body) > 0, F.array_join(F.concat(F.array(head), body), "\n\n")).alias("context"))
