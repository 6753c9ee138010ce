"""Payloads captured from external indexes, as typed columns.

Each function maps a column of raw payloads (JSON or XML text) to what the merge needs. Fetching is
not part of the engine: payloads are a table with a source and a record's id, written by whatever
fetches them. Malformed payloads give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUBLICATION = "struct<title:string,year:int,journal:string,doi:string,citations:int,abstract:string>"
GRANT = "struct<title:string,agency:string,amount:string,start_date:string,end_date:string,project_number:string,abstract:string,co_pis:array<string>>"

#: Confidence in each source, which orders merging.
CONFIDENCE = {"profile": 1.0, "orcid": 0.9, "openalex": 0.85, "nih_reporter": 0.8, "nsf_awards": 0.8, "clinical_trials": 0.8, "patents": 0.8, "wikidata": 0.8, "nasa_ads": 0.8, "semantic_scholar": 0.75, "dblp": 0.75, "repository": 0.75, "pubmed": 0.7, "crossref": 0.7, "repec": 0.7, "arxiv": 0.65, "email_pattern": 0.5}


def _cast(items: Column, kind: str) -> Column:
    return items.cast(f"array<{kind}>")


def openalex_author(raw: Column) -> Column:
    """Keywords (the first 15 topics), counts and names of an author object."""
    a = F.from_json(raw, "id string, display_name string, display_name_alternatives array<string>, orcid string, works_count bigint, cited_by_count bigint, summary_stats struct<h_index:bigint>, topics array<struct<display_name:string,domain:struct<display_name:string>>>")
    domains = F.array_distinct(F.filter(F.transform(F.slice(a["topics"], 1, 10), lambda t: t["domain"]["display_name"]), lambda d: d.isNotNull()))
    return F.struct(F.element_at(F.split(a["id"], "/"), -1).alias("openalex_id"), F.concat(F.array(a["display_name"]), F.coalesce(a["display_name_alternatives"], F.array().cast("array<string>"))).alias("names"), F.element_at(F.split(a["orcid"], "/"), -1).alias("orcid"), a["works_count"].alias("works_count"), a["cited_by_count"].alias("citation_count"), a["summary_stats"]["h_index"].alias("h_index"), F.transform(F.slice(a["topics"], 1, 15), lambda t: t["display_name"]).alias("expertise_keywords"), domains.alias("domains"))


def openalex_works(raw: Column, most: int = 20) -> Column:
    w = F.from_json(raw, "results array<struct<title:string,publication_year:int,doi:string,cited_by_count:int,primary_location:struct<source:struct<display_name:string>>>>")
    return _cast(F.transform(F.slice(w["results"], 1, most), lambda x: F.struct(x["title"].alias("title"), x["publication_year"].alias("year"), x["primary_location"]["source"]["display_name"].alias("journal"), F.regexp_replace(x["doi"], r"^https?://(dx\.)?doi\.org/", "").alias("doi"), x["cited_by_count"].alias("citations"), F.lit(None).cast("string").alias("abstract"))), PUBLICATION)


def orcid_organisations(raw: Column) -> Column:
    """Names of all employers, then of all schools, of an ORCID record."""
    group = "array<struct<summaries:array<struct<{0}:struct<organization:struct<name:string>>>>>>"
    r = F.from_json(raw, f"`activities-summary` struct<employments:struct<`affiliation-group`:{group.format('`employment-summary`')}>,educations:struct<`affiliation-group`:{group.format('`education-summary`')}>>")["activities-summary"]
    names = lambda part, key: F.flatten(F.transform(F.coalesce(r[part]["affiliation-group"], F.array()), lambda g: F.transform(g["summaries"], lambda s: s[key]["organization"]["name"])))
    return F.struct(names("employments", "employment-summary").alias("employers"), names("educations", "education-summary").alias("schools"))


def orcid_distinctions(raw: Column, most: int = 20) -> Column:
    """Awards of an ORCID record's first groups: name, the organisation that grants it, year."""
    kind = "`role-title`:string,organization:struct<name:string>,`start-date`:struct<year:struct<value:string>>"
    groups = F.from_json(raw, f"`activities-summary` struct<distinctions:struct<`affiliation-group`:array<struct<summaries:array<struct<`distinction-summary`:struct<{kind}>>>>>>>")["activities-summary"]["distinctions"]["affiliation-group"]
    every = F.flatten(F.transform(F.slice(groups, 1, most), lambda g: F.transform(F.coalesce(g["summaries"], F.array()), lambda s: s["distinction-summary"])))
    rows = F.transform(every, lambda d: F.struct(F.trim(F.coalesce(d["role-title"], F.lit(""))).alias("name"), d["organization"]["name"].alias("granting_org"), d["start-date"]["year"]["value"].try_cast("int").alias("year")))
    return F.filter(rows, lambda r: r["name"] != "")


def orcid_fundings(raw: Column, most: int = 15) -> Column:
    """Grants of an ORCID record's first groups that have a title, by each one's first summary."""
    kind = "title:struct<title:struct<value:string>>,organization:struct<name:string>,`start-date`:struct<year:struct<value:string>>,`end-date`:struct<year:struct<value:string>>"
    groups = F.from_json(raw, f"`activities-summary` struct<fundings:struct<group:array<struct<`funding-summary`:array<struct<{kind}>>>>>>")["activities-summary"]["fundings"]["group"]
    first = F.transform(F.slice(groups, 1, most), lambda g: F.get(g["funding-summary"], F.lit(0)))
    rows = F.transform(first, lambda x: F.struct(x["title"]["title"]["value"].alias("title"), x["organization"]["name"].alias("agency"), x["start-date"]["year"]["value"].alias("start_date"), x["end-date"]["year"]["value"].alias("end_date")))
    return F.filter(rows, lambda r: F.coalesce(r["title"], F.lit("")) != "")


def mentions(names: Column, organisations: tuple[str, ...]) -> Column:
    """Whether any of the names contains one of the organisations, in lower case."""
    return F.exists(names, lambda n: F.exists(F.array(*(F.lit(o.lower()) for o in organisations)), lambda o: F.contains(F.lower(n), o)))


def nih_grants(raw: Column, last: Column, most: int = 25) -> Column:
    r = F.from_json(raw, "results array<struct<project_title:string,abstract_text:string,award_amount:string,project_start_date:string,project_end_date:string,project_num:string,agency_ic_admin:struct<abbreviation:string>,principal_investigators:array<struct<full_name:string,last_name:string>>>>")
    def one(g: Column) -> Column:
        others = F.filter(F.coalesce(g["principal_investigators"], F.array()), lambda p: F.lower(p["last_name"]) != F.lower(last))
        return F.struct(g["project_title"].alias("title"), F.coalesce(g["agency_ic_admin"]["abbreviation"], F.lit("NIH")).alias("agency"), g["award_amount"].alias("amount"), g["project_start_date"].alias("start_date"), g["project_end_date"].alias("end_date"), g["project_num"].alias("project_number"), F.left(g["abstract_text"], F.lit(500)).alias("abstract"), F.transform(others, lambda p: p["full_name"]).alias("co_pis"))

    return _cast(F.transform(F.slice(r["results"], 1, most), one), GRANT)


def _plain(markup: Column) -> Column:
    """Text without the marks in it, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", ""), r"\s+", " "))


def pubmed_articles(raw: Column, most: int = 20) -> Column:
    """Publications of an article set in XML, each from its own element, so that what one lacks is not
    taken from the next."""
    article = "struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,ELocationID:array<struct<_EIdType:string,_VALUE:string>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>>"
    found = F.from_xml(raw, f"PubmedArticle array<struct<MedlineCitation:struct<Article:{article}>>>")["PubmedArticle"]
    def one(x: Column) -> Column:
        a = x["MedlineCitation"]["Article"]
        doi = F.get(F.filter(F.coalesce(a["ELocationID"], F.array()), lambda e: e["_EIdType"] == "doi"), F.lit(0))["_VALUE"]
        return F.struct(_plain(a["ArticleTitle"]).alias("title"), a["Journal"]["JournalIssue"]["PubDate"]["Year"].try_cast("int").alias("year"), _plain(a["Journal"]["Title"]).alias("journal"), doi.alias("doi"), F.lit(None).cast("int").alias("citations"), F.array_join(F.transform(a["Abstract"]["AbstractText"], _plain), " ").alias("abstract"))

    return _cast(F.slice(F.transform(found, one), 1, most), PUBLICATION)


def arxiv_entries(raw: Column, full_name: Column, most: int = 15) -> Column:
    """title, year and authors of the entries of an Atom feed one of whose authors has exactly this name,
    blanks collapsed."""
    entries = F.from_xml(raw, "entry array<struct<title:string,published:string,author:array<struct<name:string>>>>")["entry"]
    rows = F.transform(entries, lambda e: F.struct(_plain(e["title"]).alias("title"), F.left(F.trim(e["published"]), F.lit(4)).try_cast("int").alias("year"), F.transform(e["author"], lambda a: _plain(a["name"])).alias("authors")))
    return F.slice(F.filter(rows, lambda r: F.exists(r["authors"], lambda a: F.lower(a) == F.lower(_plain(full_name)))), 1, most)


def dblp_author(raw: Column, full_name: Column) -> Column:
    """The one hit of an author search with this name, as it is listed (namesakes have a number behind
    their names); null if there is none, or if several people have the name."""
    hits = F.from_json(raw, "result struct<hits:struct<hit:array<struct<info:struct<author:string,url:string>>>>>")["result"]["hits"]["hit"]
    listed = F.transform(hits, lambda h: F.trim(h["info"]["author"]))
    same = F.filter(listed, lambda a: F.lower(F.regexp_replace(a, r" \d+$", "")) == F.lower(F.trim(full_name)))
    return F.when(F.size(same) == 1, F.get(same, F.lit(0)))


def trials(raw: Column, name: Column, organisation: str, most: int = 10) -> Column:
    """Studies one of whose officials has both the name and the organisation."""
    s = F.from_json(raw, "studies array<struct<nct_id:string,title:string,status:string,start_date:string,officials:array<struct<name:string,affiliation:string>>>>")["studies"]
    fits = lambda st: F.exists(st["officials"], lambda o: F.contains(F.lower(o["name"]), F.lower(name)) & F.contains(F.lower(o["affiliation"]), F.lit(organisation.lower())))
    return F.slice(F.filter(s, fits), 1, most)


def crossref_funders(raw: Column, most: int = 15) -> Column:
    """Distinct funders (lower-case name and award numbers) of a work, five awards each."""
    f = F.from_json(raw, "message struct<funder:array<struct<name:string,award:array<string>>>>")["message"]["funder"]
    return F.slice(F.array_distinct(F.transform(f, lambda x: F.struct(F.lower(x["name"]).alias("agency"), F.slice(F.coalesce(x["award"], F.array().cast("array<string>")), 1, 5).alias("awards")))), 1, most)


def openalex_works_of(ids: Column) -> Column:
    """One filter for the works of a primary profile and its alternates: ids joined by |."""
    return F.array_join(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != ""))), "|")


def orcid_works(raw: Column, most: int = 20) -> Column:
    """Publications of an ORCID record; the first DOI among a work's identifiers."""
    w = F.from_json(raw, "`activities-summary` struct<works:struct<group:array<struct<`work-summary`:array<struct<title:struct<title:struct<value:string>>,`publication-date`:struct<year:struct<value:string>>,`journal-title`:struct<value:string>,`external-ids`:struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string>>>>>>>>>")["activities-summary"]["works"]["group"]
    def one(g: Column) -> Column:
        s = F.get(g["work-summary"], F.lit(0))
        dois = F.filter(F.coalesce(s["external-ids"]["external-id"], F.array()), lambda e: e["external-id-type"] == "doi")
        return F.struct(s["title"]["title"]["value"].alias("title"), s["publication-date"]["year"]["value"].try_cast("int").alias("year"), s["journal-title"]["value"].alias("journal"), F.get(dois, F.lit(0))["external-id-value"].alias("doi"), F.lit(None).cast("int").alias("citations"), F.lit(None).cast("string").alias("abstract"))

    return _cast(F.slice(F.transform(w, one), 1, most), PUBLICATION)


def nsf_grants(raw: Column, last: Column, most: int = 25) -> Column:
    """Awards; other investigators are those whose name doesn't contain the person's last name."""
    r = F.from_json(raw, "response struct<award:array<struct<id:string,title:string,abstractText:string,fundsObligatedAmt:string,startDate:string,expDate:string,coPDPI:string>>>")["response"]["award"]
    def one(a: Column) -> Column:
        listed = F.when(F.startswith(a["coPDPI"], F.lit("[")), F.from_json(a["coPDPI"], "array<string>")).otherwise(F.array(a["coPDPI"]))
        others = F.filter(listed, lambda n: n.isNotNull() & ~F.contains(F.lower(n), F.lower(last)))
        return F.struct(a["title"].alias("title"), F.lit("NSF").alias("agency"), a["fundsObligatedAmt"].alias("amount"), a["startDate"].alias("start_date"), a["expDate"].alias("end_date"), a["id"].alias("project_number"), F.left(a["abstractText"], F.lit(500)).alias("abstract"), F.coalesce(others, F.array().cast("array<string>")).alias("co_pis"))

    return _cast(F.slice(F.transform(r, one), 1, most), GRANT)


def semantic_author(raw: Column, orcid: Column, name: Column, keywords: tuple[str, ...]) -> Column:
    """The author id of a search: one with the same ORCID, else one with a fitting affiliation, else
    the first whose name contains the person's and who has more than five papers."""
    hits = F.from_json(raw, "data array<struct<authorId:string,name:string,paperCount:int,affiliations:array<string>,externalIds:struct<ORCID:string>>>")["data"]
    first = lambda keep: F.get(F.filter(hits, keep), F.lit(0))["authorId"]
    same = first(lambda h: h["externalIds"]["ORCID"] == orcid)
    near = first(lambda h: mentions(F.coalesce(h["affiliations"], F.array().cast("array<string>")), keywords))
    named = first(lambda h: (F.contains(F.lower(h["name"]), F.lower(name)) | F.contains(F.lower(name), F.lower(h["name"]))) & (h["paperCount"] > 5))
    return F.coalesce(same, near, named)


def patents(raw: Column, organisations: tuple[str, ...], most: int = 20) -> Column:
    """Patents with an assignee that contains one of the organisations."""
    p = F.from_json(raw, "patents array<struct<patent_id:string,patent_title:string,patent_date:string,assignees:array<struct<assignee_organization:string>>>>")["patents"]
    owners = lambda x: F.transform(F.coalesce(x["assignees"], F.array()), lambda a: a["assignee_organization"])
    kept = F.filter(p, lambda x: mentions(owners(x), organisations))
    return F.slice(F.transform(kept, lambda x: F.struct(x["patent_title"].alias("title"), x["patent_id"].alias("patent_number"), F.get(owners(x), F.lit(0)).alias("assignee"), F.left(x["patent_date"], F.lit(4)).try_cast("int").alias("year"))), 1, most)


def ads_papers(raw: Column, most: int = 15) -> Column:
    """Papers whose title and DOI may be a list or a plain string."""
    d = F.from_json(raw, "response struct<docs:array<struct<title:string,year:string,pub:string,doi:string,citation_count:int>>>")["response"]["docs"]
    scalar = lambda x: F.when(F.startswith(x, F.lit("[")), F.get(F.from_json(x, "array<string>"), F.lit(0))).otherwise(x)
    return _cast(F.slice(F.transform(d, lambda x: F.struct(scalar(x["title"]).alias("title"), x["year"].try_cast("int").alias("year"), x["pub"].alias("journal"), scalar(x["doi"]).alias("doi"), x["citation_count"].alias("citations"), F.lit(None).cast("string").alias("abstract"))), 1, most), PUBLICATION)


def wikidata_awards(raw: Column, most: int = 20) -> Column:
    """Awards and memberships of a query result, each name and year once."""
    b = F.from_json(raw, "results struct<bindings:array<struct<awardLabel:struct<value:string>,memberLabel:struct<value:string>,date:struct<value:string>>>>")["results"]["bindings"]
    rows = F.transform(b, lambda x: F.struct(F.coalesce(x["awardLabel"]["value"], F.concat(F.lit("Member, "), x["memberLabel"]["value"])).alias("name"), F.left(x["date"]["value"], F.lit(4)).try_cast("int").alias("year")))
    return F.slice(F.array_distinct(F.filter(rows, lambda r: r["name"].isNotNull())), 1, most)


def repec_works(raw: Column, most: int = 15) -> Column:
    """Works of a reply that is a list, or an object with one under "works"; read as a variant because
    the shape differs from reply to reply."""
    v = F.try_parse_json(raw)
    works = F.coalesce(F.try_variant_get(v, "$.works", "array<struct<title:string,year:int,journal:string>>"), F.try_variant_get(v, "$", "array<struct<title:string,year:int,journal:string>>"))
    return F.slice(works, 1, most)


def dblp_papers(raw: Column, most: int = 15) -> Column:
    """Publications, titles without the closing dot; a venue may be a list."""
    hits = F.from_json(raw, "result struct<hits:struct<hit:array<struct<info:struct<title:string,year:string,venue:string,doi:string>>>>>")["result"]["hits"]["hit"]
    venue = lambda x: F.when(F.startswith(x, F.lit("[")), F.array_join(F.from_json(x, "array<string>"), ", ")).otherwise(x)
    return _cast(F.slice(F.transform(hits, lambda h: F.struct(F.rtrim(h["info"]["title"], F.lit(".")).alias("title"), h["info"]["year"].try_cast("int").alias("year"), venue(h["info"]["venue"]).alias("journal"), h["info"]["doi"].alias("doi"), F.lit(None).cast("int").alias("citations"), F.lit(None).cast("string").alias("abstract"))), 1, most), PUBLICATION)


def oai_record(raw: Column, most: int = 25) -> Column:
    """title, creators, year (the first four digits of any date), journal (the first source), doi and
    url of a harvested Dublin Core record."""
    all_ = lambda tag: F.transform(F.xpath(raw, F.lit(f"//*[local-name()='{tag}']/text()")), lambda x: F.trim(x))
    links = all_("identifier")
    doi = F.get(F.filter(links, lambda x: x.rlike(r"^(doi:|https?://(dx\.)?doi\.org/)?10\.")), F.lit(0))
    years = F.filter(F.transform(all_("date"), lambda d: F.regexp_extract(d, r"(\d{4})", 1)), lambda y: y != "")
    return F.struct(F.get(all_("title"), F.lit(0)).alias("title"), F.slice(all_("creator"), 1, most).alias("creators"), F.get(years, F.lit(0)).cast("int").alias("year"), F.get(all_("source"), F.lit(0)).alias("journal"), F.regexp_replace(doi, r"^(doi:|https?://(dx\.)?doi\.org/)", "").alias("doi"), F.get(F.filter(links, lambda x: F.startswith(x, F.lit("http")) & ~F.contains(x, F.lit("doi.org"))), F.lit(0)).alias("url"))
