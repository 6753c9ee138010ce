"""Queries of pages as trees: links, sections, addresses, listings, one hop; with the SQL that each equals.

Raw pages are read as they are. Profiles and listings are pages written from the tables' columns by the
same rules in both languages; the SQL works from the columns, never from the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.catalog import query, table
from tarnwick.functions import names, prompts
from tarnwick.sources import dom


def _with_tree(pages: DataFrame) -> DataFrame:
    """One parse for all questions to a page."""
    return pages.withColumn("tree", dom.parsed("html")).drop("html")


def _escaped(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def _page(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# Raw pages

@query(rf"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) GROUP BY ALL")
def q_page_elements(spark, d):
    rows = dom.nodes(_with_tree(table(spark, d, "pages").select("page_id", "html")))
    return rows.where("tag NOT IN ('', '#text')").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, place, href, text FROM (SELECT page_id, unnest(hrefs) AS href, trim(unnest(texts)) AS text, unnest(generate_series(0, len(hrefs) - 1)) AS place FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages))""")
def q_page_links(spark, d):
    rows = _with_tree(table(spark, d, "pages").select("page_id", "html"))
    return rows.select("page_id", F.posexplode(dom.links(F.col("tree"))).alias("place", "x")).select("page_id", F.col("place").cast("long").alias("place"), "x.href", "x.text")


# Profiles

_SPACE = r"[\s\x0B\x{85}\p{Z}]+"
_STRIP = lambda x: rf"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _profiles(spark, d) -> DataFrame:
    """A page of each document: what research is, what isn't, stray texts and nested lists."""
    k, lang = F.col("doc_id"), F.col("lang")
    return table(spark, d, "documents").select("doc_id", _page(
        '<html><head><meta name="keywords" content="x"><meta name="description" content="', _escaped(F.col("source")), '"><style>h2 {}</style></head><body><nav><h2>Menu</h2><p>Research</p></nav>',
        "<main><h1>Research</h1><p>not under a heading</p><h2> Current <b>RESEARCH</b></h2>stray<p>", _escaped(F.col("text")), "</p><script>var research = 1;</script>",
        F.when(F.col("n_chars") % 3 == 0, _page("<div><p> in ", lang, " </p><p>two</p></div>")).otherwise(""), "<h3>Teaching</h3><p>not this</p>",
        F.when(k % 4 == 1, _page("<h4>Biography</h4>stray<ul><li>", lang, "<li> b <i>c</i></ul><br><div></div>")).otherwise(""), "</main><footer><h2>Links</h2><p>no</p></footer></body></html>",
    ).alias("html"))


@query(rf"""SELECT doc_id, nullif(left({_STRIP("regexp_replace(array_to_string(list_filter(["
    + _STRIP('text') + r", CASE WHEN n_chars % 3 = 0 THEN 'in ' || lang || 'two' END, CASE WHEN doc_id % 4 = 1 THEN lang || 'bc' END, source], lambda x: coalesce(x, '') <> ''), ' '), '" + _SPACE + "', ' ', 'g')")}, 2000), '') AS research FROM documents""")
def q_profile_sections(spark, d):
    return _with_tree(_profiles(spark, d)).select("doc_id", dom.sections(F.col("tree"), ["research", "overview", "biography", "interests"]).alias("research"))


def _contact_pages(spark, d) -> DataFrame:
    """A page of each customer with addresses where the segment puts them; a third have a department's too."""
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@N"), F.col("c_nationkey").cast("string"), F.lit(".x.edu"))
    shared = F.when(F.col("c_acctbal") > 6000, '<a href="mailto:info@x.edu">us</a> ').otherwise("")
    by = lambda segment, *parts: F.when(F.col("c_mktsegment") == segment, _page(*parts))
    main = F.coalesce(
        by("BUILDING", '<a href="MAILTO:no@x.edu">no</a>', shared, '<a href="mailto: ', mail, '?subject=hi">write</a>'),
        by("MACHINERY", "<h3>How to <i>contact</i></h3> stray@x.edu <p>by post</p><p>to ", mail, "</p><h3>Press</h3><p>press@x.edu</p>"),
        by("HOUSEHOLD", "<p>someone@x.edu</p><div><span><b>E-mail: ", mail, "</b></span></div>"),
        by("AUTOMOBILE", "<p>", mail, "</p>"),
        F.lit("<p>nothing</p>"),
    )
    header = by("FURNITURE", '<a href="mailto:', mail, '">me</a>')
    box = F.when(F.col("c_acctbal") < 0, "main").when(F.col("c_acctbal") < 3000, 'div id="Page-Content"').when(F.col("c_acctbal") < 6000, 'div class="wide profile"').otherwise("section")
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", _page(shared, F.coalesce(header, F.lit("")), "<", box, ">", main, "</", F.regexp_extract(box, "^[a-z]+", 0), "><footer>footer@x.edu</footer>").alias("html"))


_CONTACT_SQL = """SELECT c_custkey, CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN lower(replace(c_name, '#', '.')) || '@n' || c_nationkey || '.x.edu' END AS email FROM customer"""


@query(_CONTACT_SQL)
def q_profile_address(spark, d):
    return _with_tree(_contact_pages(spark, d)).select("c_custkey", dom.address(F.col("tree"), "x.edu", ["info@x.edu"]).alias("email"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_mktsegment = 'AUTOMOBILE' THEN lower(replace(c_name, '#', '.')) || '@n' || c_nationkey || '.x.edu' WHEN c_mktsegment = 'MACHINERY' THEN 'stray@x.edu' ELSE 'someone@x.edu' END AS email FROM customer""")
def q_profile_any_address(spark, d):
    return _with_tree(_contact_pages(spark, d)).select("c_custkey", dom.any_address(F.col("tree"), "x.edu", ["info@x.edu"], ["footer"]).alias("email"))


@query("""SELECT event_id, CASE WHEN local IN ('info', 'events', 'admin') THEN FALSE ELSE contains(replace(replace(local, '.', ''), '-', ''), f3) OR contains(replace(replace(local, '.', ''), '-', ''), 'lee') OR (contains(replace(replace(local, '.', ''), '-', ''), left(f3, 1)) AND regexp_matches(replace(replace(local, '.', ''), '-', ''), '^[a-z]{1,3}[0-9]')) END AS plausible
    FROM (SELECT event_id, left(event_type, 3) AS f3, CASE floor(value)::BIGINT % 6 WHEN 0 THEN 'info' WHEN 1 THEN left(event_type, 2) || user_id WHEN 2 THEN 'z' || user_id WHEN 3 THEN 'm.l-ee' WHEN 4 THEN 'events' ELSE 'x' || event_type END AS local FROM events)""")
def q_plausible_email(spark, d):
    v, kind, user = F.floor("value").cast("long") % 6, F.col("event_type"), F.col("user_id").cast("string")
    local = F.when(v == 0, "info").when(v == 1, F.concat(F.left(kind, F.lit(2)), user)).when(v == 2, F.concat(F.lit("z"), user)).when(v == 3, "M.L-ee").when(v == 4, "events").otherwise(F.concat(F.lit("x"), kind))
    return table(spark, d, "events").select("event_id", names.plausible_email(F.concat(local, F.lit("@x.edu")), F.initcap("event_type"), F.lit("Lee")).alias("plausible"))


# Listings, searches and what they lead to


def _listings(spark, d) -> DataFrame:
    """For each nation and segment a search's page with a card for each customer."""
    card = _page(
        '<li class="card"><a href="', F.when(F.col("c_acctbal") > 0, "/profile/").otherwise("/people/"), F.col("c_custkey").cast("string"), '"><b>', F.upper("c_name"), "</b></a>",
        F.when(F.col("c_custkey") % 2 == 0, _page('<p class="x">no</p><span class="JobTitle"> ', F.col("c_mktsegment"), " </span>")).otherwise(""), "</li>",
    )
    cards = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("card")))), lambda x: x["card"]), "").alias("cards"))
    return cards.select("c_nationkey", "c_mktsegment", _page('<ul class="list">', F.col("cards"), "</ul>").alias("html"))


@query("SELECT c_custkey, upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS title FROM customer WHERE c_acctbal > 0")
def q_search_cards(spark, d):
    return dom.card_rows(_listings(spark, d), "/profile/").select(F.regexp_extract("c.href", r"(\d+)$", 1).cast("long").alias("c_custkey"), "c.name", "c.title")


@query(f"SELECT c_custkey, email FROM ({_CONTACT_SQL}) JOIN customer USING (c_custkey) WHERE c_acctbal > 0")
def q_profile_followed(spark, d):
    """Each customer's search leads, by the link that shows the name, to the page with the address."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), "c_nationkey", "c_mktsegment")
    pages = _contact_pages(spark, d).select(_page("https://x.edu/profile/", F.col("c_custkey").cast("string")).alias("url"), "html")
    led = dom.followed_from(people, _listings(spark, d), pages, ["c_nationkey", "c_mktsegment"], "/profile/", "https://x.edu")
    return _with_tree(led).select(F.col("person").alias("c_custkey"), dom.address(F.col("tree"), "x.edu", ["info@x.edu"]).alias("email"))


_ENTRY_SQL = """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) || CASE WHEN p_size % 11 = 0 THEN '2' ELSE '' END AS last, p_brand, p_type, p_size FROM part"""


@query(f"""SELECT first, last, CASE WHEN p_size % 5 = 0 THEN 'Senior Lecturer' ELSE 'Professor' END AS title, CASE WHEN p_size % 2 = 0 THEN 'PHD,MPH' ELSE 'DRPH' END AS degrees FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(first), lower(last) ORDER BY p_partkey) AS n FROM ({_ENTRY_SQL}) WHERE p_size % 7 <> 0 AND p_size % 11 <> 0) WHERE n = 1""")
def q_listing_entry(spark, d):
    """Names of a catalogue page, an entry of some 20 words each; clerks and numbers are no people."""
    word = F.split("p_name", " ")
    last = F.concat(F.get(word, F.lit(1)), F.when(F.col("p_size") % 11 == 0, "2").otherwise(""))
    degrees = F.when(F.col("p_size") % 2 == 0, "Ph.D., M.P.H., PhD").otherwise("Dr.P.H.")
    title = F.when(F.col("p_size") % 7 == 0, "Clerk").when(F.col("p_size") % 5 == 0, "Senior Lecturer").otherwise("Assistant Professor")
    line = F.concat(F.lit("<p> "), last, F.lit(", "), F.get(word, F.lit(0)), F.lit(" Q., "), degrees, F.lit(", <i>"), title, F.lit(" of "), F.col("p_type"), F.lit("</i></p>"))
    page = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("lines"))
    rows = _with_tree(page.select(F.transform("lines", lambda x: x["p_partkey"]).alias("keys"), _page("<body>", F.array_join(F.transform("lines", lambda x: x["line"]), ""), "</body>").alias("html")))
    each = rows.select(F.explode(F.arrays_zip("keys", dom.listed_texts(F.col("tree"), ["p"]).alias("texts"))).alias("x")).select("x.keys", "x.texts")
    entries = each.select("keys", prompts.listing_entry(F.col("texts")).alias("e")).where("e IS NOT NULL").select("keys", "e.*")
    return prompts.listed_once(entries, "keys").select("first", "last", "title", F.array_join("degrees", ",").alias("degrees"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN lower(replace(s_name, '#', '')) || '@x.edu' END AS email FROM supplier""")
def q_entry_address(spark, d):
    """Each supplier's address in its nation's directory: by a link, in the text, or not at all."""
    mail, key = F.concat(F.replace("s_name", F.lit("#"), F.lit("")), F.lit("@x.edu")), F.col("s_suppkey")
    shown = F.when(key % 3 == 0, _page('<td><a href="mailto:info@x.edu">all</a> <a href="mailto:', mail, '">m</a></td>')).when(key % 3 == 1, _page("<td> ", mail, "</td>")).otherwise("<td></td>")
    row = _page("<tr><td>", F.col("s_name"), "</td><td> Nation ", F.col("s_nationkey").cast("string"), "</td>", shown, "</tr>")
    page = table(spark, d, "supplier").groupBy("s_nationkey").agg(_page("<table>", F.array_join(F.collect_list(row), ""), "</table>").alias("html"))
    people = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit("nation").alias("first"), F.col("s_name").alias("last"))
    return dom.entry_addresses(people, page, ["s_nationkey"], "x.edu", ["info@x.edu"]).select("s_suppkey", "email")
