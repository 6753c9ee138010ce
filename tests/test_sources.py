import json

from pyspark.sql import functions as F

from tarnwick.sources import files, html, payloads
from tarnwick.streaming import logs


def test_roster_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes('x\ny\nz\nName,Email,Title\r\n"Lee, Ann",a@x.org,PROF-AY\r\n"José, Ed",,"two\nlines"\r\n'.encode("latin-1"))
    rows = files.roster_csv(spark, str(path)).orderBy("pos").collect()
    assert [r.Name for r in rows] == ["Lee, Ann", "José, Ed"] and rows[1].Title == "two\nlines"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("  héllo ".encode())
    (tmp_path / "b.txt").write_bytes("h\xe9".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b" ")
    (tmp_path / "d.doc").write_bytes(b"x")
    got = {r.path[-5:]: (r.text, r.error) for r in files.uploaded_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("héllo", None), "b.txt": ("hé", None), "c.txt": (None, "no text"), "d.doc": (None, "unsupported file type")}


def test_html():
    assert html.visible_text("<head><title>t</title></head><p>a <b>b</b></p><script>x</script><p>c&amp;d</p>") == "a b\nc&d"
    assert html.visible_text(None) is None and html.visible_text("") == ""


def test_payloads(spark):
    author = json.dumps({"id": "https://x/A5", "display_name": "Ann Lee", "works_count": 3, "topics": [{"display_name": "Sea", "domain": {"display_name": "Life"}}], "summary_stats": {"h_index": 2}})
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>On\n Seas</title><author><name>Ann Lee</name></author></entry></feed>"
    r = spark.createDataFrame([(author, feed)], "a string, f string").select(payloads.openalex_author(F.col("a")).alias("a"), payloads.arxiv_entries(F.col("f"), F.lit("ann lee")).alias("f")).first()
    assert r.a["openalex_id"] == "A5" and r.a["names"] == ["Ann Lee"] and r.a["h_index"] == 2 and r.a["domains"] == ["Life"]
    assert [e["title"] for e in r.f] == ["On Seas"]
    assert spark.createDataFrame([("oops",)], "a string").select(payloads.openalex_author(F.col("a"))["openalex_id"].alias("x")).first().x is None


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "a" if i % 2 else "b") for i in range(6)]
    spark.createDataFrame(rows, "at string, kind string").select(F.col("at").cast("timestamp").alias("at"), "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, kind string").parquet(str(tmp_path / "in"))
    q = logs.windowed_counts(stream, "at", "kind", "1 hour", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.kind, r.n) for r in spark.table("counts").collect()} == {("a", 3), ("b", 3)}
    seen = []
    q = logs.upsert_stream(stream, lambda batch: seen.append(batch.count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == 6


def test_more_payloads(spark):
    def run(f, value, *args):
        return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"), *args).alias("x")).first().x

    nsf = {"response": {"award": [{"id": "1", "title": "T", "coPDPI": ["Ann Lee", "Bo Wu"]}, {"id": "2", "title": "U", "coPDPI": "Bo Wu"}]}}
    assert [g["co_pis"] for g in run(payloads.nsf_grants, json.dumps(nsf), F.lit("Lee"))] == [["Bo Wu"], ["Bo Wu"]]
    hits = {"data": [{"authorId": "1", "name": "A Lee", "paperCount": 9}, {"authorId": "2", "name": "x", "paperCount": 1, "externalIds": {"ORCID": "o"}}]}
    assert run(payloads.semantic_author, json.dumps(hits), F.lit("o"), F.lit("A Lee"), ("uni",)) == "2"
    assert run(payloads.semantic_author, json.dumps(hits), F.lit("z"), F.lit("A Lee"), ("uni",)) == "1"
    ps = {"patents": [{"patent_id": "9", "patent_title": "P", "patent_date": "2020-01-02", "assignees": [{"assignee_organization": "The Uni"}]}, {"patent_id": "8", "assignees": []}]}
    assert [(p["patent_number"], p["year"]) for p in run(payloads.patents, json.dumps(ps), ("uni",))] == [("9", 2020)]
    ads = {"response": {"docs": [{"title": ["A"], "year": "2001", "doi": "d"}]}}
    assert [(p["title"], p["doi"], p["year"]) for p in run(payloads.ads_papers, json.dumps(ads))] == [("A", "d", 2001)]
    wiki = {"results": {"bindings": [{"awardLabel": {"value": "X"}, "date": {"value": "1999-01-01"}}, {"awardLabel": {"value": "X"}, "date": {"value": "1999-05-01"}}, {"memberLabel": {"value": "Y"}}]}}
    assert [(a["name"], a["year"]) for a in run(payloads.wikidata_awards, json.dumps(wiki))] == [("X", 1999), ("Member, Y", None)]
    for reply in ([{"title": "R", "year": 2000}], {"works": [{"title": "R", "year": 2000}]}):
        assert [w["title"] for w in run(payloads.repec_works, json.dumps(reply))] == ["R"]
    dblp = {"result": {"hits": {"hit": [{"info": {"title": "T.", "year": "2010", "venue": ["V", "W"]}}]}}}
    assert [(p["title"], p["journal"]) for p in run(payloads.dblp_papers, json.dumps(dblp))] == [("T", "V, W")]
    oai = "<r xmlns:dc='x'><dc:title>T</dc:title><dc:creator>Lee, A</dc:creator><dc:date>c. 1998-02</dc:date><dc:identifier>https://doi.org/10.1/x</dc:identifier><dc:identifier>https://e.org/1</dc:identifier></r>"
    r = run(payloads.oai_record, oai)
    assert (r["title"], r["creators"], r["year"], r["doi"], r["url"]) == ("T", ["Lee, A"], 1998, "10.1/x", "https://e.org/1")


def test_enrichment_plan(spark):
    from tarnwick.plans import enrich

    works = json.dumps({"results": [{"title": "Deep Sea", "publication_year": 2018, "doi": "https://doi.org/10.1/X"}]})
    dblp = json.dumps({"result": {"hits": {"hit": [{"info": {"title": "deep sea.", "year": "2018", "doi": "10.1/x"}}, {"info": {"title": "New.", "year": "2025"}}]}}})
    rows = spark.createDataFrame([(1, "openalex", works), (1, "dblp", dblp), (2, "dblp", "oops")], "person_id long, source string, payload string")
    got = enrich.merged_publications(enrich.contributions(rows, {"openalex": payloads.openalex_works, "dblp": payloads.dblp_papers})).orderBy("place").collect()
    assert [(r.title, r.source, r.place) for r in got] == [("New", "dblp", 1), ("Deep Sea", "openalex", 2)]


def test_roster_of_many_quoted_rows(spark, tmp_path):
    from tarnwick.sources import files

    rows = "".join(f'"L{i}, F{i}","a ""b"" {i}\n2nd",É\r\n' for i in range(100_000))
    (tmp_path / "r.csv").write_bytes(("x\r\ny\r\n\r\nEmployee Name,Note,Place\r\n" + rows + ",,\r\n").encode("latin-1"))
    got = files.roster_csv(spark, str(tmp_path / "r.csv"))
    assert got.columns == ["pos", "Employee Name", "Note", "Place"] and got.count() == 100_000
    last = got.where("pos = 99999").first()
    assert (last["Employee Name"], last["Note"], last["Place"]) == ("L99999, F99999", 'a "b" 99999\n2nd', "É")


def test_feed_entries_of_any_author(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>One\n  two</title><published>2020-01-02</published><author><name>Bo Wu</name></author><author><name>Ann  Lee</name></author></entry><entry><title>Other</title><author><name>Ann Leeds</name></author></entry></feed>'
    df = spark.createDataFrame([(feed,), (None,), ("<feed/>",)], "raw string")
    got = [r[0] for r in df.select(payloads.arxiv_entries(F.col("raw"), F.lit("ann lee"))).collect()]
    assert [(e.title, e.year, e.authors) for e in got[0]] == [("One two", 2020, ["Bo Wu", "Ann Lee"])] and not got[1] and not got[2]


def test_articles_keep_their_own_years(spark):
    one = "<PubmedArticle><MedlineCitation><Article><Journal><JournalIssue><PubDate>{}</PubDate></JournalIssue><Title>{}</Title></Journal><ArticleTitle>{}</ArticleTitle>{}</Article></MedlineCitation></PubmedArticle>"
    raw = "<PubmedArticleSet>" + one.format("<Month>May</Month>", "J", "A <i>b</i> c", "") + one.format("<Year>2001</Year>", "K", "D", '<ELocationID EIdType="doi">10.1/x</ELocationID>') + "</PubmedArticleSet>"
    got = spark.createDataFrame([(raw,)], "raw string").select(payloads.pubmed_articles(F.col("raw"))).first()[0]
    assert [(p.title, p.year, p.journal, p.doi) for p in got] == [("A b c", None, "J", None), ("D", 2001, "K", "10.1/x")]


def test_author_cascade(spark):
    from tarnwick.sources import lookups

    record = lambda i, orcid=None, name="x", also=(): {"id": f"https://x/{i}", "orcid": orcid, "display_name": name, "display_name_alternatives": list(also)}
    records = spark.createDataFrame([(json.dumps(record("A1", "https://orcid.org/o1")),), (json.dumps(record("A2", "o2")),), ("oops",)], "payload string")
    people = spark.createDataFrame([(1, "A1", "o2", "Ann", "Lee"), (2, "A9", "o2", "Ann", "Lee"), (3, None, "o9", "Ann", "Lee"), (4, "", "", "Ann", "Lee"), (5, None, None, "Ann", ""), (6, None, None, "Ann", "Lee")], "person_id long, openalex_id string, orcid string, first string, last string")
    reply = lambda *hits: json.dumps({"results": list(hits)})
    searches = spark.createDataFrame([(3, reply(record("B1", name="Anna B. Lee"), record("B2", name="Bo Lee"), record("B3", name="Lee"))), (4, reply(record("C1", name="Q", also=["Ann Lee"]), record("C2", name="Ann Lee"))), (5, reply(record("D1", name="Ann Lee"))), (6, "no JSON")], "person_id long, payload string")
    got = {r.person_id: (r.author_id, r.via) for r in lookups.find_author(people, records, searches).collect()}
    assert got == {1: ("A1", "id"), 2: ("A2", "orcid"), 3: ("B1", "name")}


def test_author_by_papers(spark):
    from tarnwick.sources import lookups

    paper = lambda *authors: {"authors": [{"authorId": i, "name": n, "externalIds": o and {"ORCID": o}} for i, n, o in authors]}
    searches = spark.createDataFrame([("T1", json.dumps({"data": []})), ("T2", json.dumps({"data": [paper(("1", "Bo Wu", None)), paper(("2", "W. Lee", None), ("3", "Wei Lee", "o1"))]})), ("T4", json.dumps({"data": [paper(("9", "Wei Lee", None))]}))], "title string, payload string")
    people = spark.createDataFrame([(1, "Wei", "Lee", "o1", ["T1", "T2"]), (2, "Zoe", "Poe", "o1", [None, "T2"]), (3, "Wei", "Lee", None, ["a", "b", "c", "T4"]), (4, "", "", "", ["T2"]), (5, "Bo", "Wu", "", None)], "person_id long, first string, last string, orcid string, titles array<string>")
    assert {r.person_id: r.author_id for r in lookups.author_by_papers(people, searches).collect()} == {1: "2", 2: "3"}


def test_references_cut_off_before_their_semicolon_are_text():
    from tarnwick.sources.html import visible_text

    assert visible_text("<h1>a&amp;&amp;&amp</h1><p>&amp;amp; &copy; &#39; &#39 &notit; &lt</p>") == "a&&&amp\n&amp; © ' &#39 &notit; &lt"
    assert visible_text("<p>&amp") == "&amp"
