"""Requests, prompts and pools that the generated tables don't reach."""

import pytest
from pyspark.sql import functions as F

from tarnwick import workspace
from tarnwick.functions import jsonx, prompts, text
from tarnwick.operators import directory, records, review, search


def test_departments():
    assert directory.departments(None) is directory.departments("all") is directory.departments(["all", "", None]) is None
    assert directory.departments("sea") == ["sea"] and directory.departments(["sea", "all", "sky"]) == ["sea", "sky"]
    assert directory.department_list(" Sea, sky ,", ["sea", "sky"]) == ["sea", "sky"] and directory.department_list("sea,ALL", ["sea"]) is None
    with pytest.raises(ValueError, match="moon"):
        directory.department_list("sea,moon", ["sea"])


def test_pool_without_terms_and_small(spark):
    people = spark.createDataFrame([(i, "F", f"L{9 - i}", "Active" if i else "Inactive", True, i) for i in range(6)], "id long, first_name string, last_name string, eah_status string, has_profile boolean, h_index long")
    index = search.Index(spark.createDataFrame([], "term string, doc_id long, tf long, length long"), spark.createDataFrame([(0, 0)], "n long, total long"))
    assert [r.id for r in directory.match_pool(people, index, [], limit=2).collect()] == [5, 4, 3, 2, 1]
    assert [r.id for r in directory.match_pool(people, index, ["x"], limit=9).orderBy("place").collect()] == [5, 4, 3, 2, 1]
    assert [r.id for r in directory.match_pool(people, index, ["x"], limit=2).collect()] == [5, 4]


def test_candidate_blocks_and_question(spark):
    kind = "array<struct<external_id:string,display_name:string,alternatives:array<string>,cluster_size:int,score:double,name_similarity:double,current:boolean,listed:boolean,works_count:bigint,citations:bigint,topics:array<string>,affiliations:array<string>,orcid:string,works:array<struct<title:string,year:int,journal:string>>>>"
    rows = [("A1", "Ann Lee", ["A. Lee"], 2, 0.9, 1.0, True, None, 3, None, ["Sea"], ["U (2001-2003)"], "o1", [("T", 2001, "J"), ("S", 2002, None), (None, None, "J")]), ("A2", None, [], 1, 0.8, None, False, True, None, None, [], None, None, [])]
    df = spark.createDataFrame([(rows,)], f"c {kind}")
    first, second = df.select(prompts.candidate_blocks(F.col("c"))).first()[0]
    assert first.split("\n") == ["CANDIDATE 1:", "Profile: A1", "Shown name: Ann Lee (also published as: A. Lee)", "Stands for 2 profiles of one person.", "Evidence: score=0.9, name_similarity=1.0, current=yes, listed=no", "Output: 3 works, 0 citations", "Topics: Sea", "Affiliations: U (2001-2003)", "ORCID on the profile: yes", "Recent works:", "- T (2001, J)", "- S (2002)", "- ?"]
    assert second.split("\n") == ["CANDIDATE 2:", "Profile: A2", "Shown name: ?", "Evidence: score=0.8, current=no, listed=yes", "ORCID on the profile: no"]
    again = [df.select(prompts.candidate_blocks(F.col("c"), seed)).first()[0] for seed in ("a", "a", "b", "c", "d", "e")]
    assert again[0] == again[1] and len({b[0].split("\n")[1] for b in again}) == 2
    text = df.select(prompts.question(F.lit("P"), prompts.candidate_blocks(F.col("c")))).first()[0]
    assert text.startswith("P\n\nCANDIDATE 1:") and text.endswith("as JSON alone.")


def test_context_and_history(spark):
    df = spark.createDataFrame([("seen text", "seen", "new", [("U", [2003, 2001]), ("V", [1999]), (None, [1])])], "a string, b string, c string, h array<struct<institution:string,years:array<int>>>")
    row = df.select(prompts.context([("One", F.col("a")), ("Two", F.lit(""))], [("B", F.col("b")), ("C", F.col("c"))], F.lit("N")).alias("x"), prompts.context([("One", F.lit(None).cast("string"))], [("B", F.lit(""))], F.lit("N")).alias("none"), prompts.affiliation_history(F.col("h")).alias("h")).first()
    assert row.x == "Name: N\n\n## One\nseen text\n\n## C\nnew" and row.none is None and row.h == ["U (2001-2003)", "V (1999)"]


def test_json_within_replies():
    assert jsonx.recover('[{"a": 1}, {"b": "}"}, {"c') == '[{"a": 1}, {"b": "}"}]'
    assert jsonx.recover('as {x} and [1, 2] say') == "[1, 2]" and jsonx.recover("see [{\"id\": 7}] ok") == '{"id": 7}'
    assert jsonx.recover("```\n[{\"a\": 1}]\n``` or {}") == '[{"a": 1}]' and jsonx.recover("{broken [") is None
    assert jsonx.recover("x [] y") == "[]"


def test_records_round_trip(spark):
    row = {f.name: None for f in records.schema()} | {"id": 1, "first_name": "A", "pi_eligible": 1, "degrees": '["PhD", null]'}
    table = spark.createDataFrame([row], records.schema())
    read = records.recorded(table)
    r = read.first()
    assert r.pi_eligible is True and r.degrees == ["PhD", None] and r.populations == [] and "department" not in records.recorded(table, tagged=False).columns
    back = records.stored(read).first()
    assert back.identity_status == "unresolved" and back.degrees == '["PhD",null]' and back.pi_eligible == 1
    assert records.preview(read.withColumn("_private", F.lit(1))).columns == read.columns
    assert [x[0] for x in read.select(records.has_input(F.array(), F.col("title"))).collect()] == [False]


def test_tables_are_dropped_but_those_still_read(spark):
    import threading

    before = workspace.save(spark.range(2))
    begin = workspace.mark()
    a, b, theirs = workspace.save(spark.range(3)), workspace.save(spark.range(4)), []
    other = threading.Thread(target=lambda: theirs.append(workspace.save(spark.range(5))))
    other.start()
    other.join()
    workspace.drop_since(begin, b)
    # what another thread wrote meanwhile, say for another query, stays
    assert (before.count(), b.count(), theirs[0].count()) == (2, 4, 5)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a._scratch_path).count()


def test_columns_of_a_person():
    assert len(records.COLUMNS) == 50 == len(set(records.COLUMNS)) and set(records.NUMBERS) | set(records.LISTS) < set(records.COLUMNS)
    assert [f.name for f in records.schema()] == records.COLUMNS


def test_what_is_derived(spark):
    rows = spark.createDataFrame([(1, "", None, ["k"], None, ["a", "b"]), (2, None, " ", [], [], None), (3, "", "", None, ["g"], [])], "id long, research_interests string, research_interests_enriched string, expertise_keywords array<string>, funded_grants array<string>, recent_publications array<string>")
    got = records.derived(rows, F.lit("now")).orderBy("id").select("has_profile", "grants_count", "pubs_count", "updated_at").collect()
    assert [tuple(r) for r in got] == [(1, 0, 2, "now"), (1, 0, 0, "now"), (0, 1, 0, "now")]


def test_several_decisions_about_one_person(spark):
    """They are taken in turn: what the first writes, the second meets."""
    people = spark.createDataFrame([(7, None, None, None, "ambiguous"), (8, "P", "o8", ["B1"], "auto"), (9, None, None, None, "ambiguous")], "id long, openalex_id string, orcid string, openalex_id_alt array<string>, identity_status string")
    schema = "id long, person_id long, source string, external_id string, orcid string, status string, decided_at string"
    candidates = spark.createDataFrame(
        [(1, 7, "openalex", "A1", None, "pending", None), (2, 7, "openalex", "A2", "o2", "pending", None), (3, 7, "orcid", "o3", None, "pending", None), (4, 8, "openalex", "B1", None, "pending", None), (5, 8, "openalex", "P", None, "pending", None), (6, 9, "openalex", "C1", None, "rejected", "then"), (10, 9, "openalex", "C2", None, "pending", None)],
        schema,
    )
    decide = lambda rows, **k: review.decided(people, candidates, spark.createDataFrame(rows, "id long, decision string, pos long"), F.lit("now"), **k)

    state = decide([(1, "accept", 0), (2, "merge", 1), (4, "merge", 0), (5, "merge", 1), (6, "accept", 0)])
    people_now = {r.id: (r.openalex_id, r.orcid, r.openalex_id_alt, r.identity_status) for r in state.people.collect()}
    assert people_now == {7: ("A1", "o2", ["A2"], "confirmed"), 8: ("P", "o8", ["B1"], "auto"), 9: (None, None, None, "ambiguous")}
    assert {r.id: r.status for r in state.candidates.collect()} == {1: "accepted", 2: "merged", 3: "pending", 4: "merged", 5: "merged", 6: "rejected", 10: "pending"}
    assert sorted((r.person_id, r.new_value, r.field_updated, r.method) for r in state.log.collect()) == [(7, "A1", "openalex_id", "identity_accepted"), (7, "A2", "openalex_id_alt", "identity_merged"), (8, "B1", "openalex_id_alt", "identity_merged"), (8, "P", "openalex_id_alt", "identity_merged")]

    # the other way round the merge is the acceptance, and the acceptance can't replace its profile
    state = decide([(1, "accept", 1), (2, "merge", 0)])
    assert [(r.openalex_id, r.openalex_id_alt) for r in state.people.where("id = 7").collect()] == [("A2", None)]
    # of two decisions about one candidate the first counts; an acceptance that rejects siblings ends the batch
    state = decide([(1, "reject", 0), (1, "accept", 1), (2, "accept", 2), (3, "accept", 3)], reject_siblings=True)
    assert {r.id: r.status for r in state.candidates.where("person_id = 7").collect()} == {1: "rejected", 2: "accepted", 3: "rejected"}
    assert state.people.count() == 3 and state.people.where("id = 7").first().orcid == "o2"


def test_spelling_of_units(spark):
    words = {"ANESTHESIA/PAIN MED-OB": "Anesthesia/Pain Med-Ob", "o'brien 3rd": "O'Brien 3Rd", "": "", "école  d'été": "École  D'Été"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.titled(F.col("w")).alias("t")).collect()
    assert {r.w: r.t for r in rows} == words
    assert spark.createDataFrame([(w,) for w in words], "w string").collect() and all(w.title() == t for w, t in words.items())


def test_contexts(spark):
    from tarnwick.plans import context

    def record(i, name="Ann Lee", title="", research="", **lists):
        return (i, name, title, research, *(lists.get(c) for c in ("funded_grants", "recent_publications", "awards", "patents")))

    names = ["funded_grants", "recent_publications", "awards", "patents"]
    people = spark.createDataFrame(
        [record(1, title="Dean", research="seas", funded_grants='[{"title": "old"}]', patents='[{"title": "P", "year": 1999}]', awards='[{"name": "W"}]'), record(2), record(3, recent_publications='[{"title": "T", "year": 2001}, {"journal": "J", "year": 2002}]')],
        "person_id long, name string, title string, research_interests string, funded_grants string, recent_publications string, awards string, patents string",
    ).withColumns({c: F.try_parse_json(c) for c in names})
    found = spark.createDataFrame(
        [
            (1, 1, "nsf_awards", '{"funded_grants": [{"title": "G", "nsf_program": "OCE", "abstract": "%s"}, {}]}' % ("x" * 300)), (1, 0, "wikidata", '{"awards": [{"name": "A", "year": 2000}]}'), (1, 2, "clinical_trials", '{"funded_grants": []}'),
            (1, 3, "semantic_scholar", '{"h_index": 3, "paper_count": 9, "recent_publications": [{"title": "S", "year": 2003}]}'), (1, 4, "orcid", '{"works_count": 2, "recent_works": ["a", "b"]}'), (1, 5, "nasa_ads", '{"recent_publications": [{"title": "N", "journal": "J"}]}'),
            (2, 0, "orcid", '{"works_count": 0}'), (2, 1, "unheard_of", '{"awards": [{"name": "no"}]}'), (2, 2, "openalex", "no JSON"),
        ],
        "person_id long, pos int, source string, data string",
    ).withColumn("data", F.try_parse_json("data"))
    got = {r.person_id: r.context for r in context.contexts(people, found).collect()}
    assert got[1].split("\n\n") == [
        "Name: Ann Lee, Dean", "Research interests: seas", "Honors and awards:\n- A (2000)", "Grants of NSF:\n- G (NSF, OCE)\n  Abstract: " + "x" * 200 + "\n- Untitled (NSF)", "Semantic Scholar: h-index: 3, 9 papers",
        "Publications in Semantic Scholar:\n- S", "ORCID: 2 works", "Works in ORCID:\n- a\n- b", "Publications (nasa ads):\n- N (J)", "Patents:\n- P (1999)",
    ]
    assert got[2] is None and got[3] == "Name: Ann Lee\n\nPublications found earlier:\n- T\n- Untitled (J, 2002)"
