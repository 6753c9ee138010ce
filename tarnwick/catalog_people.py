"""Queries of the directory's views, records, reviews and reconciling, with the SQL that each equals.

People are made from customers by the same rules in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.catalog import _FOLD_SQL, _bm25_sql, _candidates, index_of, query, table
from tarnwick.functions import jsonx, prompts
from tarnwick.operators import directory, identity, records, review, rules, search
from tarnwick.plans import reconcile
from tarnwick.sources import payloads

_PEOPLE_SQL = """people AS (SELECT c_custkey AS id, CASE c_custkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'F' || (c_custkey % 13) END AS first_name, 'L' || (c_custkey % 29) AS last_name, lower(c_mktsegment) AS department,
    CASE c_custkey % 7 WHEN 0 THEN 'Inactive' WHEN 1 THEN 'Duplicate' WHEN 2 THEN NULL ELSE 'Active' END AS eah_status, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS pi_eligible,
    CASE c_custkey % 5 WHEN 0 THEN 'Professor Emeritus' WHEN 1 THEN NULL ELSE 'Professor' END AS title, CASE c_custkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'unresolved' ELSE 'ambiguous' END AS identity_status,
    CASE WHEN c_custkey % 2 = 0 THEN 'A' || c_custkey END AS openalex_id, CASE WHEN c_custkey % 6 = 0 THEN 'o' || c_custkey END AS orcid, 'u' || c_custkey || '@x.edu' AS email, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS h_index FROM customer)"""


def _people(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 17 == 1, "").when(k % 17 != 0, text("F", k % 13)).alias("first_name"), text("L", k % 29).alias("last_name"), F.lower("c_mktsegment").alias("department"),
        F.when(k % 7 == 0, "Inactive").when(k % 7 == 1, "Duplicate").when(k % 7 != 2, "Active").alias("eah_status"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("pi_eligible"),
        F.when(k % 5 == 0, "Professor Emeritus").when(k % 5 != 1, "Professor").alias("title"), F.when(k % 4 == 0, "not_found").when(k % 4 == 1, "unresolved").otherwise("ambiguous").alias("identity_status"),
        F.when(k % 2 == 0, text("A", k)).alias("openalex_id"), F.when(k % 6 == 0, text("o", k)).alias("orcid"), F.concat(text("u", k), F.lit("@x.edu")).alias("email"), F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100).cast("long")).alias("h_index"),
    )


# The directory


@query(f"WITH {_PEOPLE_SQL} SELECT id, first_name, last_name FROM people WHERE department IN ('building', 'machinery') AND coalesce(first_name, '') <> '' AND department NOT IN ('machinery') ORDER BY last_name, first_name, id LIMIT 20 OFFSET 10")
def q_directory_listing(spark, d):
    people = _people(spark, d)
    page, _ = directory.search(people, None, "", ["building", "machinery", "all", None], ["machinery"], limit=20, offset=10)
    return page.select("id", "first_name", "last_name")


_DOCS_SQL = "documents WHERE source IN ('src1', 'src2', 'src3') AND doc_id % 5 <> 0 AND source NOT IN ('src3')"


def _authors(spark, d) -> tuple[DataFrame, search.Index]:
    docs = table(spark, d, "documents")
    people = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, "F").alias("first_name"), F.lit("L").alias("last_name"), F.col("source").alias("department"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("stable_key"), F.lit(None).cast("string").alias("title"), F.lit("Active").alias("eah_status"), (F.col("n_chars") > 200).alias("has_profile"), F.col("n_chars").alias("h_index"))
    return people, index_of(spark, d)


@query(f"WITH {_bm25_sql('Ther ONAN x', True)} SELECT doc_id AS id, round(score, 6) AS score FROM scored WHERE doc_id IN (SELECT doc_id FROM {_DOCS_SQL}) ORDER BY scored.score, doc_id LIMIT 20 OFFSET 2")
def q_directory_search(spark, d):
    people, index = _authors(spark, d)
    return directory.search(people, index, "Ther ONAN x", ["src1", "src2", "src3"], ["src3"], offset=2)[0].select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql('Ther ONAN x', True)} SELECT count(*) AS total FROM scored WHERE doc_id IN (SELECT doc_id FROM {_DOCS_SQL})")
def q_directory_total(spark, d):
    people, index = _authors(spark, d)
    return directory.search(people, index, "Ther ONAN x", ["src1", "src2", "src3"], ["src3"])[1]


@query(f"WITH {_bm25_sql('ther', True)} SELECT doc_id AS id, 'k' || doc_id AS stable_key, source AS department FROM scored JOIN documents USING (doc_id) WHERE source = 'src3' ORDER BY score, doc_id LIMIT 50")
def q_curate_search(spark, d):
    people, index = _authors(spark, d)
    return directory.curate(people, index, "ther", "src3")[0].select("id", "stable_key", "department")


def _pool_sql(limit: int) -> str:
    return f"""WITH {_bm25_sql('ther', False)}, able AS (SELECT doc_id AS id, n_chars FROM documents WHERE n_chars > 200 AND doc_id % 9 <> 4), few AS (SELECT count(*) <= {limit} AS few FROM able),
    best AS (SELECT id, 0 AS tier, row_number() OVER (ORDER BY score, id) AS place FROM able JOIN scored ON doc_id = id ORDER BY place LIMIT {limit}),
    rest AS (SELECT id, 1 AS tier, row_number() OVER (ORDER BY n_chars DESC, id % 7, id % 5 <> 0, id) AS place FROM able WHERE id NOT IN (SELECT id FROM best) ORDER BY place LIMIT {limit}),
    filled AS (SELECT * FROM (FROM best UNION ALL FROM rest) ORDER BY tier, place LIMIT {limit})
    SELECT id, 0 AS tier, row_number() OVER (ORDER BY id % 7, id % 5 <> 0, id) AS place FROM able WHERE (SELECT few FROM few) UNION ALL SELECT * FROM filled WHERE NOT (SELECT few FROM few)"""


def _pool(spark, d, limit: int) -> DataFrame:
    people, index = _authors(spark, d)
    named = people.withColumns({"last_name": F.concat(F.lit("L"), (F.col("id") % 7).cast("string")), "eah_status": F.when(F.col("id") % 9 == 4, "Inactive").when(F.col("id") % 2 == 0, "Active")})
    return directory.match_pool(named, index, ["ther"], limit).select("id", "tier", F.col("place").cast("long").alias("place"))


@query(_pool_sql(60))
def q_match_pool_best(spark, d):
    """Of more people than the limit the best, filled up by h-index and name."""
    return _pool(spark, d, 60)


@query(_pool_sql(1_000_000))
def q_match_pool_small(spark, d):
    """All people, as they are fewer than the limit, by name."""
    return _pool(spark, d, 1_000_000)


@query(f"WITH {_PEOPLE_SQL} SELECT id, coalesce(first_name, '') || ' ' || last_name AS name, coalesce(title, '') AS title, CASE WHEN h_index IS NULL THEN department WHEN h_index % 2 = 0 THEN '' ELSE 'seas ' || department END AS research, 'k' || id || ' m ' || department AS keywords FROM people WHERE coalesce(first_name, '') <> ''")
def q_search_document(spark, d):
    people = _people(spark, d).where("coalesce(first_name, '') <> ''")
    research = [F.when(F.col("h_index") % 2 == 0, "").when(F.col("h_index").isNotNull(), "seas"), F.when(F.col("h_index").isNull() | (F.col("h_index") % 2 != 0), F.col("department"))]
    arrays = [F.array(F.concat(F.lit("k"), F.col("id").cast("string"))), F.lit(None).cast("array<string>"), F.array(F.lit("m"), F.col("department"))]
    return people.select("id", directory.search_document(F.col("first_name"), F.col("last_name"), F.col("title"), research, arrays).alias("s")).select("id", "s.*")


@query(f"WITH {_PEOPLE_SQL} SELECT department, count(*) AS n FROM people WHERE (eah_status IS NULL OR eah_status NOT IN ('Inactive', 'Duplicate')) AND department NOT IN ('machinery', 'furniture') AND pi_eligible = 1 GROUP BY department")
def q_public_eligible(spark, d):
    rows = directory.public(_people(spark, d), ["machinery", "furniture"]).where(directory.is_active(F.col("eah_status")) & (F.col("pi_eligible") == 1))
    return rows.groupBy("department").agg(F.count("*").alias("n"))


@query(f"""WITH {_PEOPLE_SQL} SELECT id, '{{' || coalesce(array_to_string([CASE WHEN first_name IS NOT NULL THEN '"first_name":"' || first_name || '"' END, CASE WHEN title IS NOT NULL THEN '"title":"' || title || '"' END, CASE WHEN h_index IS NOT NULL THEN '"h_index":' || h_index END], ','), '') || '}}' AS record FROM people""")
def q_only_fields(spark, d):
    people = _people(spark, d)
    return people.select("id", directory.only_fields(people, ["first_name", "nothing", "title", "h_index"]).alias("record"))


@query("""SELECT doc_id, string_split(text, ' ')[1:3] AS funded_grants, string_split(text, ' ')[1:8] AS expertise_keywords, array_to_string(string_split(text, ' ')[1:3], '|') AS recent FROM documents""")
def q_shown_slices(spark, d):
    parts = F.split("text", " ")
    shown = directory.shown_slices({"funded_grants": parts, "expertise_keywords": parts, "recent_publications": parts, "degrees": parts})
    assert set(shown) == {"funded_grants", "expertise_keywords", "recent_publications"}
    return table(spark, d, "documents").select("doc_id", shown["funded_grants"].alias("funded_grants"), shown["expertise_keywords"].alias("expertise_keywords"), F.array_join(shown["recent_publications"], "|").alias("recent"))


# Records


@query(f"""WITH {_PEOPLE_SQL} SELECT id, 'unresolved' AS identity_status, CASE WHEN pi_eligible IS NOT NULL THEN pi_eligible::BIGINT END AS pi_eligible, CASE WHEN h_index IS NULL THEN NULL WHEN h_index % 2 = 0 THEN '[]' ELSE '["' || department || '",null]' END AS degrees FROM people""")
def q_record_stored(spark, d):
    degrees = F.when(F.col("h_index") % 2 == 0, F.array().cast("array<string>")).when(F.col("h_index").isNotNull(), F.array("department", F.lit(None)))
    rows = _people(spark, d).select("id", F.when(F.col("id") % 2 == 0, "").alias("identity_status"), F.col("pi_eligible").cast("boolean").alias("pi_eligible"), degrees.alias("degrees"))
    return records.stored(rows)


@query(f"WITH {_PEOPLE_SQL} SELECT id, pi_eligible = 1 AS pi_eligible, CASE WHEN h_index IS NULL THEN 0 ELSE 2 END AS n_degrees, CASE WHEN h_index IS NOT NULL THEN department END AS first_degree FROM people")
def q_record_read(spark, d):
    raw = F.when(F.col("h_index").isNotNull(), F.format_string('["%s", "x"]', "department"))
    rows = _people(spark, d).select("id", "department", "pi_eligible", raw.alias("degrees"))
    return records.recorded(rows, tagged=False).select("id", "pi_eligible", F.size("degrees").alias("n_degrees"), F.get("degrees", F.lit(0)).alias("first_degree"))


@query("SELECT p_partkey FROM part WHERE NOT (p_size % 3 = 0) OR p_size % 2 = 0")
def q_prune_inactive(spark, d):
    rows = table(spark, d, "part").withColumn("active", F.when(F.col("p_size") % 2 != 0, F.col("p_size") % 3 != 0))
    return records.without_inactive(rows, "active").select("p_partkey")


@query("SELECT count(*) AS people, count(*) FILTER (WHERE best) AS with_data, sum(n)::BIGINT AS fetches FROM (SELECT user_id, bool_or(value > 50) AS best, count(event_type) AS n FROM events GROUP BY user_id)")
def q_run_summary(spark, d):
    return records.run_summary(table(spark, d, "events"), "user_id", "event_type", F.col("value") > 50)


# Reviews

_CANDIDATES_SQL = """candidates AS (SELECT o_orderkey AS id, o_custkey AS person_id, CASE WHEN o_orderkey % 3 = 0 THEN 'orcid' ELSE 'openalex' END AS source, 'X' || (o_orderkey % 50) AS external_id, (o_orderkey % 11) / 10.0 AS score,
    CASE o_orderkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'merged' ELSE 'pending' END AS status, year(o_orderdate)::VARCHAR AS decided_at, CASE WHEN o_orderkey % 4 = 1 THEN 'o' || o_custkey END AS orcid,
    CASE WHEN o_orderkey % 10 > 7 THEN 'accept' WHEN o_orderkey % 10 > 2 THEN 'reject' END AS llm_verdict, (o_orderkey % 50) / 50.0 AS llm_confidence FROM orders)"""


def _reviewed(spark, d) -> DataFrame:
    k, person = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    return table(spark, d, "orders").select(
        k.alias("id"), person.alias("person_id"), F.when(k % 3 == 0, "orcid").otherwise("openalex").alias("source"), text("X", k % 50).alias("external_id"), ((k % 11) / 10).alias("score"),
        F.when(k % 5 == 0, "rejected").when(k % 5 == 1, "merged").otherwise("pending").alias("status"), F.year("o_orderdate").cast("string").alias("decided_at"), F.when(k % 4 == 1, text("o", person)).alias("orcid"),
        F.when(k % 10 > 7, "accept").when(k % 10 > 2, "reject").alias("llm_verdict"), ((k % 50) / 50).alias("llm_confidence"),
    )


@query(f"""WITH {_CANDIDATES_SQL}, g AS (SELECT person_id, 'n' || person_id AS name, count(*) AS n, max(CASE WHEN llm_verdict = 'accept' THEN llm_confidence END) AS pick, bool_and(coalesce(llm_verdict = 'reject', FALSE)) AS none FROM candidates WHERE status = 'pending' GROUP BY ALL)
    SELECT person_id, n, CASE WHEN pick IS NOT NULL THEN 0 WHEN none THEN 2 ELSE 1 END AS tier, round(coalesce(pick, 0), 6) AS confidence FROM g""")
def q_review_order(spark, d):
    rows = _reviewed(spark, d).withColumn("name", F.concat(F.lit("n"), F.col("person_id").cast("string")))
    return review.review_order(rows).select("person_id", "n", "tier", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_CANDIDATES_SQL}, p AS (SELECT *, bool_or(source = 'openalex') OVER (PARTITION BY person_id) AS indexed FROM candidates WHERE status = 'pending') SELECT id, person_id FROM p WHERE (source = 'openalex') = indexed""")
def q_offered_to_model(spark, d):
    return review.offered_to_model(_reviewed(spark, d)).select("id", "person_id")


@query(f"""WITH {_CANDIDATES_SQL}, new AS (SELECT DISTINCT person_id FROM candidates WHERE person_id % 4 = 0)
    SELECT id, person_id, status FROM candidates WHERE NOT (status = 'pending' AND person_id % 4 = 0) UNION ALL SELECT person_id, person_id, 'pending' FROM new""")
def q_candidates_refreshed(spark, d):
    rows = _reviewed(spark, d)
    found = rows.where("person_id % 4 = 0").select("person_id").distinct().select(F.col("person_id").alias("id"), "person_id", F.lit("openalex").alias("source"), F.lit("N").alias("external_id"))
    return review.refreshed(rows.withColumn("created_at", F.lit("old")), found, F.lit("new")).select("id", "person_id", "status")


@query(f"""WITH {_CANDIDATES_SQL} SELECT id, CASE WHEN status = 'pending' AND id % 3 = 0 THEN 'abstain' ELSE llm_verdict END AS llm_verdict, CASE WHEN status = 'pending' AND id % 3 = 0 THEN 'm' END AS llm_model FROM candidates""")
def q_candidates_annotated(spark, d):
    rows = _reviewed(spark, d)
    verdicts = rows.where("id % 3 = 0").select("id", F.lit("abstain").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reasoning"))
    return review.annotated(rows, verdicts, F.lit("now"), "m").select("id", "llm_verdict", "llm_model")


def _decided_sql(siblings: bool) -> str:
    """Up to three decisions a person, about the pending candidates with the least ids, from the greatest
    id to the least, one step after the other: s3 is the people's state and done what became of each."""
    step = lambda k: f"""a{k} AS (SELECT s.*, d.id AS cand, d.source, d.external_id, d.orcid AS theirs, CASE WHEN d.id IS NULL OR closed THEN NULL WHEN decision = 'merge' AND d.source = 'openalex' AND s.openalex_id IS NOT NULL THEN 'merged' WHEN decision IN ('merge', 'accept') THEN 'accepted' ELSE 'rejected' END AS how FROM s{k - 1} s LEFT JOIN dec d ON d.person_id = s.id AND d.nth = {4 - k}),
    s{k} AS (SELECT id, CASE WHEN how = 'accepted' AND source = 'openalex' THEN coalesce(openalex_id, external_id) ELSE openalex_id END AS openalex_id, CASE WHEN how IN ('accepted', 'merged') THEN coalesce(orcid, CASE WHEN source = 'openalex' THEN theirs ELSE external_id END) ELSE orcid END AS orcid,
        CASE WHEN how = 'merged' AND external_id <> openalex_id AND NOT list_contains(alt, external_id) THEN list_append(alt, external_id) ELSE alt END AS alt, CASE WHEN how = 'accepted' THEN 'confirmed' ELSE identity_status END AS identity_status, closed OR ({siblings} AND coalesce(how = 'accepted', FALSE)) AS closed FROM a{k})"""  # noqa: E731
    return f"""{_PEOPLE_SQL}, {_CANDIDATES_SQL}, few AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY id) AS nth FROM candidates WHERE status = 'pending'),
    dec AS (SELECT *, ['accept', 'merge', 'reject', 'merge'][1 + (person_id + nth) % 4] AS decision FROM few WHERE nth <= 3 AND person_id % 5 <> 0),
    s0 AS (SELECT id, openalex_id, orcid, CASE WHEN id % 8 = 0 THEN ['X1'] ELSE [] END AS alt, identity_status, FALSE AS closed FROM people), {step(1)}, {step(2)}, {step(3)},
    done AS (SELECT id AS person_id, cand AS id, external_id, how FROM (SELECT id, cand, external_id, how FROM a1 UNION ALL SELECT id, cand, external_id, how FROM a2 UNION ALL SELECT id, cand, external_id, how FROM a3) WHERE how IS NOT NULL)"""


def _decided(spark, d, siblings: bool) -> review.State:
    rows = _reviewed(spark, d)
    people = _people(spark, d).withColumn("openalex_id_alt", F.when(F.col("id") % 8 == 0, F.array(F.lit("X1"))))
    few = rows.where("status = 'pending'").withColumn("nth", F.row_number().over(Window.partitionBy("person_id").orderBy("id"))).where("nth <= 3 AND person_id % 5 <> 0")
    decision = F.element_at(F.array(F.lit("accept"), F.lit("merge"), F.lit("reject"), F.lit("merge")), ((F.col("person_id") + F.col("nth")) % 4 + 1).cast("int"))
    return review.decided(people, rows, few.select("id", decision.alias("decision"), (-F.col("nth")).alias("pos")), F.lit("now"), reject_siblings=siblings)


@query(f"""WITH {_decided_sql(True)} SELECT c.id, coalesce(d.how, CASE WHEN c.status = 'pending' AND s.closed THEN 'rejected' END, c.status) AS status, CASE WHEN d.how IS NOT NULL OR (c.status = 'pending' AND s.closed) THEN 'now' ELSE c.decided_at END AS decided_at FROM candidates c LEFT JOIN done d ON d.id = c.id JOIN s3 s ON s.id = c.person_id""")
def q_decided_candidates(spark, d):
    return _decided(spark, d, True).candidates.select("id", "status", "decided_at")


@query(f"""WITH {_decided_sql(False)} SELECT id, openalex_id, orcid, identity_status, nullif(array_to_string(alt, ','), '') AS openalex_id_alt FROM s3""")
def q_adopted_ids(spark, d):
    return _decided(spark, d, False).people.select("id", "openalex_id", "orcid", "identity_status", F.array_join("openalex_id_alt", ",").alias("openalex_id_alt"))


@query(f"""WITH {_decided_sql(False)} SELECT person_id, 'identity_' || how AS method, external_id AS new_value FROM done WHERE how <> 'rejected'""")
def q_decision_log(spark, d):
    return _decided(spark, d, False).log.select("person_id", "method", "new_value")


@query(f"""WITH {_CANDIDATES_SQL} SELECT id, CASE WHEN status = 'merged' AND source = 'openalex' AND id % 2 = 0 THEN 'pending' ELSE status END AS status FROM candidates""")
def q_unmerged(spark, d):
    rows = _reviewed(spark, d)
    people = _people(spark, d).withColumn("openalex_id_alt", F.array(F.lit("X1"), F.lit("X2")))
    return review.unmerged(people, rows, rows.where("id % 2 = 0").select("id"), F.lit("now")).candidates.select("id", "status")


@query(f"""WITH {_PEOPLE_SQL}, {_CANDIDATES_SQL}, gone AS (SELECT person_id, list(DISTINCT external_id) AS x FROM candidates WHERE status = 'merged' AND source = 'openalex' AND id % 2 = 0 GROUP BY person_id)
    SELECT id, nullif(concat_ws(',', CASE WHEN NOT coalesce(list_contains(x, 'X1'), FALSE) THEN 'X1' END, CASE WHEN NOT coalesce(list_contains(x, 'X2'), FALSE) THEN 'X2' END), '') AS openalex_id_alt FROM people LEFT JOIN gone ON person_id = id""")
def q_unmerged_people(spark, d):
    rows = _reviewed(spark, d)
    people = _people(spark, d).withColumn("openalex_id_alt", F.array(F.lit("X1"), F.lit("X2")))
    return review.unmerged(people, rows, rows.where("id % 2 = 0").select("id"), F.lit("now")).people.select("id", F.array_join("openalex_id_alt", ",").alias("openalex_id_alt"))


@query(f"""WITH {_CANDIDATES_SQL} SELECT id, CASE WHEN person_id % 10 = 3 AND status = 'pending' THEN 'rejected' ELSE status END AS status, CASE WHEN person_id % 10 = 3 AND status = 'pending' THEN 'now' ELSE decided_at END AS decided_at FROM candidates""")
def q_not_findable(spark, d):
    people = _people(spark, d)
    return review.not_findable(people, _reviewed(spark, d), people.where("id % 10 = 3").select("id"), F.lit("now")).candidates.select("id", "status", "decided_at")


@query(f"""WITH {_PEOPLE_SQL} SELECT id, CASE WHEN identity_status = 'not_found' AND (coalesce(pi_eligible = 0, FALSE) OR coalesce(title LIKE '%Emeritus%', FALSE)) THEN 'no_footprint' ELSE identity_status END AS identity_status FROM people""")
def q_without_footprint(spark, d):
    return review.without_footprint(_people(spark, d).withColumn("job_code_description", F.lit(None).cast("string")), F.lit("now"))[0].select("id", "identity_status")


@query(f"""WITH {_PEOPLE_SQL}, {_CANDIDATES_SQL} SELECT c.id, CASE WHEN c.source <> 'openalex' OR c.score < 1.0 THEN 'not_eligible' WHEN p.openalex_id IS NULL THEN 'skipped_no_primary' WHEN coalesce(c.llm_verdict = 'reject', FALSE) THEN 'skipped_llm_reject' WHEN coalesce(c.orcid = p.orcid, FALSE) THEN 'merged' ELSE 'skipped_no_orcid_match' END AS reason
    FROM candidates c JOIN people p ON p.id = c.person_id WHERE c.status = 'pending'""")
def q_merge_outcomes(spark, d):
    return review.merge_outcomes(_reviewed(spark, d).withColumn("email", F.lit(None).cast("string")), _people(spark, d)).select("id", "reason")


@query("""WITH h AS (SELECT user_id AS person_id, (event_id % 3)::INT AS tier, event_id AS pos, 'X' || (event_id % 7) AS external_id, (value % 10) / 10.0 AS score, event_type = 'purchase' AS affiliated FROM events),
    good AS (SELECT * FROM h WHERE score >= 0.6 AND (tier < 2 OR coalesce(affiliated, FALSE))), once AS (SELECT *, row_number() OVER (PARTITION BY person_id, tier, external_id ORDER BY pos) AS nth FROM good),
    kept AS (SELECT *, min(tier) OVER (PARTITION BY person_id) AS least FROM once WHERE nth = 1 OR tier <> 1)
    SELECT person_id, external_id, pos, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, pos) AS place FROM kept WHERE tier = least""")
def q_recall_cascade(spark, d):
    e = F.col("event_id")
    hits = table(spark, d, "events").select(F.col("user_id").alias("person_id"), (e % 3).cast("int").alias("tier"), e.alias("pos"), F.concat(F.lit("X"), (e % 7).cast("string")).alias("external_id"), ((F.col("value") % 10) / 10).alias("score"), (F.col("event_type") == "purchase").alias("affiliated"))
    return review.recall_cascade(hits).select("person_id", "external_id", "pos", F.col("place").cast("long").alias("place"))


@query("SELECT user_id AS person_id, 'o' || event_id AS external_id, 0.8::DOUBLE AS score, event_id % 3 = 1 AS unique_hit FROM events WHERE event_id % 5 <> 0 AND event_type = 'purchase'")
def q_register_candidate(spark, d):
    e = F.col("event_id")
    found = table(spark, d, "events").select(F.col("user_id").alias("person_id"), F.when(e % 5 != 0, F.concat(F.lit("o"), e.cast("string"))).alias("orcid"), (e % 3).alias("hits"), (F.col("event_type") == "purchase").alias("affiliated"), F.lit(True).alias("employed"), F.lit(1.0).alias("name_similarity"), F.lit(False).alias("email_match"))
    return review.register_candidate(found).select("person_id", "external_id", F.col("score").cast("double").alias("score"), "unique_hit")


@query("""SELECT event_id, event_type = 'purchase' AND value > 20 AND event_id % 3 = 0 AS may, coalesce(value > 50, FALSE) AND event_id % 2 = 0 AS confirms, event_id % 10 = 0 OR (event_id % 2 = 0 AND value > 50 AND event_id % 3 = 0) AS qualifies FROM events""")
def q_identity_prechecks(spark, d):
    e, v = F.col("event_id"), F.col("value")
    source, name = F.when(F.col("event_type") == "purchase", "openalex").otherwise("orcid"), F.when(e % 3 == 0, 1.0).otherwise(0.8)
    may = review.may_corroborate(source, name, F.lit(True), v > 20, F.lit("o"))
    return table(spark, d, "events").select("event_id", may.alias("may"), review.corroborates(v > 50, F.when(e % 2 == 0, 0.95).otherwise(0.5)).alias("confirms"), review.fallback_qualifies(F.when(e % 10 == 0, True), e % 2 == 0, v > 50, name).alias("qualifies"))


@query(r"""SELECT p_partkey, len(w) >= 2 AND regexp_replace(lower(w[1]), '[^a-z]', '', 'g') = lower(p_type) AND regexp_replace(lower(w[-1]), '[^a-z]', '', 'g') = 'brand' AS exact FROM (
    SELECT p_partkey, p_type, regexp_split_to_array(CASE WHEN p_size % 2 = 0 THEN p_type || ' ' || p_name || ' ' || upper(p_brand) WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 5 = 0 THEN p_type ELSE lower(p_type) || ' ' || p_brand END, '\s+') AS w FROM part)""")
def q_exact_primary_name(spark, d):
    """Part types and brands as people's names, shown with other words between, others instead, or alone."""
    size = F.col("p_size")
    shown = F.when(size % 2 == 0, F.concat_ws("  ", F.lit(""), "p_type", "p_name", F.upper("p_brand"))).when(size % 3 == 0, F.col("p_name")).when(size % 5 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", F.lower("p_type"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", review.exact_primary_name(F.col("p_type"), F.lit("Brand"), shown).alias("exact"))


# Reconciling

_ROSTER_SQL = """roster AS (SELECT c_custkey AS id, 'L' || (c_custkey % 29) || ', F' || (c_custkey % 11) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'n' || c_custkey || '@x.edu' END AS mail, CASE c_custkey % 4 WHEN 0 THEN 'PROF-AY' WHEN 1 THEN 'ASSOC PROF IN RES' WHEN 2 THEN 'DIRECTOR' ELSE ' lecturer ' END AS job, CASE c_custkey % 3 WHEN 0 THEN 'ANESTHESIA/PAIN MED-OB' WHEN 1 THEN 'o''brien 3rd ' || lower(c_mktsegment) ELSE ' ' END AS unit, CASE c_custkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' ELSE '' END AS flag, CASE WHEN c_custkey % 9 = 0 THEN 'Leave' ELSE '' END AS st FROM customer WHERE c_custkey % 2 = 0)"""


def _roster(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda head, x, tail="": F.concat(F.lit(head), x.cast("string"), F.lit(tail))
    return table(spark, d, "customer").where(k % 2 == 0).select(
        k.alias("id"), F.concat(text("L", k % 29, ", "), text("F", k % 11)).alias(reconcile.NAME), F.when(k % 3 == 0, "").otherwise(text("n", k, "@x.edu")).alias(reconcile.EMAIL),
        F.when(k % 4 == 0, "PROF-AY").when(k % 4 == 1, "ASSOC PROF IN RES").when(k % 4 == 2, "DIRECTOR").otherwise(" lecturer ").alias("Job Code Description"),
        F.when(k % 3 == 0, "Y").when(k % 3 == 1, "n").otherwise("").alias("PI Eligibility Flag Current"), F.when(k % 9 == 0, "Leave").otherwise("").alias(reconcile.STATUS),
        F.when(k % 3 == 0, "ANESTHESIA/PAIN MED-OB").when(k % 3 == 1, F.concat(F.lit("o'brien 3rd "), F.lower("c_mktsegment"))).otherwise(" ").alias("Dept / Unit"),
    )


def _applied(spark, d) -> DataFrame:
    roster = _roster(spark, d)
    matched = roster.select("id", F.struct(*(F.col(c) for c in roster.columns if c != "id")).alias("_roster"))
    return reconcile.applied(_people(spark, d).withColumn("pi_eligible", F.col("pi_eligible").cast("boolean")), matched)


_TITLE_SQL = "CASE r.id % 4 WHEN 0 THEN 'Professor' WHEN 3 THEN 'Lecturer' WHEN 1 THEN 'Associate Professor' END"


@query(f"""WITH {_PEOPLE_SQL}, {_ROSTER_SQL} SELECT p.id, CASE WHEN r.id IS NOT NULL THEN 'F' || (r.id % 11) ELSE p.first_name END AS first_name, coalesce(nullif(r.mail, ''), p.email) AS email, coalesce({_TITLE_SQL}, p.title) AS title,
    CASE WHEN r.flag IN ('Y', 'n') THEN r.flag = 'Y' ELSE p.pi_eligible = 1 END AS pi_eligible, coalesce(nullif(r.st, ''), CASE WHEN r.id IS NOT NULL AND coalesce(p.eah_status, '') IN ('', 'Inactive', 'Duplicate') THEN 'Active' END, p.eah_status) AS eah_status, CASE WHEN r.id IS NOT NULL THEN trim(r.job) END AS job_code_description
    FROM people p LEFT JOIN roster r ON r.id = p.id""")
def q_roster_applied(spark, d):
    return _applied(spark, d).select("id", "first_name", "email", "title", "pi_eligible", "eah_status", "job_code_description")


@query(f"""WITH {_PEOPLE_SQL}, {_ROSTER_SQL} SELECT count(*) FILTER (WHERE r.mail <> '') AS email, count(*) FILTER (WHERE coalesce(p.first_name, '') <> 'F' || (r.id % 11)) AS first_name, 0 AS last_name, count(*) FILTER (WHERE {_TITLE_SQL} IS DISTINCT FROM p.title AND {_TITLE_SQL} IS NOT NULL) AS title FROM people p JOIN roster r ON r.id = p.id""")
def q_roster_changes(spark, d):
    return reconcile.change_counts(_applied(spark, d))


@query(f"WITH {_ROSTER_SQL} SELECT 'F' || (r.id % 11) AS first_name, 'L' || (r.id % 29) AS last_name, coalesce({_TITLE_SQL}, '') AS title, r.mail AS email, 'unresolved' AS identity_status, coalesce(nullif(r.st, ''), 'Active') AS eah_status, trim(r.job) AS job_code_description, '' AS vc_area, CASE WHEN r.flag <> '' THEN r.flag = 'Y' END AS pi_eligible, CASE r.id % 3 WHEN 0 THEN 'Anesthesia/Pain Med-Ob' WHEN 1 THEN 'O''Brien 3Rd ' || upper(r.unit[13:13]) || r.unit[14:] ELSE '' END AS subdepartment, trim(r.unit) AS department_unit, '' AS department_eah FROM roster r")
def q_roster_created(spark, d):
    return reconcile.created(_roster(spark, d)).select("first_name", "last_name", "title", "email", "identity_status", "eah_status", "job_code_description", "vc_area", "pi_eligible", "subdepartment", "department_unit", "department_eah")


@query(f"WITH {_PEOPLE_SQL} SELECT id, CASE id % 6 WHEN 0 THEN 'Inactive' WHEN 1 THEN 'Duplicate' ELSE eah_status END AS eah_status FROM people")
def q_marked_gone(spark, d):
    people = _people(spark, d)
    outcomes = people.select(F.col("id").alias("person_id"), F.when(F.col("id") % 6 == 0, "inactive").when(F.col("id") % 6 == 1, "duplicate").otherwise("matched").alias("outcome"))
    return reconcile.marked_gone(people, outcomes).select("id", "eah_status")


#: Codes as rosters spell them, each with the title that it stands for, in front of a part's own words.
_JOBS = {
    "PROF-": "Professor", " prof ": "Professor", "ASSOC PROF-": "Associate Professor", "ASST PROF ": "Assistant Professor", "PROF IN RES-": "Professor", "ASST DEAN ": "Assistant Dean", "DEAN ": "Dean",
    "VISITING ": "Visiting Professor", "COLLEGE PROVOST ": "College Provost", "ACT PROF-": "Acting Professor", "PROFESSIONAL ": None, "DIRECTOR, PROF ": None, "LECT": None, "": None,
}


@query(f"""WITH j AS (SELECT unnest({list(_JOBS)}) AS code, unnest([{', '.join('NULL' if t is None else repr(t) for t in _JOBS.values())}]) AS title) SELECT p_partkey, code, title FROM part, j""")
def q_title_map(spark, d):
    """Every code before every part's name: only the code's beginning tells."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, _JOBS))).alias("code"))
    return rows.select("p_partkey", "code", rules.by_pattern(F.concat("code", "p_name"), rules.TITLES).alias("title"))


# Texts


@query(r"""SELECT doc_id, 'PERSON (from the roster):' || chr(10) || 'Name: Ann L' || doc_id || chr(10) || 'Division or school: ' || source || CASE WHEN n_chars % 2 = 0 THEN chr(10) || 'Email domain: ' || lang || '.x.edu' ELSE '' END || CASE WHEN t <> '' THEN chr(10) || 'Research interests: ' || left(t, 400) ELSE '' END AS block
    FROM (SELECT *, regexp_replace(coalesce(text, ''), '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g') AS t FROM documents)""")
def q_person_block(spark, d):
    email = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("a@"), F.col("lang"), F.lit(".x.edu"))).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", prompts.person_block(F.lit("Ann"), F.concat(F.lit("L"), F.col("doc_id").cast("string")), F.lit(""), F.col("source"), email, F.col("text")).alias("block"))


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'copyright') THEN 'Rights.' WHEN contains(t, 'password') THEN 'Secret.' WHEN contains(t, 'thereon') THEN 'There.' WHEN contains(t, ' la ') THEN 'La.' ELSE 'Something failed.' END AS said FROM t""")
def q_friendly_error(spark, d):
    """The documents as messages: by the first known part in their order, not in the text's."""
    known = [("Copyright", "Rights."), ("password", "Secret."), ("THEREON", "There."), (" la ", "La.")]
    return table(spark, d, "documents").select("doc_id", prompts.friendly_error(F.col("text"), known, "Something failed.").alias("said"))


#: A reply for each order, from its lines, in one of the shapes that replies have.
_REPLY_SQL = """SELECT l_orderkey, CASE WHEN kind = 'F' AND n >= 2 THEN NULL ELSE '[' || string_agg('{"id":' || l_partkey || ',"why":"' || l_returnflag || ' ] } ' || l_linenumber || '"}', ',' ORDER BY l_partkey, l_linenumber, l_returnflag) || ']' END AS list FROM (
    SELECT *, any_value(kind_) OVER w AS kind, count(*) OVER w AS n FROM (SELECT l.*, o_orderstatus AS kind_ FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey) WINDOW w AS (PARTITION BY l_orderkey)) GROUP BY l_orderkey, kind, n"""


@query(_REPLY_SQL)
def q_list_of_reply(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").distinct()
    entry = F.struct("l_partkey", "l_linenumber", "l_returnflag", F.struct(F.col("l_partkey").alias("id"), F.concat("l_returnflag", F.lit(" ] } "), F.col("l_linenumber").cast("string")).alias("why")).alias("e"))
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("all"), F.count("*").alias("n"))
    rows = lists.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    list_ = F.to_json(F.transform("all", lambda x: x["e"]))
    wrapped = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    # alone; under a known key behind another list; under any key; or not as a list at all
    reply = F.when(F.col("o_orderstatus") == "O", F.when(F.col("n") > 3, list_).otherwise(wrapped('{"results": [9], "matches": ', list_, "}"))).when(F.col("o_orderstatus") == "P", wrapped('{"note": "[1]", "n": 2, "chosen": ', list_, ', "more": [3]}'))
    reply = reply.otherwise(F.when(F.col("n") >= 2, wrapped('{"all": {"in": ', list_, "}}")).otherwise(wrapped('{"faculty_matches": ', list_, "}")))
    return rows.select("l_orderkey", jsonx.list_of(reply).alias("list"))


@query("""WITH a AS (SELECT DISTINCT p_brand, p_type, p_size FROM part), n AS (SELECT p_brand, p_type, count(*) AS n, min(p_size) AS size FROM a WHERE p_size % 3 <> 0 GROUP BY ALL)
    SELECT b.p_brand, t.p_type, CASE WHEN n = 1 THEN upper(t.p_type) || ' Roy ' || lpad(size::VARCHAR, 4, '0') END AS author FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN n USING (p_brand, p_type)""")
def q_author_search(spark, d):
    """A search's reply for each brand: an author for each type and size, numbered where namesakes have
    numbers. A name is found if one person has it."""
    a = table(spark, d, "part").select("p_brand", "p_type", "p_size").distinct()
    name = F.concat(F.upper("p_type"), F.when(F.col("p_size") % 3 == 0, F.lit(" Royce ")).otherwise(F.lit(" Roy ")), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    hit = F.struct(F.struct(F.concat(F.lit(" "), name).alias("author"), F.lit("x").alias("url")).alias("info"))
    reply = F.to_json(F.struct(F.struct(F.struct(F.collect_list(hit).alias("hit")).alias("hits")).alias("result")))
    asked = a.groupBy("p_brand").agg(reply.alias("raw")).crossJoin(F.broadcast(a.select("p_type").distinct()))  # a row for each of the few types
    return asked.select("p_brand", "p_type", payloads.dblp_author(F.col("raw"), F.concat(F.initcap("p_type"), F.lit(" roy "))).alias("author"))


_ARTICLES_SQL = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice, l_returnflag) AS place, 'Part ' || l_partkey || ' & < ' || p_name AS title, CASE WHEN l_linenumber % 3 <> 0 THEN year(l_shipdate)::INTEGER END AS year,
    CASE WHEN l_returnflag <> 'R' THEN p_type END AS journal, CASE WHEN l_linestatus = 'F' THEN '10.1/' || l_suppkey END AS doi FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"""


@query(f"SELECT * FROM ({_ARTICLES_SQL}) WHERE place <= 20")
def q_article_set(spark, d):
    """An article set in XML for each order, an article for each line, with marks in titles and parts
    that some articles lack."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    year = F.year("l_shipdate").cast("string")
    date = F.when(F.col("l_linenumber") % 3 != 0, cat("<Year>", year, "</Year>")).otherwise(cat("<MedlineDate>", year, " Spring</MedlineDate>"))
    journal = F.when(F.col("l_returnflag") != "R", cat("<Title>", F.col("p_type"), "</Title>")).otherwise("")
    ids = F.when(F.col("l_linestatus") == "F", cat('<ELocationID EIdType="pii">S1</ELocationID><ELocationID EIdType="doi">10.1/', F.col("l_suppkey").cast("string"), "</ELocationID>")).otherwise("")
    one = cat("<PubmedArticle><MedlineCitation><Article><Journal><JournalIssue><PubDate>", date, "</PubDate></JournalIssue>", journal, "</Journal><ArticleTitle><i>Part</i> ", F.col("l_partkey").cast("string"), " &amp; &lt; ", F.col("p_name"), "</ArticleTitle>", ids, "</Article></MedlineCitation></PubmedArticle>")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice", "l_returnflag"]
    sets = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order, one.alias("x")))).alias("all"))
    raw = F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.transform("all", lambda a: a["x"]), ""), F.lit("</PubmedArticleSet>"))
    rows = sets.select("l_orderkey", F.posexplode(payloads.pubmed_articles(raw)).alias("place", "a"))
    return rows.select("l_orderkey", (F.col("place") + 1).cast("long").alias("place"), F.col("a.title"), F.col("a.year"), F.col("a.journal"), F.col("a.doi"))


@query(f"""{_FOLD_SQL}, r AS (SELECT person, members, members[1].score AS top, round(members[1].score - runner, 9) > 0.05 AS clear, k % 2 = 0 AS corroborated FROM last)
    SELECT c.person, c.x.id AS external_id, CASE WHEN NOT (clear AND (top >= 0.9 OR corroborated)) THEN 'pending' WHEN c.x.id = canonical THEN 'accept' WHEN list_contains(list_transform(members, lambda m: m.id), c.x.id) THEN 'merge' ELSE 'reject' END AS decision FROM c JOIN r USING (person) JOIN chosen USING (person)""")
def q_resweep(spark, d):
    """Cliques of many candidates: the canonical profile is accepted, its clique merged, the rest rejected."""
    people = _candidates(spark, d).withColumns({"status_before": F.lit("unresolved"), "corroborated": F.size("candidates") % 2 == 0, "fallback_ok": F.lit(False)})
    return review.resweep(identity.resolve(people)).select("person", "external_id", "decision")
