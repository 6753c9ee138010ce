"""Queries of look-ups in captured replies, of requirements, and of the whole reconciliation, with their SQL.

Replies are written from the tables' columns; the SQL works from the columns, never from the replies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.catalog import _LINKED_SQL, _sides, once, query, table
from tarnwick.functions import prompts, text
from tarnwick.operators import identity
from tarnwick.plans import context, reconcile
from tarnwick.sources import lookups, payloads

# Authors

_KIN_SQL = """people AS (SELECT c_custkey AS id, ['Ann', 'Anna', 'Bo', 'Cy'][1 + c_custkey % 4] AS first, ['Lee', 'Roy', 'Wu'][1 + c_nationkey % 3] AS last, CASE WHEN c_custkey % 3 = 0 THEN 'A' || (c_custkey * 2) END AS openalex_id, CASE WHEN c_custkey % 5 < 3 THEN '0000-' || (c_custkey % 70) END AS orcid FROM customer),
    records AS (SELECT 'A' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '0000-' || p_size END AS orcid FROM part),
    hits AS (SELECT o_custkey AS id, o_orderkey, ['Ann', 'Annabel', 'Bo', 'C.', 'Di'][1 + o_orderkey % 5] AS first, ['Lee', 'Roy', 'Wu', 'Lee-Roy'][1 + floor(o_totalprice)::BIGINT % 4] AS last FROM orders)"""


def _kin(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return table(spark, d, "customer").select(k.alias("person_id"), pick(["Ann", "Anna", "Bo", "Cy"], k).alias("first"), pick(["Lee", "Roy", "Wu"], F.col("c_nationkey")).alias("last"), F.when(k % 3 == 0, cat("https://x.org/A", k * 2)).alias("openalex_id"), F.when(k % 5 < 3, cat("0000-", k % 70)).alias("orcid"))


@query(f"""WITH {_KIN_SQL}, one AS (SELECT p.id, r.id AS author_id FROM people p JOIN records r ON r.id = p.openalex_id), two AS (SELECT p.id, min(r.id) AS author_id FROM people p JOIN records r ON r.orcid = p.orcid WHERE p.id NOT IN (SELECT id FROM one) GROUP BY p.id),
    fit AS (SELECT p.id, 'H' || h.o_orderkey AS author_id FROM people p JOIN hits h ON h.id = p.id WHERE p.id NOT IN (SELECT id FROM one UNION ALL SELECT id FROM two)
        AND CASE WHEN h.last = p.last THEN h.first = p.first OR starts_with(h.first, p.first) OR starts_with(p.first, regexp_replace(h.first, '[^A-Za-z]', '', 'g')) WHEN contains(h.last, p.last) THEN h.first = p.first END)
    SELECT id AS person_id, author_id, 'id' AS via FROM one UNION ALL SELECT id, author_id, 'orcid' FROM two UNION ALL SELECT id, min(author_id), 'name' FROM fit GROUP BY id HAVING count(*) = 1""")
def q_find_author(spark, d):
    """Authors by stored id, by ORCID, and as the only likely hit of a search with some ten hits."""
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    part = table(spark, d, "part")
    records = part.select(F.to_json(F.struct(cat("https://x.org/A", F.col("p_partkey")).alias("id"), F.when(F.col("p_size") % 2 == 0, cat("https://orcid.org/0000-", F.col("p_size"))).alias("orcid"), F.col("p_name").alias("display_name"))).alias("payload"))
    o = F.col("o_orderkey")
    name = F.concat_ws(" ", pick(["Ann", "Annabel", "Bo", "C.", "Di"], o), F.lit("X."), pick(["Lee", "Roy", "Wu", "Lee-Roy"], F.floor("o_totalprice").cast("long")))
    # the name stands as an alias of every other hit
    hit = F.struct(cat("https://x.org/H", o).alias("id"), F.when(o % 2 == 0, name).otherwise("Nobody").alias("display_name"), F.when(o % 2 != 0, F.array(F.lit("Else"), name)).alias("display_name_alternatives"))
    searches = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.to_json(F.struct(F.collect_list(hit).alias("results"))).alias("payload"))
    return lookups.find_author(_kin(spark, d), records, searches)


@query("""WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events), a AS (SELECT t.*, p.* FROM t, (SELECT paper, place FROM range(4) AS a(paper), range(3) AS b(place)) p WHERE nth <= 3 AND event_type <> 'error'),
    n AS (SELECT *, (event_id * 7 + paper * 3 + place) % 11 AS r FROM a)
    SELECT user_id AS person_id, arg_min('S' || event_id || '-' || paper || '-' || place, nth * 100 + paper * 10 + place) AS author_id FROM n WHERE paper < 3 AND (r = 4 OR (r = 5 AND user_id % 2 = 0)) GROUP BY user_id""")
def q_author_by_papers(spark, d):
    """Users' first events as papers, each found with four papers of three authors."""
    e = F.col("event_id")
    ranked = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("T"), e.cast("string"))).alias("title")))).alias("t"))
    people = ranked.select(F.col("user_id").alias("person_id"), F.lit("Wael").alias("first"), F.lit("Al-Lee").alias("last"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("o"), F.col("user_id").cast("string"))).alias("orcid"), F.transform("t", lambda x: x["title"]).alias("titles"))

    def author(paper: int, place: int):
        r = (e * 7 + paper * 3 + place) % 11
        name = F.when(r == 4, "W. K. Al-Lee").when(r == 3, "B. Al-Lee").when(r == 2, "Wael Lee").otherwise("Else")
        return F.struct(F.concat(F.lit("S"), e.cast("string"), F.lit(f"-{paper}-{place}")).alias("authorId"), name.alias("name"), F.when(r == 5, F.struct(F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("ORCID"))).alias("externalIds"))

    data = F.array(*(F.struct(F.array(*(author(p, a) for a in range(3))).alias("authors")) for p in range(4)))
    searches = table(spark, d, "events").select(F.concat(F.lit("T"), e.cast("string")).alias("title"), F.to_json(F.struct(data.alias("data"))).alias("payload"))
    return lookups.author_by_papers(people, searches)


_FUNDED_SQL = """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), asked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS nth FROM l WHERE l_suppkey % 4 <> 0),
    f AS (SELECT l_orderkey, nth, k AS spot, CASE WHEN k = 0 THEN upper(p_type) ELSE p_type END AS agency, CASE WHEN p_size % 3 = 0 THEN [] ELSE list_transform(range(p_size % 7 + 1), lambda i: 'G' || i)[1:5] END AS awards FROM asked JOIN part ON p_partkey = l_partkey, range(2) AS r(k) WHERE nth <= 8 AND p_size % 5 <> 0),
    u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(agency), awards ORDER BY nth, spot) = 1)
    SELECT l_orderkey AS person_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY nth, spot) AS place, agency, awards FROM u"""


@query(f"SELECT * FROM ({_FUNDED_SQL}) WHERE place <= 15")
def q_fundings_of_works(spark, d):
    """Orders as people, their parts as works with funders in two spellings."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    doi = F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" 10.1/"), F.col("l_partkey").cast("string")))
    people = lines.groupBy(F.col("l_orderkey").alias("person_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", doi.alias("doi")))), lambda x: x["doi"]).alias("dois"))
    size = F.col("p_size")
    awards = F.when(size % 3 != 0, F.transform(F.sequence(F.lit(0), size % 7), lambda i: F.concat(F.lit("G"), i.cast("string"))))
    funder = lambda n: F.struct(n.alias("name"), awards.alias("award"))
    funders = F.when(size % 5 != 0, F.array(funder(F.upper("p_type")), funder(F.col("p_type")), funder(F.lit(""))))
    works = table(spark, d, "part").select(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"), F.to_json(F.struct(F.struct(funders.alias("funder")).alias("message"))).alias("payload"))
    return lookups.fundings_of_works(people, works).select("person_id", F.col("place").cast("long").alias("place"), "agency", "awards")


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, n - 1 AS place, 'awards' AS kind, regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') AS name, CASE WHEN turn % 2 = 0 THEN (2000 + turn)::INTEGER END AS year FROM t WHERE n <= 20
    UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, 'grants', text, NULL FROM t WHERE n <= 15 AND role = 'user'""")
def q_orcid_activities(spark, d):
    """Conversations as ORCID records: every turn an award, the user's also a grant."""
    t = table(spark, d, "conversations")
    year = F.struct(F.struct(F.when(F.col("turn") % 2 == 0, (2000 + F.col("turn")).cast("string")).otherwise("n.d.").alias("value")).alias("year")).alias("start-date")
    award = F.struct(F.array(F.struct(F.struct(F.concat(F.lit(" "), "text", F.lit(" ")).alias("role-title"), F.struct(F.col("role").alias("name")).alias("organization"), year).alias("distinction-summary"))).alias("summaries"))
    title = F.struct(F.struct(F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("value")).alias("title")).alias("title")
    grant = F.struct(F.array(F.struct(title, F.struct(F.lit("NIH").alias("name")).alias("organization")), F.struct(F.struct(F.struct(F.lit("second").alias("value")).alias("title")).alias("title"), F.struct(F.lit("no").alias("name")).alias("organization"))).alias("funding-summary"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", award.alias("a"), grant.alias("g")))).alias("all"))
    raw = F.to_json(F.struct(F.struct(F.struct(F.transform("all", lambda x: x["a"]).alias("affiliation-group")).alias("distinctions"), F.struct(F.transform("all", lambda x: x["g"]).alias("group")).alias("fundings")).alias("activities-summary")))
    rows = rows.select("conv_id", raw.alias("raw"))
    awards = rows.select("conv_id", F.posexplode(payloads.orcid_distinctions(F.col("raw"))).alias("place", "a")).select("conv_id", "place", F.lit("awards").alias("kind"), F.regexp_replace("a.name", r"^\s+|\s+$", "").alias("name"), "a.year")
    grants = rows.select("conv_id", F.posexplode(payloads.orcid_fundings(F.col("raw"))).alias("place", "g")).select("conv_id", "place", F.lit("grants"), "g.title", F.lit(None).cast("int"))
    return awards.union(grants).withColumn("place", F.col("place").cast("long"))


@query("""SELECT event_id, CASE WHEN event_type <> 'purchase' THEN 'not_an_accept' WHEN user_id % 7 = 0 THEN 'candidate_not_listed' WHEN NOT coalesce(value > 20, FALSE) OR user_id % 5 = 0 THEN 'employment_not_verified' WHEN user_id % 3 = 0 THEN 'name_similarity_below_floor' WHEN value / 100 < 0.95 THEN 'confidence_below_threshold' ELSE 'ok' END AS reason FROM events""")
def q_register_guardrail(spark, d):
    kind, user, value = F.col("event_type"), F.col("user_id"), F.col("value")
    name = F.when(user % 3 == 0, F.when(user % 2 == 0, 0.89)).otherwise(0.9)
    reason = identity.register_guardrail(F.when(kind == "purchase", "accept").otherwise("abstain"), user % 7 != 0, F.when(user % 5 != 0, value > 20), name, value / 100)
    return table(spark, d, "events").select("event_id", reason.alias("reason"))


@query(r"""WITH s AS (SELECT item_id, string_split(lower(text), ',') AS parts, string_split(lower(text), '.') AS sentences FROM benchmark), w AS (SELECT item_id, list_transform(parts, lambda t: regexp_replace(t, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')) AS whole, sentences FROM s)
    SELECT item_id, list_sort(list_distinct(list_concat(whole, list_filter(flatten(list_transform(list_concat(whole, sentences), lambda t: regexp_split_to_array(t, '[\s\x0B\x{85}\p{Z}]+'))), lambda x: length(x) > 3)))) AS keywords FROM w""")
def q_requirement_keywords(spark, d):
    parts = F.split("text", ",")
    half = (F.size(parts) / 2).cast("int")
    words = text.requirement_keywords(F.slice(parts, F.lit(1), half), F.slice(parts, half + 1, F.size(parts)), F.split("text", r"\."))
    return table(spark, d, "benchmark").select("item_id", F.array_sort(words).alias("keywords"))


# The whole reconciliation

_EXCLUDED = ("3", "7")


@once
def _reconciled(spark, d) -> reconcile.Reconciled:
    people, roster = _sides(spark, d)
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    ours = people.join(c.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").cast("string").alias("department"), "c_acctbal"), "person_id")
    status = F.when(F.col("c_acctbal") < 0, "Inactive").when(F.col("c_acctbal") < 3000, "Active")
    ours = ours.select(F.col("person_id").alias("id"), F.col("first").alias("first_name"), F.col("last").alias("last_name"), "email", "department", F.lit("Professor").alias("title"), status.alias("eah_status"))
    theirs = roster.join(s.select(F.col("s_suppkey").alias("roster_id"), F.col("s_nationkey").cast("string").alias("Division / School"), "s_acctbal"), "roster_id")
    extract = theirs.select((F.col("pos") * 2).alias("pos"), F.concat_ws(", ", "last", "first").alias(reconcile.NAME), F.col("email").alias(reconcile.EMAIL), "Division / School", F.when(F.col("s_acctbal") > 0, "PROF-AY").otherwise("LECTURER").alias("Job Code Description"))
    # a second row of some, without a professorship, in the next division
    again = theirs.where("roster_id % 4 = 1").select((F.col("pos") * 2 - 1).alias("pos"), F.concat_ws(", ", "last", "first"), F.upper("email"), ((F.col("Division / School").cast("int") + 1) % 25).cast("string"), F.lit("STAFF"))
    return reconcile.run(ours, extract.union(again), F.col("Division / School"), _EXCLUDED)


_RUN_SQL = f"""{_LINKED_SQL}, twice AS (SELECT s_suppkey, s_nationkey AS div, TRUE AS main, s_acctbal > 0 AS prof FROM supplier UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25, FALSE, FALSE FROM supplier WHERE s_suppkey % 4 = 1),
    best AS (SELECT s_suppkey, arg_min(div, (NOT prof)::INT * 2 + main::INT) AS div FROM twice GROUP BY s_suppkey), c AS (SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY person_id) = 1 AS claimed FROM linked),
    o AS (SELECT c_custkey, c_nationkey, c_acctbal, roster_id, div, CASE WHEN roster_id IS NULL AND c_nationkey IN (3, 7) THEN 'frozen' WHEN roster_id IS NULL THEN 'inactive' WHEN NOT claimed THEN 'duplicate' WHEN div IN (3, 7) THEN 'kept' WHEN div <> c_nationkey THEN 'moved' ELSE 'matched' END AS outcome FROM customer LEFT JOIN c ON person_id = c_custkey LEFT JOIN best ON s_suppkey = roster_id),
    added AS (SELECT DISTINCT s_suppkey, div FROM twice WHERE div NOT IN (3, 7) AND s_suppkey NOT IN (SELECT roster_id FROM linked))"""


@query(f"""WITH {_RUN_SQL[5:]}, f AS (SELECT o.*, p.mail, t.mail AS theirs, p.f, t.f AS tf, p.l, t.l AS tl, s_acctbal FROM o LEFT JOIN p ON person_id = c_custkey LEFT JOIN r t USING (roster_id) LEFT JOIN supplier ON s_suppkey = roster_id WHERE outcome IN ('matched', 'moved'))
    SELECT (SELECT count(*) FILTER (WHERE outcome IN ('matched', 'moved')) FROM o) AS total_matched, (SELECT count(*) FILTER (WHERE outcome = 'moved') FROM o) AS total_moved, (SELECT count(*) FILTER (WHERE outcome = 'inactive') FROM o) AS total_removed_inactive, (SELECT count(*) FROM twice) AS roster_rows, (SELECT count(*) FROM added) AS total_new_added""")
def q_reconcile_summary(spark, d):
    return _reconciled(spark, d).summary.select("total_matched", "total_moved", "total_removed_inactive", "roster_rows", "total_new_added")


@query(f"""WITH {_RUN_SQL[5:]} SELECT div::VARCHAR AS division, count(DISTINCT s_suppkey) AS roster_people, count(DISTINCT s_suppkey) FILTER (WHERE (s_suppkey, div) IN (SELECT (s_suppkey, div) FROM added)) AS new_added FROM twice GROUP BY div""")
def q_reconcile_divisions(spark, d):
    return _reconciled(spark, d).divisions


@query(f"""WITH {_RUN_SQL[5:]}, a AS (SELECT c_custkey AS id, CASE WHEN outcome = 'moved' THEN div ELSE c_nationkey END AS department, CASE WHEN outcome = 'inactive' THEN 'Inactive' WHEN outcome = 'duplicate' THEN 'Duplicate' WHEN outcome IN ('matched', 'moved') OR c_acctbal BETWEEN 0 AND 2999.999 THEN 'Active' WHEN c_acctbal < 0 THEN 'Inactive' END AS eah_status FROM o)
    SELECT id, department::VARCHAR AS department, eah_status FROM a UNION ALL SELECT NULL, div::VARCHAR, 'Active' FROM added""")
def q_reconciled_people(spark, d):
    return _reconciled(spark, d).people.select("id", "department", "eah_status")


# Texts for a model

_LINE_SQL = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem)"""


@query(f"""WITH {_LINE_SQL}, g AS (SELECT l_orderkey, string_agg('- ' || CASE WHEN l_linenumber % 3 = 0 THEN 'Untitled' ELSE 'G' || l_partkey END || CASE WHEN l_linestatus = 'F' THEN ' (NCI)' ELSE '' END || CASE WHEN l_linenumber > 2 THEN chr(10) || '  Abstract: ' || left(repeat('abc ', l_linenumber * 20), 200) ELSE '' END, chr(10) ORDER BY n) AS x FROM l WHERE l_returnflag = 'A' AND n <= 10 GROUP BY l_orderkey),
    p AS (SELECT l_orderkey, string_agg('- P' || l_suppkey || CASE WHEN l_tax > 0.04 THEN ' (J' || l_partkey || ', ' || year(l_shipdate) || ')' ELSE '' END || CASE WHEN l_linenumber > 1 THEN chr(10) || '  Subjects: ' || array_to_string(list_transform(range(l_linenumber), lambda i: 'M' || i)[1:5], ', ') ELSE '' END, chr(10) ORDER BY n) AS x FROM l WHERE l_returnflag = 'R' AND n <= 10 GROUP BY l_orderkey),
    s AS (SELECT l_orderkey, string_agg('- S' || l_partkey, chr(10) ORDER BY n) AS x FROM l WHERE l_returnflag = 'N' AND n <= 10 GROUP BY l_orderkey), c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS person_id, CASE WHEN b <> '' THEN 'Name: N' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN ', Professor' ELSE '' END || b END AS context FROM (SELECT o_orderkey, o_orderstatus, concat(CASE WHEN o_orderpriority = '5-LOW' THEN chr(10) || chr(10) || 'Research interests: low' END, CASE WHEN o_orderstatus = 'F' THEN chr(10) || chr(10) || 'Profile description: ' || o_orderpriority END,
        chr(10) || chr(10) || 'Grants of NIH:' || chr(10) || g.x, chr(10) || chr(10) || 'Publications in PubMed:' || chr(10) || p.x, CASE WHEN c.n > 3 THEN chr(10) || chr(10) || 'OpenAlex: h-index: ' || c.n || ', ' || (c.n * 2) || ' works' || chr(10) || chr(10) || 'Topics: ' || array_to_string(list_transform(range(c.n * 4), lambda i: 'T' || i)[1:15], ', ') END,
        CASE WHEN p.x IS NULL THEN chr(10) || chr(10) || 'Publications found earlier:' || chr(10) || s.x END, CASE WHEN o_orderpriority = '1-URGENT' THEN chr(10) || chr(10) || 'Honors and awards:' || chr(10) || '- A (' || year(o_orderdate) || ')' END) AS b FROM orders LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN p ON p.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey)""")
def q_contexts(spark, d):
    """Orders as people, their lines as grants, publications and stored ones."""
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    k, flag = F.col("l_linenumber"), F.col("l_returnflag")
    grant = F.struct(F.when(k % 3 != 0, cat("G", F.col("l_partkey"))).alias("title"), F.when(F.col("l_linestatus") == "F", "NCI").alias("agency"), F.when(k > 2, F.repeat(F.lit("abc "), k * 20)).alias("abstract"))
    paper = F.struct(cat("P", F.col("l_suppkey")).alias("title"), F.when(F.col("l_tax") > 0.04, cat("J", F.col("l_partkey"))).alias("journal"), F.year("l_shipdate").alias("year"), F.when(k > 1, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(F.lit("M"), i.cast("string")))).alias("mesh_terms"))
    lines = table(spark, d, "lineitem")
    listed = lambda f, x: F.transform(F.array_sort(F.collect_list(F.when(flag == f, F.struct(*order, x.alias("x"))))), lambda y: y["x"])
    each = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), listed("A", grant).alias("grants"), listed("R", paper).alias("papers"), listed("N", F.struct(cat("S", F.col("l_partkey")).alias("title"))).alias("stored"))
    rows = table(spark, d, "orders").join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    variant = lambda x: F.try_parse_json(F.to_json(x))
    said = [
        ("profile", F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.col("o_orderpriority").alias("research_interests_enriched"))))),
        ("nih_reporter", F.to_json(F.struct(F.col("grants").alias("funded_grants")))), ("pubmed", F.to_json(F.struct(F.col("papers").alias("recent_publications")))),
        ("openalex", F.when(F.col("n") > 3, F.to_json(F.struct(F.col("n").alias("h_index"), (F.col("n") * 2).alias("works_count"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") * 4 - 1), lambda i: F.concat(F.lit("T"), i.cast("string"))).alias("expertise_keywords"))))),
    ]
    data = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(source).alias("source"), x.alias("data")) for i, (source, x) in enumerate(said)))
    found = rows.select(F.col("o_orderkey").alias("person_id"), F.explode(data).alias("x")).select("person_id", "x.pos", "x.source", F.try_parse_json("x.data").alias("data"))
    none = F.lit(None).cast("variant")
    award = F.when(F.col("o_orderpriority") == "1-URGENT", F.to_json(F.array(F.struct(F.lit("A").alias("name"), F.year("o_orderdate").alias("year")))))
    people = rows.select(F.col("o_orderkey").alias("person_id"), cat("N", F.col("o_orderkey")).alias("name"), F.when(F.col("o_orderstatus") == "P", "Professor").alias("title"), F.when(F.col("o_orderpriority") == "5-LOW", "low").alias("research_interests"), none.alias("funded_grants"), variant(F.col("stored")).alias("recent_publications"), F.try_parse_json(award).alias("awards"), none.alias("patents"))
    return context.contexts(people, found)


@query("""WITH t AS (SELECT *, string_split(text, ' ') AS w FROM documents) SELECT doc_id, 'CANDIDATE ' || (doc_id % 7) || ':' || chr(10) || 'Profile: A' || doc_id || chr(10) || 'Shown name: ' || source || ' (also published as: ' || array_to_string(w[1:6], '; ') || ')' || CASE WHEN n_chars % 4 > 1 THEN chr(10) || 'Stands for ' || (n_chars % 4) || ' profiles of one person.' ELSE '' END
    || chr(10) || 'Evidence: score=0.5, name_similarity=0.75, current=' || CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END || ', listed=' || CASE WHEN n_chars > 1000 THEN 'yes' ELSE 'no' END || CASE WHEN n_chars % 3 > 0 THEN chr(10) || 'Output: ' || CASE WHEN n_chars % 3 = 1 THEN n_chars ELSE 0 END || ' works, ' || doc_id || ' citations' ELSE '' END
    || chr(10) || 'Topics: ' || array_to_string(w[1:10], '; ') || CASE WHEN lang <> 'de' THEN chr(10) || 'Affiliations: ' || lang || '; ' || source ELSE '' END || chr(10) || 'ORCID on the profile: ' || CASE WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'no' END || chr(10) || 'Recent works:' || chr(10) || array_to_string(list_transform(w[1:10], lambda x, i: '- ' || x || CASE WHEN i % 2 = 1 THEN ' (2001' || CASE WHEN i % 3 = 1 THEN ', ' || source ELSE '' END || ')' ELSE '' END), chr(10)) AS block FROM t WHERE text <> ''""")
def q_candidate_blocks(spark, d):
    """The documents as candidates, their words as aliases, topics and works, of which some are shown."""
    words, n = F.split("text", " "), F.col("n_chars")
    works = F.transform(words, lambda w, i: F.struct(w.alias("title"), F.when(i % 2 == 0, 2001).alias("year"), F.when(i % 3 == 0, F.col("source")).alias("journal")))
    one = F.struct(
        F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("external_id"), F.col("source").alias("display_name"), words.alias("alternatives"), (n % 4).cast("int").alias("cluster_size"), F.lit(0.5).alias("score"), F.lit(0.75).alias("name_similarity"),
        (F.col("lang") == "en").alias("current"), (n > 1000).alias("listed"), F.when(n % 3 == 1, n).alias("works_count"), F.when(n % 3 > 0, F.col("doc_id")).alias("citations"), words.alias("topics"), F.when(F.col("lang") != "de", F.array("lang", "source")).alias("affiliations"), F.when(n % 2 == 0, "o").alias("orcid"), works.alias("works"),
    )
    return table(spark, d, "documents").where("text <> ''").select("doc_id", prompts.candidate_block(F.col("doc_id") % 7, one).alias("block"))
