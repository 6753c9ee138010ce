"""Queries of streams and of what they leave behind, with the SQL of the batch that each equals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick import workspace
from tarnwick.catalog import _FOLD_SQL, _candidates, once, query, table
from tarnwick.catalog_people import _PEOPLE_SQL, _people
from tarnwick.operators import budget, identity, merge, review
from tarnwick.plans import incremental, publication
from tarnwick.sources import files
from tarnwick.streaming import cooldown, harvest
from tarnwick.versions import Store


# A harvest

_HARVEST_SQL = """SELECT p_partkey, unnest(['Roy & Co, ' || p_brand, p_type || ' Lee', 'Wu, Bo ' || p_size, '', '1, 2']) AS creator, unnest([1, 2, 3, 4, 5]) AS nth, p_name || ' < ' || p_type AS title, CASE WHEN p_size % 7 <> 0 THEN 1980 + p_size END AS year, CASE WHEN p_size % 2 = 0 THEN p_brand END AS journal, '10.1/' || p_partkey AS doi, 'http://x.edu/' || p_partkey AS url FROM part WHERE p_size % 11 <> 0"""
_KEYED_SQL = f"""SELECT *, row_number() OVER (PARTITION BY author_norm, title ORDER BY p_partkey, nth) AS n FROM (SELECT *, CASE WHEN creator LIKE '%,%' THEN regexp_replace(lower(split_part(creator, ',', 1)), '[^a-z]', '', 'g') || '|' || regexp_replace(lower(split_part(trim(split_part(creator, ',', 2)), ' ', 1)), '[^a-z]', '', 'g') ELSE 'lee|' || regexp_replace(lower(split_part(creator, ' ', 1)), '[^a-z]', '', 'g') END AS author_norm FROM ({_HARVEST_SQL}) WHERE creator <> '') WHERE author_norm <> '|'"""


def _captured(spark, d, folder: str, low: int, high: int, each: int = 100) -> None:
    """Pages of ``each`` parts, the ``low``-th to the ``high``-th, as captured; every eleventh size has no title."""
    parts = table(spark, d, "part").withColumn("page", F.floor(F.col("p_partkey") / each))
    title = F.when(F.col("p_size") % 11 == 0, "").otherwise(F.concat("p_name", F.lit(" < "), "p_type"))
    entry = F.struct(
        F.array(F.concat(F.lit("Roy & Co, "), "p_brand"), F.concat("p_type", F.lit(" Lee")), F.concat(F.lit(" Wu, Bo "), F.col("p_size").cast("string")), F.lit(""), F.lit("1, 2")).alias("creators"), title.alias("title"),
        F.array(F.lit("n.d."), F.when(F.col("p_size") % 7 != 0, F.concat((1980 + F.col("p_size")).cast("string"), F.lit("-05"))).otherwise("x1999")).alias("dates"), F.array(F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")).alias("sources"),
        F.array(F.concat(F.lit("https://doi.org/10.1/"), F.col("p_partkey").cast("string")), F.concat(F.lit("http://x.edu/"), F.col("p_partkey").cast("string"))).alias("ids"),
    )
    last = parts.agg(F.max("page").alias("last"))
    pages = parts.where(F.col("page").between(low, high)).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("all")).crossJoin(F.broadcast(last))
    token = F.when(F.col("page") < F.col("last"), F.concat(F.lit("set/a&b="), (F.col("page") + 1).cast("string")))
    own = F.when(F.col("page") > 0, F.concat(F.lit("set/a&b="), F.col("page").cast("string"))).otherwise("")
    harvest.capture(pages.select(own.alias("token"), harvest.page_xml(F.transform("all", lambda x: x["e"]), token).alias("xml")), folder)


@once
def _harvested(spark, d) -> DataFrame:
    """Half of the pages are there when the harvest begins; it waits for the others, and goes on in a new query."""
    folder = workspace.folder(spark, "harvest")
    store = Store(spark, f"{folder}/table")
    _captured(spark, d, f"{folder}/pages", 0, 9)
    harvest.harvest(spark, f"{folder}/pages", store, f"{folder}/checkpoint")
    _captured(spark, d, f"{folder}/pages", 10, 1 << 40)
    return harvest.harvest(spark, f"{folder}/pages", store, f"{folder}/checkpoint")


@query(f"SELECT author_norm, title, year::INTEGER AS year, journal, doi, url FROM ({_KEYED_SQL}) WHERE n = 1")
def q_harvest_stream(spark, d):
    return _harvested(spark, d).select("author_norm", "title", "year", "journal", "doi", "url")


@query(f"""SELECT c_custkey AS person_id, place, title FROM (SELECT c_custkey, title, row_number() OVER (PARTITION BY c_custkey ORDER BY year DESC NULLS LAST, title) AS place FROM customer JOIN ({_KEYED_SQL}) ON n = 1 AND author_norm = 'lee|' || lower(['ECONOMY', 'PROMO', 'STANDARD', 'SMALL', 'LARGE', 'MEDIUM'][1 + c_custkey % 6])) WHERE place <= 15""")
def q_harvest_lookup(spark, d):
    first = F.element_at(F.array(*map(F.lit, ["Economy", "PROMO", "Stan-dard", "small", "large", "medium"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), first.alias("first"), F.lit("Lee").alias("last"))
    return harvest.look_up(people, _harvested(spark, d)).select("person_id", F.col("place").cast("long").alias("place"), "title")


# A cooldown


@query("""WITH r AS (SELECT user_id, event_type, arg_max(ts, ts) AS stamp, arg_max(value < 250, ts) AS ours FROM events GROUP BY ALL), k AS (SELECT user_id, min(stamp) + INTERVAL 10 DAY AS until, bool_and(ours) AS ours FROM r GROUP BY user_id), now AS (SELECT max(ts) AS now FROM events)
    SELECT user_id::VARCHAR AS key, CASE WHEN ours AND until > now THEN until END AS fresh_until FROM k, now""")
def q_cooldown_stream(spark, d):
    """Events as judgements of each user's five kinds, in the order of time in several micro-batches: January,
    which all events are in, comes in week by week, and the stream goes on after each."""
    folder = workspace.folder(spark, "cooldown")
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "value")
    week = F.weekofyear("ts")
    for part in range(1, 6):
        events.where(week == part).write.mode("append").parquet(f"{folder}/stream")
        judged = spark.readStream.schema(events.schema).parquet(f"{folder}/stream")
        judged = judged.select(F.col("user_id").alias("key"), F.col("event_type").alias("row"), F.col("ts").cast("timestamp").alias("stamp"), F.when(F.col("value") < 250, "ours").otherwise("theirs").alias("model"))
        changes = cooldown.into_folder(cooldown.freshness(judged, "ours", 10), f"{folder}/out", f"{folder}/checkpoint")
    return cooldown.latest(changes).select("key", F.col("fresh_until").cast("timestamp_ntz").alias("fresh_until"))


# Incremental enrichment

#: What a line says: a publication, a grant or an award, each of its own shape, some as bare texts.
_ENTRY_SQL = """CASE l_linenumber % 3 WHEN 0 THEN 'funded_grants' WHEN 1 THEN 'recent_publications' ELSE 'awards' END AS field, l_returnflag AS source, CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'R' THEN 0.8 ELSE 0.75 END AS confidence"""
_SAID_SQL = f"""SELECT *, CASE field WHEN 'recent_publications' THEN CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) ELSE 'title:part' || l_partkey % 20 END WHEN 'funded_grants' THEN 'grant' || l_partkey % 5 ELSE 'prize' || l_suppkey % 4 || CASE WHEN yr % 2 = 0 THEN yr::VARCHAR ELSE '' END END AS key
    FROM (SELECT *, {_ENTRY_SQL}, year(l_shipdate) AS yr, CASE WHEN l_linestatus = 'F' THEN '10.1/X' || l_suppkey % 7 END AS doi, l_partkey * 1000000000 + l_suppkey * 10000 + l_quantity::BIGINT * 100 + l_linenumber AS pos FROM lineitem)"""
_MERGED_SQL = f"""SELECT l_orderkey AS person_id, field, key, sources, source, row_number() OVER (PARTITION BY l_orderkey, field ORDER BY CASE WHEN field = 'recent_publications' THEN yr END DESC NULLS LAST, confidence DESC, source, pos) AS place FROM (
    SELECT *, list_sort(list(DISTINCT source) OVER (PARTITION BY l_orderkey, field, key)) AS sources, row_number() OVER (PARTITION BY l_orderkey, field, key ORDER BY confidence DESC, source, pos) AS n FROM ({_SAID_SQL})) WHERE n = 1"""


def _said(rows: DataFrame) -> DataFrame:
    """Contributions of lines, their entries as JSON of three shapes."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    k, year, source = F.col("l_linenumber"), F.year("l_shipdate"), F.col("l_returnflag")
    doi = F.when(F.col("l_linestatus") == "F", text("10.1/X", F.col("l_suppkey") % 7))
    publication = F.to_json(F.struct(text("Part ", F.col("l_partkey") % 20).alias("title"), year.alias("year"), doi.alias("doi")))
    grant = F.when(source == "A", F.to_json(F.struct(text("GRANT-", F.col("l_partkey") % 5).alias("title"), F.lit("NIH").alias("agency")))).otherwise(F.to_json(F.struct(F.lit("").alias("title"), text("grant ", F.col("l_partkey") % 5).alias("agency"))))
    award = F.when(year % 2 == 0, F.to_json(F.struct(text("Prize ", F.col("l_suppkey") % 4).alias("name"), year.cast("string").alias("year")))).otherwise(text('"Prize ', F.col("l_suppkey") % 4, '"'))
    field = F.when(k % 3 == 0, "funded_grants").when(k % 3 == 1, "recent_publications").otherwise("awards")
    entry = F.when(k % 3 == 0, grant).when(k % 3 == 1, publication).otherwise(award)
    confidence = F.when(source == "A", 0.9).when(source == "R", 0.8).otherwise(0.75)
    pos = F.col("l_partkey") * 1000000000 + F.col("l_suppkey") * 10000 + F.col("l_quantity").cast("long") * 100 + k
    return rows.select(F.col("l_orderkey").alias("person_id"), field.alias("field"), source.alias("source"), confidence.alias("confidence"), pos.alias("pos"), entry.alias("entry"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Merged entries by the key that tells them apart, which all shapes of an entry share."""
    entry = F.try_parse_json("entry")
    return rows.select("person_id", "field", merge.variant_key(F.col("field"), entry).alias("key"), "sources", F.col("place").cast("long").alias("place"))


@query(f"SELECT person_id, field, key, sources, place FROM ({_MERGED_SQL}) WHERE place <= CASE field WHEN 'funded_grants' THEN 25 ELSE 20 END")
def q_merge_variants(spark, d):
    said = _said(table(spark, d, "lineitem")).withColumn("entry", F.try_parse_json("entry"))
    return _keyed(merge.merge_entries(said, ["person_id"]).withColumn("entry", F.to_json("entry")))


@query(f"""SELECT l_orderkey AS person_id, field, min(CASE source WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'C' END) AS best, max(confidence)::DOUBLE AS confidence, count(DISTINCT source) > 1 AS several FROM ({_SAID_SQL}) GROUP BY ALL""")
def q_merge_provenance(spark, d):
    said = merge.provenance(_said(table(spark, d, "lineitem")), ["person_id"])
    name = F.substring_index("source_name", "+", 1)
    return said.select("person_id", "field", F.when(name == "A", "A").when(name == "R", "B").otherwise("C").alias("best"), "confidence", F.endswith("source_name", F.lit("+merge")).alias("several"))


@query(f"SELECT person_id, field, key, sources, place FROM ({_MERGED_SQL}) WHERE place <= CASE field WHEN 'funded_grants' THEN 25 ELSE 20 END")
def q_enrich_stream(spark, d):
    """Lines in two micro-batches, by flag, so each brings what other sources say of the same people; then
    the second again, as after a failure."""
    folder = workspace.folder(spark, "enrich")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    store = Store(spark, f"{folder}/store")
    for part in ("l_returnflag <> 'R'", "l_returnflag = 'R'"):
        # the stream goes on with what has come since it ended, in as many files as there are
        lines.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{folder}/in")
        incremental.enrich_stream(stream, _said, store, f"{folder}/checkpoint")
    incremental.apply_batch(store, _said(lines.where("l_returnflag = 'R'")), 1)
    merged = incremental.profiles(store).select("person_id", F.explode("entries").alias("e")).select("person_id", "e.*")
    return merged.select("person_id", "field", "key", "sources", "place")


# Budgets

_QUEUE_SQL = """SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place, coalesce(sum((event_type IN ('click', 'view'))::INT) OVER w, 0) AS used, coalesce(sum(round(value * 100)::BIGINT) OVER w, 0) AS spent FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(f"SELECT event_id, event_type IN ('click', 'view') AND used < 700 AS granted FROM ({_QUEUE_SQL})")
def q_lookup_budget(spark, d):
    rows = table(spark, d, "events")
    return budget.with_lookups(rows, ["ts", "event_id"], F.col("event_type").isin("click", "view"), 700).select("event_id", "granted")


@query(f"SELECT event_id, place FROM ({_QUEUE_SQL}) WHERE spent <= 9997000")
def q_time_budget(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return budget.within_time(table(spark, d, "events"), ["ts", "event_id"], cents, 10_000_000, 3000).select("event_id", F.col("place").cast("long").alias("place"))


@query("""WITH q AS (SELECT event_id, place, failed, count(*) FILTER (WHERE failed) OVER (ORDER BY place ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AND place >= 5 AS ends FROM (SELECT event_id, value < 120 AS failed, row_number() OVER (ORDER BY event_id DESC) AS place FROM events)) SELECT event_id, place FROM q WHERE place <= coalesce((SELECT min(place) FROM q WHERE ends), 1000000000)""")
def q_failures_in_a_row(spark, d):
    rows = budget.until_failures(table(spark, d, "events"), [F.col("event_id").desc()], F.col("value") < 120, 5)
    return rows.select("event_id", F.col("place").cast("long").alias("place"))


_SWEEP_SQL = f"""{_FOLD_SQL}, r AS (SELECT person, members, members[1].score AS top, round(members[1].score - runner, 9) > 0.05 AS clear, len(members) AS size, canonical, list_filter(members, lambda m: m.id = canonical)[1] AS c FROM last JOIN chosen USING (person)),
    p AS (SELECT *, size > 1 AND clear AND top >= 0.9 AS tie FROM r), q AS (SELECT *, NOT tie AND clear AND c.aff AND c.orcid IS NOT NULL AS asks FROM p),
    u AS (SELECT *, asks AND coalesce(sum(asks::INT) OVER (ORDER BY person ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS looked_up FROM q),
    o AS (SELECT *, CASE WHEN tie THEN 'accepted_tie_collapse' WHEN looked_up AND c.orcid = 'o1' THEN 'accepted_orcid_corroboration' ELSE 'left_pending' END AS outcome FROM u)"""


def _swept(spark, d) -> DataFrame:
    people = _candidates(spark, d).withColumns({"status_before": F.lit("unresolved"), "corroborated": F.lit(False), "fallback_ok": F.lit(False), "first": F.lit("Ann"), "last": F.lit("Lee")})
    verified = spark.createDataFrame([("https://orcid.org/o1", True, 1.0, True, False), ("O0", False, 1.0, True, False)], "orcid string, employed boolean, name_similarity double, unique_hit boolean, email_match boolean")
    return review.swept(identity.resolve(people), verified, ["person"], 5)


@query(f"""{_SWEEP_SQL} SELECT person, outcome, looked_up, CASE WHEN outcome <> 'left_pending' THEN canonical END AS chosen, CASE WHEN tie THEN len(members) END AS n_members, CASE WHEN tie AND c.orcid IS NULL THEN list_filter(members, lambda m: m.orcid IS NOT NULL)[1].orcid END AS adopted_orcid FROM o""")
def q_swept(spark, d):
    return _swept(spark, d).select("person", "outcome", "looked_up", "chosen", F.size("members").cast("long").alias("n_members"), "adopted_orcid")


@query(f"""{_SWEEP_SQL} SELECT count(*) AS people_seen, count(*) FILTER (WHERE outcome = 'accepted_tie_collapse') AS accepted_tie_collapse, count(*) FILTER (WHERE outcome = 'accepted_orcid_corroboration') AS accepted_orcid_corroboration, 0::BIGINT AS accepted_orcid_fallback, count(*) FILTER (WHERE outcome = 'left_pending') AS left_pending, count(*) FILTER (WHERE looked_up) AS orcid_lookups FROM o""")
def q_sweep_counts(spark, d):
    return review.sweep_counts(_swept(spark, d))


# A roster in splits


@query(r"""SELECT doc_id, 2 * doc_id AS pos, text, source || ',"' || lang AS tag, '' AS blank FROM documents""")
def q_roster_scan(spark, d):
    """The documents as a roster extract with quotes, commas and line ends in its fields and a blank line
    after each row, read in splits of 64 KB."""
    folder = workspace.folder(spark, "roster")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", F.col("doc_id").cast("string"), quoted(F.base64(F.encode("text", "UTF-8"))), quoted(F.concat("source", F.lit(',"'), "lang")), quoted(F.concat(F.lit("a\r\n"), F.col("doc_id").cast("string"), F.lit('\n"b"\n'))), F.lit(""))
    head = spark.createDataFrame([(-1, "extract\n\"of\nrosters\nid,text,tag,odd,blank")], "doc_id long, line string")
    rows = head.unionByName(table(spark, d, "documents").select("doc_id", F.concat(row, F.lit("\r\n")).alias("line")))
    rows.orderBy("doc_id").coalesce(1).select("line").write.text(folder)
    width = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = files.roster_csv(spark, folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    odd = F.col("odd") == F.concat(F.lit("a\r\n"), F.col("id"), F.lit('\n"b"\n'))
    return got.where(odd).select(F.col("id").cast("long").alias("doc_id"), "pos", F.decode(F.unbase64("text"), "UTF-8").alias("text"), "tag", "blank")


# Publication


@query(f"""WITH {_PEOPLE_SQL} SELECT coalesce(department, 'general') || ':' || CASE WHEN orcid IS NOT NULL THEN 'orcid:' || orcid ELSE 'email:' || lower(email) END AS stable_key, row_number() OVER (ORDER BY coalesce(department, 'general') || ':' || CASE WHEN orcid IS NOT NULL THEN 'orcid:' || orcid ELSE 'email:' || lower(email) END) AS id, first_name, title, pi_eligible::BIGINT AS pi_eligible, h_index,
    CASE WHEN id % 5 = 2 THEN '["Ph.D. \\"x\\"",null]' ELSE '[]' END AS degrees, (h_index % 3 = 0 OR id % 7 = 3)::BIGINT AS has_profile, coalesce(id % 4, 0)::BIGINT AS grants_count FROM people""".replace("(h_index % 3 = 0 OR id % 7 = 3)", "(coalesce(h_index % 3 = 0, FALSE) OR id % 7 = 3)"))
def q_export_rebuilt(spark, d):
    """People published, exported, and rebuilt from the export in another store."""
    folder = workspace.folder(spark, "publication")
    k = F.col("id")
    people = _people(spark, d).withColumns({
        "stable_key": F.concat(F.lit("k"), k.cast("string")), "pi_eligible": F.col("pi_eligible").cast("boolean"), "department_label": F.upper("department"),
        "degrees": F.when(k % 5 == 2, F.array(F.lit('Ph.D. "x"'), F.lit(None).cast("string"))), "research_interests": F.when(F.col("h_index") % 3 == 0, "seas").otherwise(""), "expertise_keywords": F.when(k % 7 == 3, F.array(F.lit("life"))),
        "funded_grants": F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit('{"title": "G'), i.cast("string"), F.lit('"}'))),
    }).withColumn("funded_grants", F.slice("funded_grants", F.lit(1), (k % 4).cast("int")))
    one, two = Store(spark, f"{folder}/one"), Store(spark, f"{folder}/two")
    publication.publish(one, people, 0, F.lit("then"))
    publication.export(one.read("people"), f"{folder}/export")
    publication.rebuild(spark, f"{folder}/export", two, F.lit("now"))
    return two.read("people").select("stable_key", "id", "first_name", "title", "pi_eligible", "h_index", "degrees", "has_profile", "grants_count")
